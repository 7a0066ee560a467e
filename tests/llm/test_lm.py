"""Fast ways of the language model against plain ones: keys and counts of words, gradient steps."""

import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import xxhash

from tessera.llm import lm
from tessera.llm.words import WordDigests, encoded


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_keys_of_words_are_their_digests(monkeypatch):
    monkeypatch.setattr(lm, "AT_ONCE", 100)  # several stretches
    draw = np.random.default_rng(8)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "\x1c", "\x85", "\xa0", "A", "Z", "é", "И", "\U0001f600", "\ud800", "a" * 7, "b" * 31, "c" * 32, "Q" * 70]
    texts = [None, "", " ", *("x" * n for n in range(1, 70)), *("".join(draw.choice(parts, 60)) for _ in range(40)), None]
    words = [encoded(t).lower().split() for t in texts]
    keys, starts, place = lm.keyed(texts)
    assert keys.tolist() == [k for ws in words for k in [*(xxhash.xxh64_intdigest(w, 42) >> 1 for w in ws), lm.END_KEY]]
    assert np.diff(np.append(starts, len(keys))).tolist() == [len(ws) + 1 for ws in words]
    assert len(place) == sum(map(len, words)) and (keys[place] != lm.END_KEY).all()


def test_counts_of_words_given_away_in_parts(monkeypatch):
    texts = [f"a b{i % 7} C{i} c{i}" if i % 5 else None for i in range(400)]
    want = Counter(lm.keyed(texts)[0].tolist())
    for counted, piece in ((lm.COUNTED, lm.PIECE), (lm.COUNTED, 50), (100, 50)):
        monkeypatch.setattr(lm, "COUNTED", counted)
        monkeypatch.setattr(lm, "PIECE", piece)
        found = list(lm._counts(iter([pd.DataFrame({"text": texts[:150]}), pd.DataFrame({"text": texts[150:]})])))
        got = Counter()
        for part in found:
            assert part["word"].is_unique
            got.update(dict(zip(part["word"].tolist(), part["c"].tolist(), strict=True)))
        assert got == want and (len(found) > 1) == (counted == 100)
    assert not list(lm._counts(iter([pd.DataFrame({"text": []})])))


def test_words_cost_less_than_looking_up_each(texts):
    """CPU seconds of counting and coding beside those of three look-ups of each word's digest."""
    frame = pd.DataFrame({"rid": range(len(texts)), "doc_id": range(len(texts)), "mark": 0, "held_out": False, "text": texts})
    head = SimpleNamespace(value=np.unique(lm.keyed(texts[:50])[0]))

    def cost(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    known = WordDigests()
    looked_up = min(cost(lambda: [known.of(encoded(t).lower().split()) for t in texts]) for _ in range(5))
    passes = min(cost(lambda: (list(lm._counts(iter([frame]))), list(lm._code(head)(iter([frame]))))) for _ in range(5))
    assert passes < 3 * looked_up


def test_updates_add_all_gradients_of_a_row():
    """Rows that occur once, a few times and often in a batch, against a step by hand."""
    draw = np.random.default_rng(9)
    for width, priors in ((lm.CLASSES, False), (lm.WAYS, True)):
        n = 300
        rows = np.stack([1 + np.minimum(draw.zipf(1.5, n), 99) + 100 * k for k in range(4)], axis=1).astype(np.int32)
        assert {1, 2, 3, lm.FEW, lm.FEW + 1} <= set(np.bincount(rows.ravel()).tolist())
        trainer = lm.Trainer(500, width)
        weights, squares, seen = np.zeros((500, width)), np.ones(500), np.zeros(500, int)
        for _ in range(3):
            wanted = draw.integers(0, width, n)
            prior = draw.normal(size=(n, width)).astype(np.float32) if priors else None
            trainer.update(rows, wanted, prior)
            chances = np.exp(weights[rows].sum(axis=1) + weights[0] + (prior if priors else 0))
            gradient = chances / chances.sum(axis=1, keepdims=True) - np.eye(width)[wanted]
            whole = np.zeros_like(weights)
            for k in range(4):
                np.add.at(whole, rows[:, k], gradient)
            whole[0] = gradient.sum(axis=0)
            seen += np.bincount(np.append(rows.ravel(), np.zeros(n, int)), minlength=500)
            squares += (whole**2).sum(axis=1)
            weights -= lm.RATE * whole / np.sqrt(squares)[:, None]
        assert np.allclose(trainer.weights, weights, atol=1e-4) and np.allclose(trainer.squares, squares, rtol=1e-4)
        assert trainer.seen.tolist() == seen.tolist()

"""Results that SQL can't express, held against plain loops over the same rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from tessera.llm import classifier, lm, pii

DATA = "/root/testdata/sf0.001"
WRAP = 2**64


def plain_hash(value, rows):
    return (((value % WRAP) * 0x9E3779B97F4A7C15 % WRAP) >> 33) % rows


def softmax(weights, rows, prior=0.0):
    logits = np.clip(sum((weights[r].astype(float) for r in rows), weights[0].astype(float)), -60, 60) + prior
    return np.exp(logits) / np.exp(logits).sum()


def test_language_model_scores(spark, monkeypatch):
    """Each token's chance from the trained weights, by hand: class, way through the class's tree, share of the tail."""
    monkeypatch.setattr(lm, "HEAD", 30)
    held, train = {}, lm._train

    def kept(session, rows, model):
        held["model"], held["weights"] = model, train(session, rows, model)
        return held["weights"]

    monkeypatch.setattr(lm, "_train", kept)
    draw = np.random.default_rng(17)
    texts = {i: " ".join(f"w{min(int(draw.zipf(1.4)), 200)}" for _ in range(int(draw.integers(0, 30)))) for i in range(200)}
    texts[300], texts[301] = "w199 w199 never never w1", "never w198 w198"
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}

    def key(word):
        return lm.END_KEY if word is None else xxhash.xxh64_intdigest(word.encode(), 42) >> 1

    said = {i: [key(w) for w in [*t.split(), None]] for i, t in texts.items()}
    counts = Counter(k for i, keys in said.items() if zlib.crc32(str(i).encode()) % 5 != 1 for k in keys)
    model, (weights, inner) = held["model"], held["weights"]
    place = {int(k): i for i, k in enumerate(model.head)}
    assert len(place) == 30 and all(counts[k] == model.counts[i] for k, i in place.items())
    tail = {k: c for k, c in counts.items() if k not in place}
    ones, twos = (sum(c == n for c in counts.values()) for n in (1, 2))
    discount = (ones + 0.5) / (ones + 2 * twos + 1)
    mass = sum(tail.values())

    def word_row(code):
        return -1 - code if code < 0 and -1 - code < lm.OWN else lm.OWN + plain_hash(code, lm.OTHER)

    for i, keys in said.items():
        codes, total = [lm.START] * 3 + [-1 - place[k] if k in place else k for k in keys], 0.0
        for at in range(3, len(codes)):
            code, one, two, three = codes[at], codes[at - 1], codes[at - 2], codes[at - 3]
            rows = [1 + word_row(one), 1 + lm.WORD_ROWS + word_row(two), 1 + 2 * lm.WORD_ROWS + plain_hash(one * 31 + two * 1_000_003, lm.PAIRS), 1 + 2 * lm.WORD_ROWS + lm.PAIRS + plain_hash(three, lm.WIDE)]
            classes = softmax(weights, rows)
            if code < 0:
                own, chance = -1 - code, classes[model.class_of[-1 - code]]
                for node, branch in zip(model.trees.node[own], model.trees.branch[own], strict=True):
                    if node >= 0:
                        chance *= softmax(inner, [1 + plain_hash(r + lm.ROWS * (1 + int(node)), lm.INNER - 1) for r in rows], model.trees.shares[node])[branch]
            else:
                chance = classes[lm.TAIL] * ((tail[code] - discount) / mass if code in tail else discount * len(tail) / mass)
            total += math.log10(chance + (classes[lm.REPEAT] if code == one else 0.0))
        assert math.isclose(got[i]["score"], total, rel_tol=1e-4, abs_tol=1e-4), i
        assert got[i]["n_known"] == sum(k in counts for k in keys)


def test_classifier_scores(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = classifier.fit(docs, labels)
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    place = lambda name: xxhash.xxh32_intdigest(name) % classifier.DIMENSIONS
    edges = ".,;:!?\"'()*#$%&|<>"
    for r in docs.collect():
        text = r["text"] or ""
        words = [w for w in text.lower().encode().split()]
        if not words:
            assert got[r["doc_id"]]["kept"] and got[r["doc_id"]]["score"] == 0.0
            continue
        raw, distinct, total = text.encode(), set(words), 0.0
        lines = [x for x in text.split("\n") if x.strip()]
        measures = [
            sum(raw.count(c.encode()) for c in "#*$%&|<>") / len(words),
            sum(65 <= b <= 90 for b in raw) / max(len(raw) - raw.count(b" "), 1),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
            1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
            text.count(" | ") / len(words),
            text.count("!!") / len(words),
        ]
        for name in ["bias", *(f"{n}{min(int(v * 20), 20)}" for n, v in zip(classifier.LABELLERS, measures, strict=False))]:
            total += 2.0 * model.weights[place(f"={name}".encode())]
        for word in distinct:
            bare = word.decode().strip(edges)
            own = sum(float(model.weights[place(x.encode())]) for x in [bare, *(f"^{bare[:n]}" for n in (4, 5) if len(bare) >= n)] if bare)
            total += own * min(1.0, 8 / len(distinct) ** 0.5)
        assert math.isclose(got[r["doc_id"]]["score"], 1 / (1 + math.exp(-total)), abs_tol=1e-5), r["doc_id"]
        assert got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] < 0.5)


def plain_generations(texts, accept=0.6, least=3, most=8):
    """Accepted values by plain loops over contexts as strings."""
    edges, occurs = Counter(), Counter()
    for text in texts:
        words = pii._TOKEN.findall(text.lower())
        for a, b in zip(words, words[1:], strict=False):
            occurs[f"L {a}"] += 1
            occurs[f"R {b}"] += 1
        for a, b, _ in zip(words, words[1:], words[2:], strict=False):
            occurs[f"M {a} {b}"] += 1
        for token in pii._TOKEN.findall(text):
            for found, *_ in pii.pieces(token) if "=" in token or ":" in token else ():
                if found:
                    occurs[f"K {found.lower()}"] += 1
        for _, _, kind, value, contexts in pii.candidates(text, pii.base_spans(text)):
            for c in contexts:
                edges[kind, value, c] += 1
    scores, taken = {}, -1
    for _ in range(most):
        trust, support = defaultdict(float), Counter()
        for (kind, value, c), n in edges.items():
            for as_, s in [(kind, 1.0)] if kind else [(k, s) for (k, v), s in scores.items() if v == value]:
                trust[as_, c] += n * s / occurs[c]
                support[as_, c] += s >= accept
        patterns = {p: min(t, 0.999) for p, t in trust.items() if support[p] >= least}
        doubt = defaultdict(lambda: 1.0)
        for (kind, value, c), _ in edges.items():
            for (as_, of), t in patterns.items():
                if kind is None and of == c:
                    doubt[as_, value] *= 1 - t
        scores = {p: 1 - d for p, d in doubt.items()}
        before, taken = taken, sum(s >= accept for s in scores.values())
        if before == taken:
            break
    return {v: max((s, k) for (k, w), s in scores.items() if w == v)[1] for (_, v), s in scores.items() if s >= accept}


def test_found_identifiers(spark):
    draw = np.random.default_rng(41)
    leads = ["key", "the code", "api_key=", "host", "mail", "of", "page"]
    texts = []
    for i in range(240):
        lead = leads[int(draw.integers(0, 7))]
        value = [f"{draw.integers(16**15, 2**62):x}a0", f"10.0.0.{draw.integers(0, 255)}", f"user{draw.integers(0, 30)}@h.org", f"tok-{draw.integers(0, 25)}", str(draw.integers(0, 9999))][int(draw.integers(0, 5))]
        texts.append(f"some words and {lead}{'' if lead[-1] == '=' else ' '}{value} then more{i % 3}x")
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    accepted = plain_generations(texts)
    assert accepted
    for r in got:
        text = texts[r["doc_id"]]
        base = pii.base_spans(text)
        more = [(kind or f"found_{accepted[value]}", a, b) for a, b, kind, value, _ in pii.candidates(text, base) if kind == "secret" or kind is None and value in accepted]
        assert r["spans"] == pii.written(base + more), text

"""Each operator against a plain version, on the driver's smallest table and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, decontaminate, html, linededup, lm, pii, rules, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, fp long, words string"


def words(text):
    return WORD.findall(text or "")


ODD = [
    (1, "", "en", "a", 0, 0, ""),
    (2, None, "en", "a", 0, 0, ""),
    (3, " \n\t \n", "en", "a", 0, 0, ""),
    (4, "one two three", None, None, 0, 0, ""),
    (4, "one two three", None, None, 0, 0, ""),
    (None, "one two three", "en", "a", 0, 0, ""),
    (5, "word " * 30_000, "en", "a", 0, 0, ""),
    (6, "x" * 60_000, "en", "b", 0, 0, ""),
    (7, "the same long line of more than five words\nshort\n" * 3, "de", "b", None, None, None),
    (8, "the same long line of more than five words\nanother line that nobody else has at all", "de", "b", 0, 0, ""),
    (9, " ".join(f"w{i}" for i in range(130)), "de", "b", 0, 0, ""),
    (10, "intro " + " ".join(f"w{i}" for i in range(20, 100)) + " outro", "de", "b", 0, 0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- line dedup -----------------------------------------------------------------------


def plain_line_dedup(rows, least):
    """Later copies of every run of ``least`` words or more, all runs tried."""
    sequences = {i: [(n, x) for n, x in enumerate(t.split("\n")) if words(x)] for i, t in rows.items() if t is not None}
    first, runs = {}, []
    for i in sorted(sequences):
        s = sequences[i]
        for a in range(len(s)):
            total = 0
            for b in range(a, min(a + least + 3, len(s))):
                total += len(words(s[b][1]))
                if total >= least:
                    key = tuple(x for _, x in s[a : b + 1])
                    first[key] = min(first.get(key, (i, s[a][0])), (i, s[a][0]))
                    runs.append((i, a, b, key))
    gone = {i: set() for i in rows}
    for i, a, b, key in runs:
        if first[key] != (i, sequences[i][a][0]):
            gone[i] |= {n for n, _ in sequences[i][a : b + 1]}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows.items()}


@pytest.mark.parametrize("least", [1, 5, 9])
def test_line_dedup(docs, pairs, least):
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs, least).collect()}
    assert got == plain_line_dedup(dict(pairs), least)


def test_line_dedup_joins_short_lines(spark):
    rows = {1: "a b\nc d\ne f\nunique one here", 2: "start it off\na b\nc d\ne f", 3: "a b\nx\nc d", 4: "c d\ne f"}
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(rows, 5)
    assert got[2] == "start it off" and got[4] == rows[4]


def test_line_dedup_of_runs_of_any_length(spark):
    draw = np.random.default_rng(21)
    source = [" ".join(["w"] * int(n)) + f" {k}" for k, n in enumerate(draw.integers(0, 5, 40))]
    rows = {}
    for i in range(40):
        lines = []
        for _ in range(int(draw.integers(1, 5))):
            at = int(draw.integers(0, 36))
            lines += source[at : at + int(draw.integers(1, 30))] + ([""] if draw.random() < 0.3 else [])
            if draw.random() < 0.4:
                lines.append(f"own {i} {len(lines)}")
        rows[i] = "\n".join(lines)
    for least in (1, 4, 5, 8):
        got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), least).collect()}
        assert got == plain_line_dedup(rows, least), least


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["doc", "gone", "line", "lines", "seq", "__gone", "__removed", "__lines", "__doc"]
    rows = [(i, "five words are in here\nx", *range(len(names))) for i in (1, 2)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    done = linededup.line_dedup(docs)
    assert done.columns == ["doc_id", "text", "doc", "gone", "line", "lines", "seq", "__gone", "__doc", "__lines", "__removed"]
    assert {tuple(r) for r in done.collect()} == {(1, "five words are in here\nx", 0, 1, 2, 3, 4, 5, 8, 2, 0), (2, "", 0, 1, 2, 3, 4, 5, 8, 2, 2)}


def test_line_dedup_odd(odd, nothing):
    done = linededup.line_dedup(odd)
    assert done.columns == [*odd.columns, "__lines", "__removed"]
    got = {(r["doc_id"], i): r for i, r in enumerate(sorted(done.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    texts = {k[0]: r["text"] for k, r in got.items()}
    assert texts[1] == "" and texts[2] is None and texts[None] == "one two three" and texts[4] == "one two three"
    assert texts[7].count("the same long line") == 1 and texts[8] == "another line that nobody else has at all"
    assert linededup.line_dedup(nothing).count() == 0


# ---- substring dedup ----------------------------------------------------------------


def plain_substrings(rows, length=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("limit", [1000, 1])
def test_substrings(docs, pairs, limit):
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeated_passages(docs, 50, limit).collect()}
    assert got == plain_substrings(pairs)


def test_substrings_odd(odd, nothing):
    rows = substrings.remove_repeated_passages(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert got[10]["n_removed"] == 80 and got[10]["text"] == "intro outro" and got[9]["n_removed"] == 0
    assert got[5]["n_removed"] == 0 and got[2]["n_words"] == 0 and got[None]["n_words"] == 3
    assert substrings.remove_repeated_passages(nothing).count() == 0


# ---- near duplicates ------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(prints):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (f"{f:016x}", low[find(k)]) for k, (i, f) in enumerate(prints)}


def test_near_duplicates(docs, pairs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_near_dedup(docs).collect()}
    assert got == plain_components(pairs)


@pytest.mark.parametrize("small", [1, 4, 32])
def test_links_within_two_bits(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    draw = np.random.default_rng(1)
    base = [int(x) for x in draw.integers(0, 2**63, 30)]
    prints = {}
    for k, b in enumerate(base):
        for m in range(12):
            flips = draw.choice(64, int(draw.integers(0, 4)), replace=False)
            prints[b ^ int(sum(1 << int(f) for f in flips)) & (2**64 - 1)] = k * 100 + m
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(f), r) for f, r in prints.items()], "fp long, rep long")
    from tessera.operators.components import connected_components

    got = {r["id"]: r["component"] for r in connected_components(simhash.similar_links(df)).collect()}
    keys = list(prints)
    parent = {r: r for r in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(prints[a]), find(prints[b])
                parent[max(x, y)] = min(x, y)
    assert all(got.get(r, r) == find(r) for r in parent)


def test_covering_masks_cover_all_pairs():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 7 and all(m.bit_count() in (36, 37) for m in masks)
    assert all(any(not m & (1 << a | 1 << b) for m in masks) for a in range(64) for b in range(a))


def test_near_duplicates_odd(odd, nothing):
    got = {}
    for r in simhash.simhash_near_dedup(odd).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert got[1] == got[2] == got[3] == {("0" * 16, 1)} and got[None] == got[4] and {c for _, c in got[4]} == {4}
    kept = sorted((r["doc_id"] or -1) for r in simhash.keep_representatives(odd).collect())
    assert kept.count(4) == 2 and 2 not in kept and 1 in kept
    assert simhash.simhash_near_dedup(nothing).count() == 0 and simhash.keep_representatives(nothing).count() == 0


# ---- decontamination ------------------------------------------------------------------


def plain_contaminated(rows, items, threshold=0.8):
    found = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        for k, text in items:
            n = re.findall(r"\w+", (text or "").lower())
            size = min(5, len(n))
            if not n:
                continue
            want = Counter(tuple(n[p : p + size]) for p in range(len(n) - size + 1))
            have = [tuple(w[p : p + size]) for p in range(len(w) - size + 1)]
            if not set(have) & set(want):
                continue
            for p in range(len(w) - len(n) + 1):
                both = sum((Counter(have[p : p + len(n) - size + 1]) & want).values())
                s = both / (2 * sum(want.values()) - both)
                if s >= threshold and s > found.get((i, k), (0,))[0]:
                    found[i, k] = (s, p)
    return found


def test_decontamination(spark, docs, pairs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontaminate.contaminated(docs, items, block_characters=2000).collect()}
    assert got == plain_contaminated(pairs, [tuple(r) for r in items.collect()]) and got
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {i for i, _ in pairs} - {i for i, _ in got}


def test_decontamination_edits(spark):
    item = " ".join(f"t{i}" for i in range(40))
    changed = item.split()
    changed[20] = "other"
    rows = [(1, f"Before. {item.upper()}! after"), (2, " ".join(changed)), (3, " ".join(item.split()[1:])), (4, " ".join(item.split()[:20])), (5, "yes no"), (6, None), (None, item)]
    items = [(1, item), (2, "yes no"), (3, ""), (4, None), (None, item)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_contaminated([(i if i is not None else -1, t) for i, t in rows], [(k if k is not None else -1, t) for k, t in items])
    assert {(r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"] if r["item_id"] is not None else -1): r["similarity"] for r in got} == {k: v[0] for k, v in want.items()}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), empty).count() == 0


def test_multi_index_finds_all_within_radius():
    draw = np.random.default_rng(3)
    rows = [(i, i, " ".join(f"w{draw.integers(0, 40)}" for _ in range(30))) for i in range(40)]
    items = decontaminate.Items(rows, 68)
    fps = items.fps[30]
    found = [draw.integers(0, 256, (200, 32)).astype(np.uint8)]
    for far in (0, 30, 60, 66, 67, 68, 69, 72, 90):  # so many bits from an item, spread at random and crowded into few blocks
        for crowd in (256, 120, far):
            for _ in range(10 if far else 1):
                flips = np.zeros(256, np.uint8)
                flips[draw.choice(max(crowd, far), far, replace=False)] = 1
                found.append(fps[draw.integers(0, 40)][None, :] ^ np.packbits(flips)[None, :])
    found = np.concatenate(found)
    far = np.bitwise_count(found[:, None, :] ^ fps[None, :, :]).sum(axis=2)
    assert set(items.candidates(30, found)) == set(zip(*map(list, np.nonzero(far <= 68)), strict=True)) and (far == 68).any()
    assert (sum(items.tables[30][b][found[:200, b]].astype(int) for b in range(32)) >= items.least).mean() < 0.05  # the index is selective


def test_decontamination_keeps_columns_and_repeats(spark):
    item = " ".join(f"t{i}" for i in range(40))
    long = " ".join(f"w{i % 977}" for i in range(120_000)) + " " + item + " tail"
    rows = [(1, item, "a", 1, "x"), (1, item, "a", 1, "x"), (2, "clean words only", "b", 2, "y"), (2, "clean words only", "b", 2, "y"), (3, long, None, 3, "z"), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, rid long, tokens string")
    items = spark.createDataFrame([(1, item, 5), (2, item, 5)], "item_id long, text string, rid int")
    got = decontaminate.contaminated(docs, items, block_characters=10)
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got.collect()) == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0), (3, 1, 120_000), (3, 2, 120_000)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, [rows[2], rows[3], rows[5]]))


# ---- tokens -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def digest_of(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe(docs, pairs, odd, nothing, vocabulary, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_digests(docs, vocabulary).collect()}
    assert got == {i: digest_of(library, t) for i, t in pairs}
    for r in bpe.encode_digests(odd, vocabulary).collect():
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        assert tuple(r)[1:] == digest_of(library, text or "")
    assert bpe.encode_digests(nothing, vocabulary).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs, vocabulary), vocabulary).collect()}
    assert back == dict(pairs)


def test_bpe_streams_long_pieces(vocabulary, library):
    v = bpe.Vocabulary(vocabulary)
    encoder = bpe.Encoder(v)
    draw = np.random.default_rng(14)
    made = ["".join(draw.choice(list("aeinorst"), 5000)), "".join(draw.choice(list("=-_*/"), 5000)), "".join(draw.choice(["the", "in", "un", "ation", "er", "zz"], 2500))]
    for text in ("ab" * 30000, "=-" * 2000, " " * 3000 + "x", "intheirofthe" * 300, "a<|endoftext|>b<|endoftext|>", "été" * 900, "\n\n \t" * 500, "don't I'LL we're", "漢字かな交じり文" * 40_000, "漢字" * 70_000 + " and " + "字" * 200_000, *made):
        ids = np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert encoder.most_open <= 2 * v.sufficient_lookahead() + 4 * bpe.PART


def test_tokens_are_stable_after_the_lookahead(vocabulary):
    v = bpe.Vocabulary(vocabulary)
    encoder, ahead = bpe.Encoder(v), v.sufficient_lookahead()
    draw = np.random.default_rng(15)
    for _ in range(20):
        data = "".join(draw.choice(["the", "in", "e", "st", "ation", "er", "z", "ing", "s"], 2500)).encode()[:4000]
        whole = [t for part in encoder.transduce([data]) for t in part]
        for end in (len(data) - 1, len(data) - 400, len(data) - 1000):
            ends = np.cumsum([len(t) for part in encoder.transduce([data[:end]]) for t in part])
            sure = ends[ends <= end - ahead].tolist()
            assert sure and sure == np.cumsum(list(map(len, whole)))[: len(sure)].tolist()
        # in parts of any size the same tokens come, the first of them before the end
        parts = [data[i : i + 7] for i in range(0, len(data), 7)]
        found = list(encoder.transduce(parts))
        assert [t for part in found for t in part] == whole and len(found) > 1


def test_decoder_holds_back_unfinished_characters(vocabulary, library):
    decoder = bpe.Decoder(bpe.Vocabulary(vocabulary))
    draw = np.random.default_rng(5)
    for _ in range(300):
        ids = draw.integers(0, 50257, 25)
        cut = int(draw.integers(0, 25))
        assert decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.finish() == library.decode(ids.tolist(), skip_special_tokens=False)


# ---- quality ----------------------------------------------------------------------------


def plain_rules(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules(docs, pairs, odd, nothing):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for i, t in pairs:
        want = plain_rules(t)
        assert tuple(got[i][c] for c in columns) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert 0.5 < np.mean([r["kept"] for r in got.values()]) < 1
    seen = Counter()
    for r in rules.quality_rules(odd).collect():
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        assert tuple(r[c] for c in columns) == plain_rules(text)
        seen[r["doc_id"]] += 1
    assert seen == Counter(i for i, *_ in ODD)
    assert rules.quality_rules(nothing).count() == 0


def test_repeats_where_digests_clash(docs, pairs):
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.base_measures(docs, fewer_bits=46).collect()}
    assert got == {i: plain_rules(t)[4] for i, t in pairs}


def test_every_source_has_thresholds_of_its_own(spark):
    rows = [(i, " ".join(["word"] * 40 + [f"w{i}x{j}" for j in range(60)]) + " #" * (i % 4 if s == "a" else 20 + i % 7), "en", s) for s, n in (("a", 300), ("b", 40)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sketch = rules.sketches(rules.base_measures(docs).withColumns({f"m_{m}": c for m, c in rules.measures().items()}))
    high = {w: {r["source"]: r["high_symbols"] for r in rules.fences(sketch, w).collect()} for w in (0, 100, 10**6)}
    assert high[0]["b"] > high[100]["b"] > high[10**6]["b"] > 0 and high[0]["a"] < high[0]["b"]


def test_vote_model_recovers_accuracies():
    draw = np.random.default_rng(0)
    counts, truth = Counter(), {}
    right = {"symbols": 0.5, "capitals": 0.4, "repeats": 0.6, "lines": 0.3, "tables": 0.5, "shouts": 0.4, "abuse": 0.7}
    for _ in range(4000):
        bad = draw.random() < 0.2
        code = 0
        for name in classifier.LABELLERS:
            vote = 0 if draw.random() < 0.1 else 2 if bad and draw.random() < right[name] else 1
            code = code * 3 + vote
        counts[code] += 1
        truth.setdefault(code, Counter())[bad] += 1
    posterior, share, said = classifier.fit_votes(dict(counts))
    assert abs(share - 0.2) < 0.03
    assert all(abs(said[1, k, 1] - right[n]) < 0.06 for k, n in enumerate(classifier.LABELLERS))
    hits = sum(c[posterior[code] > 0.5] for code, c in truth.items())
    assert hits / 4000 > 0.97


def test_classifier(spark, docs, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in classifier.classify(docs, labels).collect()}
    bad = {r["doc_id"]: r["quality"] == 0 for r in labels.where("toxic = 0").collect()}
    assert np.mean([got[i] != b for i, b in bad.items()]) > 0.97
    assert np.mean([got[i] for i, b in bad.items() if not b]) > 0.98
    for size in ("sf0.001", "sf0.01", "sf0.1"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
        found = classifier.classify(docs, labels).join(labels, "doc_id").groupBy("toxic", "quality").agg(F.avg(F.col("kept").cast("int")), F.count("*")).collect()
        kept = {(r[0], r[1]): r[2] for r in found}
        assert kept[1, 1] <= 0.1 and kept.get((1, 0), 0) <= 0.1 and kept[0, 1] >= 0.98, (size, found)
    none = labels.limit(0)
    assert classifier.classify(odd, none).count() == len(ODD)
    assert classifier.classify(nothing, none).count() == 0
    kept = classifier.keep_good(odd, none)
    assert kept.columns == odd.columns and {1, 2, 3, 4} <= {r["doc_id"] for r in kept.collect()}


# ---- pages --------------------------------------------------------------------------------


def plain_article(page):
    """What stands between the article tags of a page whose only inline tags are b and br."""
    import html as references

    inside = page.partition("<article>")[2].partition("</article>")[0]
    blocks = (" ".join(references.unescape(b.replace("<b>", "").replace("</b>", "").replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html_of = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        assert r["text"] == plain_article(html_of[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(("opens", "closes"), [("<div>", "</div>"), ("<div id=wrap><section>", "</section></div>"), ("<table><tr><td>", "</table>"), ("", "")])
def test_density_decides_without_an_article_element(spark, opens, closes):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    lost = sum(html.main_text(p.replace("<article>", opens).replace("</article>", closes)) != plain_article(p) for p in pages)
    assert lost <= 0.01 * len(pages)


def test_hidden_parts_and_white_space():
    prose = "Some words of an article that go on for a while. " * 5
    page = f"<body><div><p>a<b>b</b>  c\n<i> d</i>e<br>f&nbsp;g</p><p>{prose}</p><div class=\"x\" hidden><p>{prose}</p></div><p data-hidden=no>last</p></div></body>"
    assert html.main_text(page) == f"ab c de f g\n\n{prose.strip()}\n\nlast"
    very_long = "<body><nav>" + "<a href=x>y</a>" * 2000 + "</nav><div>" + f"<p>{prose}</p>" * 5000 + "</div></body>"
    assert html.main_text(very_long) == "\n\n".join([prose.strip()] * 5000)


def test_page_parts():
    prose = "Some words of an article that go on for a while. " * 5
    page = f"<html><body><header>Site</header><ul class=menu><li><a href=x>Home</a></ul><div id=content><h2>Title &amp; more</h2><p>{prose}<p>Short.<ul><li>one<li>two</ul></div><aside>s</aside><div class='cookie-notice'>c</div><form>f</form><section class=comments><p>reader</p></section><footer>f</footer></body></html>"
    assert html.main_text(page) == "\n\n".join(["Title & more", prose.strip(), "Short.", "one", "two"])
    assert html.main_text(None) == html.main_text("") == html.main_text(" \n") == html.main_text("<p></p>") == ""
    assert html.main_text("bare  text\n&lt;") == "bare text <"
    for broken in ("<" * 500, "<a" * 3000, "<div>" * 5000 + "deep", "</p></div>x", "<!-- open", "<script>1<2", '<p title="open>x</p>' * 30):
        assert isinstance(html.main_text(broken), str)


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r["text"] for r in got.collect()) == ["", "", "x", "x", "x"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- personal data ----------------------------------------------------------------------


def plain_base(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = d[::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(odd)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_base_spans(pairs):
    draw = np.random.default_rng(8)
    made = ["".join(draw.choice(list("ab@@..1234567890+-_ (9)é\n%"), int(draw.integers(0, 40)))) for _ in range(5000)]
    for text in [t or "" for _, t in pairs] + made:
        assert pii.base_spans(text) == plain_base(text)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words and then mail me: user{i}@host{i}.org please, thanks") for i in range(40)]
    rows += [(100 + i, f"config password=deadbeef{i:04x}cafe{i:04x} end") for i in range(40)]
    rows += [(900, "config password=hunter2x end"), (901, "the price of 3.50 is fine"), (902, None), (None, "password=letmein99 x"), (903, "")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert got[900]["spans"] == "found_secret:16:24" and "found_secret" in got[None]["spans"]
    assert got[901]["spans"] == got[902]["spans"] == got[903]["spans"] == ""
    assert got[3]["n_email"] == 1 and got[3]["base"] in got[3]["spans"]


def test_pii(docs, pairs, odd, nothing):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in pairs:
        base = plain_base(t or "")
        assert got[i]["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, *_ in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(","))
    assert pii.find(odd).count() == len(ODD) and pii.find(nothing).count() == 0


# ---- language model -----------------------------------------------------------------------


def test_language_model(docs, pairs, odd, nothing):
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    text = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in pairs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in text}
    counts = Counter(w for i, ws in text.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    gain = n = 0
    for i, ws in text.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
        if held[i]:
            gain, n = gain + r["score"] - r["base_score"], n + len(ws)
    assert gain / n > 0.5
    rows = lm.score(odd).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score(nothing).count() == 0


def test_class_probabilities_sum_to_one():
    draw = np.random.default_rng(2)
    weights = draw.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    rows = draw.integers(0, lm.ROWS, (50, 3))
    assert np.allclose(np.exp(lm.log_softmax(weights, rows)).sum(axis=1), 1, atol=1e-4)
    codes, starts = np.arange(9), np.array([0, 1, 3])
    assert lm._before(codes, starts, 2).tolist() == [lm.START] * 5 + [3, 4, 5, 6]


def single_words(spark, texts, more=()):
    """Training texts, and every word of theirs and some unknown ones as held-out texts of one word."""
    held = (i for i in range(10_000, 10**6) if zlib.crc32(str(i).encode()) % 5 == 1)
    kept = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5 != 1)
    alone = sorted({w for t in texts for w in t.split()}) + list(more)
    rows = [*zip(kept, texts, strict=False), *zip(held, alone, strict=False)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("head", [lm.HEAD, 20])
def test_texts_of_one_word_share_one_probability(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)  # the head not full and full
    texts = [" ".join(["of", "the", f"often{i % 30}", f"once{i}", "and", f"rare{i}"]) for i in range(300)]
    rows = [r for r in lm.score(single_words(spark, texts, ["never"])).collect() if r["held_out"]]
    assert len(rows) == 634 and {r["n_tokens"] for r in rows} == {2}
    assert sum(10 ** r["score"] for r in rows) <= 1


def test_tail_shares_sum_to_one():
    for head, tail, n1, n2 in (([5, 3], [1] * 7, 7, 0), ([9, 9], [4, 2, 2, 1, 1, 1], 3, 2), ([9], [3, 3], 0, 0), ([5, 3], [], 0, 0)):
        own = np.array(head)
        model = lm.Model(np.arange(len(own)), own, np.full(len(own), lm.FIRST), sum(head) + sum(tail), len(head) + len(tail))
        mass, discount, unknown = model.tail_shares(len(tail), n1, n2)
        assert 0 < discount < 1 and 0 < unknown <= 1
        assert math.isclose(sum((c - discount) / mass for c in tail) + unknown, 1)


def test_decontamination_of_documents_shorter_than_an_item(spark):
    draw = np.random.default_rng(6)
    items = [(k, " ".join(f"t{draw.integers(0, 90)}" for _ in range(n))) for k, n in enumerate((3, 6, 15, 25, 40, 63))]
    rows = [(0, None), (1, ""), (2, "t1")]
    for _, text in items:
        w = text.split()
        for cut in (0, 1, 2, 4, 7):
            rows += [(len(rows), " ".join(w[cut:])), (len(rows) + 1, " ".join(w[: len(w) - cut])), (len(rows) + 2, " ".join([*w[cut:], "more"]))]
    want = plain_contaminated(rows, items)
    for i, text in rows:
        w = (text or "").split()
        for k, item in items:
            n = item.split()
            size = min(5, len(n))
            if len(w) < len(n):
                a, b = (Counter(tuple(x[p : p + size]) for p in range(len(x) - size + 1)) for x in (w, n))
                if (a & b).total() / (a | b).total() >= 0.8:
                    want[i, k] = ((a & b).total() / (a | b).total(), 0)
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark, whole=True).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in got} == want
    texts = dict(rows)
    assert all(r["n_words"] == min(len(texts[r["doc_id"]].split()), len(dict(items)[r["item_id"]].split())) for r in got)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark, whole=True).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert len(want) > len(plain_contaminated(rows, items))


def test_names_that_only_mention_a_left_out_part():
    prose = "Some words of an article that go on for a while. " * 5
    rest = "<div class='sidebar-left'><p>aside</p></div><div id=ad-slot-2>buy</div><div class='site-header wide'>Site</div>"
    for name in ("content has-sidebar", "layout with-sidebar", "no-comments", "post social-share-enabled", "header-image-on", "sidebar", "content-sidebar-wrap"):
        page = f"<html><body>{rest}<div class='{name}'><h2>Title</h2><p>{prose}</p></div></body></html>"
        assert html.main_text(page) == f"Title\n\n{prose.strip()}"
    held = f"<body><div class='modal overlay'><article><p>Brief.</p></article></div><div class=footer-links><a href=x>{prose}</a></div></body>"
    assert html.main_text(held) == "Brief."
    comments = f"<body><article><p>Brief.</p></article><section class=comments><article><p>{prose}</p></article></section></body>"
    assert html.main_text(comments) == "Brief."


def test_classes_are_learned_from_the_corpus(spark):
    texts = [f"the {n} is {a} now" for n in ("cat", "red", "ox", "mill") for a in ("wet", "bad", "odd", "calm")] * 3
    counts = Counter(w for t in texts for w in t.split())
    head = sorted(counts, key=lambda w: (-counts[w], w))
    keys = np.concatenate([lm.keyed([w])[0][:1] for w in head])
    rows = spark.createDataFrame([(i, i, i, False, t) for i, t in enumerate(texts)], "rid long, doc_id long, mark long, held_out boolean, text string")
    follows = lm._followed(rows.mapInPandas(lm._code(spark.sparkContext.broadcast(keys)), lm._CODED), len(keys))
    place = {w: i for i, w in enumerate(head)}
    assert follows[place["cat"], place["the"]] == 12 and follows[place["wet"], place["is"]] == 12 and follows.sum() == sum(counts.values())
    group = lm.cluster(follows, np.array([counts[w] for w in head]), 4)
    nouns, words = ({group[place[w]] for w in x} for x in (("cat", "red", "ox", "mill"), ("wet", "bad", "odd", "calm")))
    assert len(nouns) == len(words) == 1 and nouns != words


def test_scores_do_not_depend_on_the_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)  # several shards
    found = [{r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score(docs.repartition(n)).collect()} for n in (1, 7)]
    assert found[0].keys() == found[1].keys()
    assert all(math.isclose(x, y, rel_tol=1e-9) for i in found[0] for x, y in zip(found[0][i], found[1][i], strict=True))


def test_a_repeated_tail_word_sums_both_ways(spark, monkeypatch):
    """After one rare word the probabilities of all next words, itself and unknown ones included, sum to at most one."""
    monkeypatch.setattr(lm, "HEAD", 12)
    texts = [f"of the often{i % 9} rare{i} rare{i} and rare{(i * 7) % 60}" for i in range(60)]
    alone = sorted({w for t in texts for w in t.split()}) + ["never"]
    held = (i for i in range(10_000, 10**6) if zlib.crc32(str(i).encode()) % 5 == 1)
    kept = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5 != 1)
    rows = [*zip(kept, texts, strict=False), *zip(held, ["rare5", *(f"rare5 {w}" for w in alone)], strict=False)]
    scores = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, *pairs_ = [10 ** scores[i] for i, _ in rows[60:]]
    # P(rare5) splits into the end after it and all next words, each followed by an end
    again = pairs_[alone.index("rare5")]
    assert again > max(p for p, w in zip(pairs_, alone, strict=True) if w.startswith("rare") and w != "rare5")
    assert first > 0 and sum(pairs_) < 1


def test_wider_skip_is_a_feature():
    starts = np.array([0])
    rows, _ = lm.context_rows(np.arange(5), starts)
    other, _ = lm.context_rows(np.array([7, 1, 2, 3, 4]), starts)
    assert lm.CLASSES == 32 and rows.shape == (5, 4) and rows.max() < lm.ROWS
    assert (rows[3] != other[3]).tolist() == [False, False, False, True]


def test_words_of_a_class_share_one_probability_after_any_context():
    draw = np.random.default_rng(4)
    counts = np.sort(draw.integers(2, 5000, 400))[::-1]
    class_of = draw.choice([lm.FIRST, lm.FIRST + 1, lm.FIRST + 2], 400, p=[0.9, 0.08, 0.02])
    class_of[7] = lm.END
    trees = lm.Trees(class_of, counts)
    places, context = np.arange(400), np.tile(draw.integers(1, lm.ROWS, (1, 4)), (400, 1)).astype(np.int32)
    plain = trees.logs(np.zeros((lm.INNER, lm.WAYS), np.float32), places, context)
    assert np.allclose(plain, np.log(counts / np.bincount(class_of, counts)[class_of]), atol=1e-4)
    found = trees.logs(draw.normal(size=(lm.INNER, lm.WAYS)).astype(np.float32), places, context)
    assert np.allclose(np.bincount(class_of, np.exp(found))[lm.END :], 1, atol=1e-4) and not np.allclose(found, plain, atol=0.1)


def test_context_tells_apart_words_of_one_class():
    trees, trainer = lm.Trees(np.full(40, lm.FIRST), np.full(40, 10)), lm.Trainer(lm.INNER, lm.WAYS)
    contexts = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], np.int32).repeat(20, axis=0)
    said = np.array([11, 30]).repeat(20)
    for _ in range(20):
        _, inner, branch, prior = trees.steps(said, contexts)
        trainer.update(inner, branch, prior)
    after = lambda word: trees.logs(trainer.weights, np.array([word, word]), contexts[[0, 20]])
    assert after(11)[0] > after(11)[1] + 1 and after(30)[1] > after(30)[0] + 1


def test_identifiers_in_long_tokens_and_beside_long_words(spark):
    filler = ",".join(f'"field{i}":"value"' for i in range(60))
    wide = "w" * 90
    rows = [(i, f"config password=deadbeef{i:04x}cafe{i:04x} end") for i in range(40)]
    rows += [(100 + i, f"{wide} beef{i:04x}feed{i:04x}00") for i in range(40)]
    rows += [(900, "{" + filler + ',"password":"hunter2x","z":0}'), (901, "https://host/?" + "a=b&" * 200 + "password=letmein99&c=d"), (902, f"{wide} token77zz")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, value in ((900, "hunter2x"), (901, "letmein99"), (902, "token77zz")):
        start = texts[i].index(value)
        assert f"found_secret:{start}:{start + len(value)}" in got[i].split(",")


def test_patterns_need_three_seeds_however_many_there_are(spark):
    rows = [(i, f"config password=deadbeef{i:05x}cafe{i:05x} end") for i in range(5000)]
    rows += [(9000 + i, f"losung=deadbeef{i:05x}feed{i:05x} fin") for i in range(3)]
    rows += [(9100, "config losung=hunter2x fin"), (9101, "two wort=deadbeef12345678ab x"), (9102, "wort=deadbeef12345678cd"), (9103, "wort=hunter3x")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9100] == "found_secret:14:22" and got[9103] == ""


def test_accepted_values_teach_new_patterns(spark):
    rows = [(i, f"config password=deadbeef{i:05x}cafe{i:05x} end") for i in range(40)]
    rows += [(100 + i, f"config password=alpha{i}moon end") for i in range(6)]
    rows += [(200 + i, f"the token alpha{i}moon issued for run") for i in range(6)]
    rows += [(300, "a token zz9plural issued for run"), (301, "password=" + "x1" * 300), (302, "a longkey" + "k" * 60 + "=b2b2"), (303, "take 5 of 12.5 or 7pm")]
    rows += [(400 + i, "longkey" + "k" * 60 + f"={i:04x}feedbeef{i:04x}beadfeed" + "0f" * 80) for i in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[103] == "found_secret:16:26" and got[203] == "found_secret:10:20"
    assert got[300] == "found_secret:8:17" and got[301] == "found_secret:9:609" and got[302] == "found_secret:70:74" and got[303] == ""
    assert got[400].startswith("secret:68:")


def test_recall_of_unseen_identifiers(spark):
    """Identifiers of no fixed form behind the words that stand before seeds; at least nine in ten are found, next to no plain numbers are."""
    draw = np.random.default_rng(31)
    leads = ("my key is", "api_key=", "call me:", "token", "secret:")
    rows, planted, plain = [], [], []
    for i in range(600):
        lead = leads[i % 5]
        seed = draw.random() < 0.6
        value = "".join(draw.choice(list("0123456789abcdef"), 24)) + "a0" if seed else f"{draw.choice(['sun', 'moon', 'fox'])}-{draw.integers(10**5, 10**6)}x"
        text = f"some words {draw.integers(10, 99)}00 of {i} pages, {lead}{'' if lead[-1] in '=' else ' '}{value} and so on"
        rows.append((i, text))
        plain.append(f":{11}:{15}")
        if not seed:
            planted.append((i, text.index(value), text.index(value) + len(value)))
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = np.mean([f"found_secret:{a}:{b}" in got[i].split(",") for i, a, b in planted])
    assert recall >= 0.9, recall
    assert np.mean([p in got[i] for i, p in enumerate(plain)]) < 0.01


def test_bitmap_marks_every_pattern(spark):
    ctx = pii._digested([f"L word{i}" for i in range(500)] + [f"M a{i} b" for i in range(500)])
    bits = np.unpackbits(np.frombuffer(pii._bitmap(spark.createDataFrame([(c,) for c in ctx], "ctx long")), np.uint8), bitorder="little")
    places = np.array(ctx, np.int64).view(np.uint64) >> np.uint64(64 - pii.MARKED)
    assert bits[places.astype(np.int64)].all() and bits.sum() == len(set(places.tolist()))
    assert pii._digested(["M a b"]) == pii.signed(pii.digests("M", ["a"], ["b"])).tolist()


def test_a_common_opening_is_in_many_groups():
    import pandas as pd

    opening = [f"o{i}" for i in range(16)]
    texts = [" ".join([*opening, *(f"d{k}w{i}" for i in range(34))]) for k in range(200)]
    anchor = substrings.signed(substrings.window_digests(substrings._DIGESTS.of([w.encode() for w in opening]), 16))
    rows = [b for t in texts for b in substrings.bundles(t, anchor, 50, 16)]
    frame = pd.DataFrame([(p, str(i).encode(), 0, back, n, said, i, i) for i, (p, _, back, n, said) in enumerate(rows)], columns=["prefix", "bundle", "first", "back", "n", "words", "low", "high"])
    if len(frame):  # if the opening is anybody's anchor
        longer = pd.concat(substrings._parts(12, 50)(iter([frame])))
        assert frame["prefix"].nunique() == 1 and longer["prefix"].nunique() == len(longer)


def test_deep_nodes_are_equal_windows():
    draw = np.random.default_rng(9)
    length, rows = 8, []
    for _ in range(300):
        n = int(draw.integers(1, 5))
        words = [b"abc"[i : i + 1] for i in draw.integers(0, 2, length + n - 1)]
        rows.append((b" ".join(words), int(draw.integers(n - 1, 6)), n, int(draw.integers(0, 50))))
    words, back, n, low = (list(x) if i == 0 else np.array(x) for i, x in enumerate(zip(*rows, strict=True)))
    want = {}
    for said, b, m, doc in rows:
        for k in range(m):
            key = (b - k, tuple(said.split()[k : k + length]))
            want[key] = min(want.get(key, doc), doc)
    got = {}
    for which, window, least in substrings.deep_nodes(words, back, n, low, length):
        for r, k, doc in zip(which.tolist(), window.tolist(), least.tolist(), strict=True):
            got[r, k] = doc
    assert got == {(r, k): want[b - k, tuple(said.split()[k : k + length])] for r, (said, b, m, _) in enumerate(rows) for k in range(m) if (r, k) in got}
    assert len(got) == sum(n)


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))


def test_words_that_a_polynomial_takes_for_one(spark):
    one = thue_morse(11)
    other = one.translate(str.maketrans("ab", "ba"))
    filler = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*filler[:30], one, *filler[30:]])), (2, " ".join([*filler[:30], other, *filler[30:]])), (3, one), (4, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeated_passages(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    for r in lm.score(docs).collect():
        assert r["n_known"] == sum(w in counts for w in dict(rows)[r["doc_id"]].split()) + 1


def test_texts_under_one_id_lose_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"one two {passage}"), (2, f"{passage} three"), (2, f"{passage} three"), (3, "so it goes " + "and on " * 200), (4, "and on " * 200)]
    got = sorted(tuple(r)[1:] for r in substrings.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 2)
    assert got == [(61, 60, "three"), (61, 60, "three"), (62, 60, "one two")]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_substrings_of_many_near_copies(spark, limit):
    draw = np.random.default_rng(12)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(int(draw.integers(0, 4))):
            w[int(draw.integers(0, 140))] = f"x{draw.integers(0, 3)}"
        rows.append((k, " ".join([f"own{k}"] * int(draw.integers(0, 3)) + w[int(draw.integers(0, 40)) :])))
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50, limit).collect()}
    assert got == plain_substrings(rows)


def test_operators_on_columns_of_any_name(spark, odd, vocabulary):
    names = ["rid", "kind", "value", "ctx", "mark", "prefix", "anchor", "anchors", "starts", "shard", "codes", "tail", "word", "bucket", "fp", "rep", "component_id", "posterior", "toxic", "doc", "line", "seq", "digest", "tokens", "all", "measure", "k_lang", "held_out"]
    wide = odd.select("doc_id", "text", "lang", "source").withColumns({n: F.lit("x") for n in names})
    labels = spark.createDataFrame([(9, 1, 0, "x")], "doc_id long, toxic int, quality int, text string")
    items = spark.createDataFrame([(1, "one two three", "x")], "item_id long, text string, rid string")
    found = {
        1: classifier.classify(wide, labels), 2: rules.quality_rules(wide), 4: bpe.encode_digests(wide, vocabulary), 6: substrings.remove_repeated_passages(wide),
        7: pii.find(wide), 8: linededup.line_dedup(wide), 9: simhash.simhash_near_dedup(wide), 10: lm.score(wide),
    }
    for n, rows in found.items():
        assert sorted(str(r["doc_id"]) for r in rows.collect()) == sorted(str(i) for i, *_ in ODD), n
    assert {r["doc_id"] for r in decontaminate.contaminated(wide, items).collect()} == {4, None}
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "y")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html.extract(pages).collect()] == ["x"]


def test_crawl_query_has_no_row_limit(spark):
    from tessera.queries import crawl_order

    assert "Limit" not in crawl_order(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()

"""Benchmark decontamination by SimHash of item-sized windows.

Tokens are runs of letters, digits and underscores in the lower-cased text.  An item of
``n`` tokens is held against every window of ``n`` tokens of a document; with ``whole``, as
the query and the pipeline have it, a document of fewer tokens is a window by itself.

1. One pass over the documents.  Multisets of ``m`` and ``l`` shingles reach similarity ``t`` only
   with ``(m + l) t / (1 + t)`` in common, so windows with fewer shingles that any item has
   can't match and are passed over.  Which shingles items have is asked of a bitmap of fixed size;
   a clash in it only costs work.  What is left are stretches of tokens, written out.
2. Items come in blocks of bounded size, and a block meets the stretches, not the documents.
   Every window and every item has a SimHash of 256 bits over its shingles, repeats
   included, cut into 32 blocks of eight bits.  Fingerprints within ``radius`` can't have three or
   more differing bits in more than ``radius // 3`` blocks, so they agree up to two bits in at least
   ``32 - radius // 3`` of them.  A table gives for each block and value the items within two bits;
   counting over blocks finds every item within the radius and one in 70 others (at the
   default), which a full comparison drops.
3. Candidates are verified exactly: the weighted Jaccard similarity of shingle
   multisets, the sum of smaller counts over the sum of larger ones, at least 0.8.

No index loses a fingerprint within the radius.  A similarity of 0.8 makes 39 of 256 bits differ in
the mean (0.15 of them, deviation 5.7), so that a pair that step 3 would take lies beyond the default
radius of 68 with a chance of one in ten million, and closer pairs with a smaller one.

Items shorter than five tokens count as one shingle; items without tokens, and null or empty
texts on either side, match nothing.  Items with equal tokens match alike, each under its own id,
and so do rows with equal texts.  Rows with a null doc_id or item_id are reported with null.
Very long texts cost memory for their tokens only.  Columns besides the ids and texts are not
read, but stay where rows are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WordDigests, batches, fresh, mix, window_digests
from tessera.plans.lineage import cut

TOKEN = re.compile(r"\w+")
SHINGLE, LANES, BLOCKS, NEAR = 5, 4, 32, 2
#: Characters and items of the benchmark that one broadcast holds, bits of the bitmap of shingles, cells that are compared at once.
BLOCK_CHARACTERS, BLOCK_ITEMS, MARKED, CELLS = 2_000_000, 2_000, 25, 1 << 22
_LANES = [np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1)], np.uint64) for i in range(LANES)]
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_STRETCH = "rid long, doc_id long, digest binary, k int, first int, all boolean, tokens string"
_MATCH = f"rid long, digest binary, no long, {SCHEMA}"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def prints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of ``width`` consecutive shingles from each start, a row of ``BLOCKS`` bytes."""
    lanes = np.stack([mix(shingles, lane) for lane in _LANES], axis=1)
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    ones = np.concatenate((np.zeros((1, bits.shape[1]), np.int32), bits.cumsum(axis=0, dtype=np.int32)))
    return np.packbits(2 * (ones[starts + width] - ones[starts]) > width, axis=1, bitorder="little")


def needed(width: int, threshold: float, window: int | None = None) -> int:
    """Shingles of an item that a window of as many shingles, or of ``window``, must share to reach the similarity."""
    return max(1, int(np.ceil((width + (width if window is None else window)) * threshold / (1 + threshold) - 1e-9)))


def _places(shingles: np.ndarray, k: int) -> np.ndarray:
    """Where shingles of ``k`` tokens stand in the bitmap."""
    return (mix(shingles, np.uint64(k)) >> np.uint64(64 - MARKED)).astype(np.int64)


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, rows: list[tuple[int, int | None, str | None]], radius: int) -> None:
        digests = WordDigests()
        self.radius, self.least = radius, BLOCKS - radius // (NEAR + 1)
        self.by_size: dict[int, list[tuple[int, int | None, Counter]]] = defaultdict(list)
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for no, item_id, text in rows:
            words = tokens(text)
            if words:
                shingles = window_digests(digests.of(words), min(SHINGLE, len(words)))
                self.by_size[len(words)].append((no, item_id, Counter(shingles.tolist())))
                found[len(words)].append(prints(shingles, np.array([0]), len(shingles))[0])
        self.fps = {n: np.stack(fps) for n, fps in found.items()}
        values = np.arange(256, dtype=np.uint8)
        #: [block, value, item]: whether the item's block is within two bits of the value.
        self.tables = {n: (np.bitwise_count(values[None, :, None] ^ fps.T[:, None, :]) <= NEAR).astype(np.uint8) for n, fps in self.fps.items()}

    def candidates(self, size: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (window, item) of this size whose fingerprints are within the radius."""
        table, fps = self.tables[size], self.fps[size]
        step = max(CELLS // len(fps), 1)
        for at in range(0, len(found), step):
            part = found[at : at + step]
            agree = table[0][part[:, 0]].copy()
            for block in range(1, BLOCKS):
                agree += table[block][part[:, block]]
            window, item = np.nonzero(agree >= max(self.least, 0))
            close = np.bitwise_count(part[window] ^ fps[item]).sum(axis=1, dtype=np.int64) <= self.radius
            yield from zip((window[close] + at).tolist(), item[close].tolist(), strict=True)


def stretches(texts: list[str | None], digests: WordDigests, marks: np.ndarray, sizes: list[int], threshold: float, whole: bool) -> Iterator[tuple[int, int, int, bool, list[str]]]:
    """``(text, shingle length, first token, whether that is all, tokens)`` of stretches whose windows hold enough marked shingles for some item."""
    parts = [tokens(x) for x in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    ends = counts.cumsum()
    values = digests.of([w for p in parts for w in p])
    for k in sorted({min(SHINGLE, n) for n in sizes}):
        widths = [n - k + 1 for n in sizes if min(SHINGLE, n) == k]
        shingles = window_digests(values, k)
        maybe = np.flatnonzero(marks[_places(shingles, k)]) if len(shingles) else np.empty(0, np.int64)
        whose = np.searchsorted(ends, maybe, "right")
        inside = maybe + k <= ends[whose] if len(maybe) else maybe  # not across two texts
        maybe, whose = maybe[inside], whose[inside]
        least: dict[int, float] = {}  # by a text's shingles, as far as they matter
        text, first, count = np.unique(whose, return_index=True, return_counts=True)
        for t, f, c in zip(text.tolist(), first.tolist(), count.tolist(), strict=True):
            n = int(counts[t]) - k + 1
            own = min(n, max(widths))
            if own not in least:
                least[own] = min((needed(w, threshold, min(w, own)) for w in widths if whole or w <= own), default=np.inf)
            if c < least[own]:
                continue
            flags = np.zeros(n + 1, np.int64)
            flags[maybe[f : f + c] - int(ends[t] - counts[t]) + 1] = 1
            upto, edge = flags.cumsum(), np.zeros(len(parts[t]) + 1, np.int64)
            for wanted in widths:
                width = min(wanted, n)
                if width == wanted or whole:
                    starts = np.flatnonzero(upto[width:] - upto[:-width] >= needed(wanted, threshold, width))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + width + k - 1, -1)
            covered = np.concatenate(([0], edge[:-1].cumsum() > 0, [0]))
            turns = np.flatnonzero(np.diff(covered))
            for low, high in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                yield t, k, low, high - low == len(parts[t]), parts[t][low:high]


def matches(items: Items, digests: WordDigests, words: list[str], k: int, all_: bool, threshold: float, whole: bool) -> Iterator[tuple[int, int | None, float, int, int]]:
    """``(item's number, item_id, similarity, first word, words)``: the best window of every item that reaches the threshold in a stretch."""
    shingles = window_digests(digests.of(words), k)
    for size, group in items.by_size.items():
        wanted = size - k + 1
        width = min(wanted, len(shingles))
        if min(SHINGLE, size) != k or width < wanted and not (whole and all_):
            continue
        chosen: dict[int, tuple[float, int]] = {}
        for start, i in items.candidates(size, prints(shingles, np.arange(len(shingles) - width + 1), width)):
            inside = Counter(shingles[start : start + width].tolist())
            both = sum(min(c, inside[s]) for s, c in group[i][2].items())
            similarity = both / (wanted + width - both)
            if similarity >= threshold and (i not in chosen or similarity > chosen[i][0]):
                chosen[i] = (similarity, start)
        for i, (similarity, start) in chosen.items():
            yield group[i][0], group[i][1], similarity, start, min(size, len(words))


def _blocks(benchmark: DataFrame, characters: int) -> Iterator[list[tuple[int, int | None, str | None]]]:
    """Numbered items from the driver's iterator, a stated number of characters and items at a time."""
    block, held = [], 0
    for no, row in enumerate(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator()):
        block.append((no, row[0], row[1]))
        held += len(row[1])
        if held >= characters or len(block) >= BLOCK_ITEMS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _marks(benchmark: DataFrame) -> tuple[bytes, list[int]]:
    """The bitmap of items' shingles, one bit for each value, and the different sizes of items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = WordDigests()
        for frame in batches(frames):
            for words in map(tokens, frame["text"]):
                if words:
                    k = min(SHINGLE, len(words))
                    yield pd.DataFrame({"size": len(words), "place": np.unique(_places(window_digests(digests.of(words), k), k))})

    found = cut(benchmark.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "size int, place long").distinct())
    part, bit = F.shiftright("place", 15).alias("part"), F.col("place").bitwiseAND(F.lit(32_767))
    out = np.zeros((1 << MARKED) // 8, np.uint8)
    for at, own in found.groupBy(part).agg(F.bitmap_construct_agg(bit)).collect():
        out[at * 4096 : at * 4096 + len(own)] = np.frombuffer(bytes(own), np.uint8)
    return out.tobytes(), sorted(r[0] for r in found.select("size").distinct().collect())


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, radius: int, block_characters: int, whole: bool) -> DataFrame:
    """Rows of ``_MATCH``: the best window of each item in each stretch."""
    spark = docs.sparkSession
    bitmap, sizes = _marks(benchmark)
    held = spark.sparkContext.broadcast(bitmap)

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, digests = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool), WordDigests()
        for frame in batches(frames):
            texts = frame["text"].tolist()
            rows = [(t, hashlib.sha256(texts[t].encode("utf-8", "surrogatepass")).digest(), k, first, all_, " ".join(words)) for t, k, first, all_, words in stretches(texts, digests, marks, sizes, threshold, whole)]
            if rows:
                t, digest, k, first, all_, words = map(list, zip(*rows, strict=True))
                yield pd.DataFrame({"rid": frame["rid"].to_numpy()[t], "doc_id": frame["doc_id"].astype("Int64").array[t], "digest": digest, "k": k, "first": first, "all": all_, "tokens": words})

    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = cut(own.mapInPandas(narrow, _STRETCH)) if sizes else spark.createDataFrame([], _STRETCH)
    found = spark.createDataFrame([], _MATCH)
    for block in _blocks(benchmark, block_characters):
        sent = spark.sparkContext.broadcast(block)

        def verify(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items, digests = Items(sent.value, radius), WordDigests()
            for frame in frames:
                rows = [(r.rid, r.digest, no, r.doc_id, item, similarity, r.first + start, n) for r in frame.astype({"doc_id": "Int64"}).itertuples() for no, item, similarity, start, n in matches(items, digests, r.tokens.split(" "), r.k, r.all, threshold, whole)]
                if rows:
                    columns = dict(zip([c.split()[0] for c in _MATCH.split(", ")], zip(*rows, strict=True), strict=True))
                    yield pd.DataFrame(columns | {c: pd.array([None if pd.isna(x) else int(x) for x in columns[c]], "Int64") for c in ("doc_id", "item_id")})

        found = found.unionByName(left.mapInPandas(verify, _MATCH))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 68, block_characters: int = BLOCK_CHARACTERS, whole: bool = False) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)`` for every document and item that match; the best window of each."""
    found = _found(docs, benchmark, threshold, radius, block_characters, whole)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    best = F.max_by(F.struct(*names), F.struct("similarity", -F.col("first_word")))
    return found.groupBy("rid", "no").agg(best.alias("best")).select("best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 68, block_characters: int = BLOCK_CHARACTERS, whole: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Whether a text holds an item depends on the text alone, so rows go by the SHA-256 of it: few
    enough of them for the planner to broadcast unless much of the corpus is contaminated.
    """
    name = fresh(docs, "digest")
    bad = cut(_found(docs, benchmark, threshold, radius, block_characters, whole).select(F.lower(F.hex("digest")).alias(name)).distinct())
    return docs.join(bad, F.sha2(F.col("text").cast("string"), 256) == F.col(name), "left_anti")

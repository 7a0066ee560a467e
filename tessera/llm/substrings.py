"""Removal of long passages that an earlier document has, by prefix-partitioned suffix trees.

Two passages of ``length`` words are equal if and only if their suffixes share an internal
node of that depth.  The tree over all suffixes is never built; groups of it are.

1. Sampling.  Every window of ``length`` words holds an anchor, its smallest 16-word digest
   (the leftmost among equals).  Equal windows have equal anchors at equal places, so the
   suffixes that start at anchors stand for all others, and an anchor that no second
   document has leaves with all its windows.  Digests choose groups; they never decide
   that words are equal.
2. Partition.  A row is a bundle: the neighbouring windows of a document that have one
   anchor, with their words.  Its suffix is dealt out by the prefix that all its windows
   share, at first the 16 words of the anchor.  A group of more than ``group_limit`` bundles
   is too large for a task: its equal bundles become one row with their smallest and
   largest document, and it is dealt out anew by longer prefixes, each for a part of the
   windows, up to the whole ``length`` words.  A group that is still too large has one word
   sequence only; its smallest document comes from an aggregation.
3. Subtrees.  A task sorts its groups' suffixes by their words, to the right from the
   anchor and to the left of it, and takes the lengths of common prefixes of neighbours.
   Runs of neighbours with a common prefix of ``d`` words are the leaves of the internal nodes
   of depth ``d``.  Two windows that start ``o`` words before their anchors are equal if
   they are below one node of depth ``length - o`` on the right and one of depth ``o`` on the left.
4. A window whose node has a smaller document marks its ``length`` words; marked words go.
   Nodes are judged on the input.

Equality is decided by the words themselves.  Equal bundles of a group that is too large
are joined by a 256-bit cryptographic digest of their words.

Null and empty texts and those of fewer than ``length`` words lose nothing.  Rows with a
null doc_id have no order: they lose nothing and take nothing from others.  Rows that
repeat a doc_id are taken for the same document and don't take from each other; each
loses by its own text.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WordDigests, batches, encoded, signed, sliding_argmin, window_digests
from tessera.plans.lineage import cut

ANCHOR = 16
#: Characters of text that are read at once, and bundles that a task sorts at once.
PIECE, SORTED = 1_000_000, 4_000
#: Parts into which the copies of a bundle are dealt.
SALTS = 16
#: Documents that loses by text, and what a bundle's windows are: n of them, the first at each of the words in ``at``, the anchor ``back`` words on.
_OF_DOC = "doc_id long, mark long"
_BUNDLE = f"{_OF_DOC}, prefix long, at array<int>, back int, n int, words binary"
#: A bundle of a subtree: ``low`` and ``high`` are the smallest and largest document that have it, ``first`` its first window's place in the row ``bundle``.
_LEAF = "prefix long, bundle binary, first int, back int, n int, words binary, low long, high long"
_STARTS = "array<struct<at:array<int>,windows:array<struct<at:int,run:int>>>>"
_HITS = "bundle binary, at int, run int, least long"

_DIGESTS = WordDigests()


def _anchors(words: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all ``anchor``-word windows, and for every window of ``length`` words the place of its anchor."""
    short = window_digests(words, anchor)
    return short, sliding_argmin(short, length - anchor + 1)


def _anchor_rows(length: int, anchor: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, PIECE):
            whose, found, times = [], [], []
            for i, text in enumerate(frame["text"]):
                words = encoded(text).split()
                if len(words) >= length:
                    short, place = _anchors(_DIGESTS.of(words), length, anchor)
                    own, n = np.unique(short[np.unique(place)], return_counts=True)
                    found.append(own)
                    times.append(n)
                    whose.append(np.full(len(own), i))
            if found:
                whose = np.concatenate(whose)
                yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[whose], "mark": frame["mark"].to_numpy()[whose], "anchor": signed(np.concatenate(found)), "times": np.concatenate(times).astype(np.int32)})

    return run


def bundles(text: str | None, wanted: np.ndarray, length: int, anchor: int) -> Iterator[tuple[int, list[int], int, int, bytes]]:
    """``(prefix, at, back, n, words)`` of the bundles of a text whose anchor is wanted; equal ones are one with several places."""
    words = encoded(text).split()
    if len(words) < length:
        return
    short, place = _anchors(_DIGESTS.of(words), length, anchor)
    edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
    held = np.isin(signed(short)[place[edges[:-1]]], wanted)
    seen: dict[bytes, tuple[int, list[int], int, int]] = {}
    for low, high in zip(edges[:-1][held].tolist(), edges[1:][held].tolist(), strict=True):
        said = b" ".join(words[low : high - 1 + length])
        if said in seen:
            seen[said][1].append(low)
        else:
            at = int(place[low])
            seen[said] = (int(short[at].view(np.int64)), [low], at - low, high - low)
    for said, (prefix, at, back, n) in seen.items():
        yield prefix, at, back, n, said


def _bundle_rows(length: int, anchor: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, PIECE):
            rows = [(doc, mark, *b) for doc, mark, text, wanted in zip(frame["doc_id"], frame["mark"], frame["text"], frame["anchors"], strict=True) for b in bundles(text, np.asarray(wanted, np.int64), length, anchor)]
            for at in range(0, len(rows), SORTED):
                yield pd.DataFrame(rows[at : at + SORTED], columns=["doc_id", "mark", "prefix", "at", "back", "n", "words"])

    return run


def _common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows, and for each row in that order the length of the prefix that it shares with the row before."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    held = rows[order]
    differ = np.concatenate((held[1:] != held[:-1], np.ones((len(held) - 1, 1), bool)), axis=1)
    return order, np.concatenate(([0], differ.argmax(axis=1)))


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the internal node of this depth above it."""
    opens = common < depth
    opens[0] = True
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(opens)
    return out


def deep_nodes(words: list[bytes], back: np.ndarray, n: np.ndarray, low: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of bundles, the smallest document below their node: ``(row, window in the row, document)``, a distance from the anchor at a time."""
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in said.split()] for said in words]
    widest = int(back.max(initial=0))
    right, left = np.full((len(words), length), -1, np.int32), np.full((len(words), widest), -1, np.int32)
    for i, (own, b) in enumerate(zip(coded, back.tolist(), strict=True)):
        after = own[b : b + length]
        right[i, : len(after)] = after
        left[i, :b] = own[:b][::-1]
    ahead, behind = _common(right), _common(left)
    for o in range(int((back - n).min(initial=0)) + 1, widest + 1):
        rows = np.flatnonzero((back >= o) & (back - o < n))
        if len(rows):
            node = _nodes(*ahead, length - o)[rows] * (len(words) + 1) + _nodes(*behind, o)[rows]
            _, which = np.unique(node, return_inverse=True)
            least = np.full(which.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, low[rows])
            yield rows, back[rows] - o, least[which]


def _subtrees(length: int):
    """Rows sorted by prefix to windows that a smaller document has, neighbours with one smallest document as a run."""

    def hits(frame: pd.DataFrame) -> pd.DataFrame | None:
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        found = []
        for rows, window, least in deep_nodes(frame["words"].tolist(), frame["back"].to_numpy(), frame["n"].to_numpy(), low, length):
            later = least < high[rows]
            found.append((rows[later], window[later], least[later]))
        if not found:
            return None
        rows, window, least = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(rows):
            return None
        order = np.lexsort((window, rows))
        rows, window, least = rows[order], window[order], least[order]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1]))))
        run = np.diff(np.append(first, len(rows)))
        return pd.DataFrame({"bundle": frame["bundle"].to_numpy()[rows[first]], "at": (frame["first"].to_numpy()[rows[first]] + window[first]).astype(np.int32), "run": run.astype(np.int32), "least": least[first]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= SORTED:
                whole = pd.concat(held, ignore_index=True)
                done = int(np.searchsorted(whole["prefix"].to_numpy(), whole["prefix"].iloc[-1]))  # the last group may go on
                held = [whole.iloc[done:]]
                if done and (found := hits(whole.iloc[:done])) is not None:
                    yield found
        if held and (found := hits(pd.concat(held, ignore_index=True))) is not None:
            yield found

    return run


def _parts(width: int, length: int):
    """Bundles to parts of ``width`` windows, each with the longer prefix that all windows of the part share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for bundle, first, back, n, said, low, high in zip(frame["bundle"], frame["first"], frame["back"], frame["n"], frame["words"], frame["low"], frame["high"], strict=True):
                words = said.split()
                for part in range((back - n + 1) // width, back // width + 1):
                    far, near = min(back, (part + 1) * width - 1), max(back - n + 1, part * width)  # words before the anchor
                    shared = words[max(back - part * width, 0) : back - (part + 1) * width + 1 + length]
                    prefix = xxhash.xxh64_intdigest(b" ".join(shared), part) - (1 << 63)
                    rows.append((prefix, bundle, first + back - far, far, far - near + 1, b" ".join(words[back - far : back - near + length]), low, high))
            for at in range(0, len(rows), SORTED):
                yield pd.DataFrame(rows[at : at + SORTED], columns=["prefix", "bundle", "first", "back", "n", "words", "low", "high"])

    return run


def _sized(rows: DataFrame, limit: int) -> DataFrame:
    """Prefixes that more than one document has, and whether their group is too large for a task; written out, so that joins can split a hot prefix."""
    sizes = rows.groupBy("prefix").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("rows"))
    return cut(sizes.where("least < most").select("prefix", "least", (F.col("rows") > limit).alias("large")))


def _walked(rows: DataFrame, length: int) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInPandas(_subtrees(length), _HITS)


def _large_groups(rows: DataFrame, length: int, anchor: int, limit: int) -> DataFrame:
    """``_HITS`` of distinct bundles whose groups are too large, by longer and longer prefixes."""
    found: DataFrame | None = None
    width = length - anchor + 1
    while True:
        width = -(-width // 3)
        rows = cut(rows.mapInPandas(_parts(width, length), _LEAF))
        sizes = _sized(rows, limit)
        small = rows.join(sizes.where("not large").select("prefix"), "prefix", "left_semi").select(*rows.columns)
        hits = cut(_walked(small, length))
        found = hits if found is None else found.unionByName(hits)
        if width == 1:
            same = rows.join(sizes.where("large").select("prefix"), "prefix", "left_semi").select(*rows.columns)
            least = cut(same.groupBy("prefix", "words").agg(F.min("low").alias("least")))
            return found.unionByName(same.join(least, ["prefix", "words"]).where("least < high").select("bundle", F.col("first").alias("at"), F.lit(1).alias("run"), "least"))
        rows = cut(rows.join(sizes.where("large").select("prefix"), "prefix", "left_semi").select(*rows.columns))
        if rows.isEmpty():
            return found


def repeated_passages(docs: DataFrame, length: int = 50, group_limit: int = 1000) -> DataFrame:
    """``(doc_id, mark, starts)``: bundles with windows that a smaller document has too, as places ``at`` and runs of windows from there; ``mark`` tells the text."""
    anchor = min(ANCHOR, length)
    named = _named(docs)
    rows = cut(named.mapInPandas(_anchor_rows(length, anchor), f"{_OF_DOC}, anchor long, times int"))
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("times").alias("times")).where("least < most")
    shared = cut(shared.select("anchor", (F.col("times") > group_limit).alias("large")))  # written out, so that the join can split a hot anchor
    of_doc = cut(rows.join(shared, "anchor").groupBy("doc_id", "mark", "large").agg(F.collect_list("anchor").alias("anchors")))

    def below(large: bool) -> DataFrame:
        wanted = of_doc.where(F.col("large") == F.lit(large)).select("doc_id", "mark", "anchors")
        return named.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "anchors").mapInPandas(_bundle_rows(length, anchor), _BUNDLE)

    # bundles in groups of bounded size: the place and document travel as the bundle's name
    name = F.to_binary(F.to_json(F.struct("doc_id", "mark", "at")), F.lit("utf-8"))
    small = below(False).select("prefix", name.alias("bundle"), F.lit(0).alias("first"), "back", "n", "words", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))
    own = F.from_json(F.col("bundle").cast("string"), "doc_id long, mark long, at array<int>")
    hits = _walked(small, length).select(own.alias("own"), F.array(F.struct("at", "run")).alias("windows")).select("own.doc_id", "own.mark", "own.at", "windows")
    if not shared.where("large").isEmpty():
        often = cut(below(True).withColumn("bundle", F.unhex(F.sha2("words", 256))))
        distinct = often.groupBy("prefix", "bundle").agg(F.first("back").alias("back"), F.first("n").alias("n"), F.first("words").alias("words"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        distinct = cut(distinct.select("prefix", "bundle", F.lit(0).alias("first"), "back", "n", "words", "low", "high"))
        # the windows of one bundle, so that a copy of it is one row however many smallest documents they have
        found = _large_groups(distinct, length, anchor, group_limit).groupBy("bundle").agg(F.collect_list(F.struct("at", "run", "least")).alias("windows"), F.min("least").alias("least"))
        # dealt out by salt, as one bundle may be in any number of documents
        found = cut(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        copies = often.select("doc_id", "mark", "bundle", "at", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        joined = copies.join(found, ["bundle", "salt"]).where("least < doc_id")
        own = F.transform(F.filter("windows", lambda w: w["least"] < F.col("doc_id")), lambda w: F.struct(w["at"].alias("at"), w["run"].alias("run")))
        hits = hits.unionByName(joined.select("doc_id", "mark", "at", own.alias("windows")))
    return hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "windows")).alias("starts"))


def _pair(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("mark", F.xxhash64("text"))


def _named(docs: DataFrame) -> DataFrame:
    return _pair(docs).where("doc_id is not null")


def without(text: str | None, starts, length: int) -> tuple[int, int, bytes]:
    """How many words a text has, how many of them its bundles' windows cover, and the others joined by a space."""
    words = encoded(text).split()
    if starts is None or not len(starts) or not words:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    at, run = np.array([(place + w["at"], w["run"]) for bundle in starts for place in bundle["at"] for w in bundle["windows"]], np.int64).T
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + run - 1 + length, len(words)), -1)
    keep = np.flatnonzero(edge[:-1].cumsum() == 0)
    return len(words), len(words) - len(keep), b" ".join([words[i] for i in keep.tolist()])


def _without(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, PIECE):
            rows = [without(text, starts, length) for text, starts in zip(frame["text"], frame["starts"], strict=True)]
            total, removed, kept = zip(*rows, strict=True)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": total, "n_removed": removed, "text": [k.decode("utf-8", "surrogatepass") for k in kept]})

    return run


def remove_repeated_passages(docs: DataFrame, length: int = 50, group_limit: int = 1000) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: kept words of every row, joined by one space."""
    schema = "doc_id long, n_words long, n_removed long, text string"
    found = repeated_passages(docs, length, group_limit)
    named = _named(docs).join(found, ["doc_id", "mark"], "left").mapInPandas(_without(length), schema)
    unnamed = _pair(docs).where("doc_id is null").withColumn("starts", F.lit(None).cast(_STARTS)).mapInPandas(_without(length), schema)
    return named.unionByName(unnamed)

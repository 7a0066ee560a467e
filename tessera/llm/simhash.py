"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in at most two.  A map sends the 64 bit places
to non-zero vectors of three bits, nine or ten places to each; for each of the seven vectors ``v``
the mask of table ``v`` keeps the places whose vector has an odd product with ``v``, 36 or 37 of
them.  The vectors of any two places span at most two of three dimensions, so some ``v`` is
orthogonal to both: two fingerprints that differ in those places agree under that mask.
Every linked pair therefore meets in a bucket of some table (Pagh's construction).

Most buckets hold a few fingerprints, whatever the corpus: 2**36 values for each table leave
chance meetings rare.  Up to ``SMALL`` of them are compared in one row.  A larger one, of
near copies, may hold thousands, so its pairs are never listed.  Inside a bucket two
fingerprints can differ only in places that the mask drops; each member emits itself and
its one-bit variants in those places, and members that emit the same value are within
two bits.  All of them hang below the smallest document of that value.

Null and empty texts have fingerprint zero, linked like any other.  Rows with a null
doc_id get a fingerprint and the component of their fingerprint, but never name one.
Rows that repeat a doc_id are the same document.  Columns besides doc_id and text are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import batches, encoded
from tessera.operators.components import connected_components
from tessera.plans.lineage import cut

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints of a bucket that are compared in one row.
SMALL = 32


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``size``-word shingles of a text, A to Z lowered."""
    words = encoded(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        part = [digest(line[a:b], 42) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        values = np.array([fingerprint(x) for x in frame["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": values.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with one row per input row; ``fp`` is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_fingerprints, "doc_id long, fp long")


def covering_masks(radius: int = 2, bits: int = 64, seed: int = 5) -> list[int]:
    """The ``2**(radius+1) - 1`` masks of the covering construction, as signed longs."""
    draw = random.Random(seed)
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    draw.shuffle(vectors)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _signed_bit(place: int) -> int:
    return (1 << place) - (1 << 64) if place == 63 else 1 << place


def similar_links(distinct: DataFrame) -> DataFrame:
    """``(src, dst)`` stars over the ``rep`` column of ``(fp, rep)`` rows with distinct ``fp``.

    Two rows are connected by stars if and only if a path of fingerprints joins them whose
    steps differ in one or two bits.
    """
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(masks)])
    placed = distinct.select("fp", "rep", F.inline(tables))
    # buckets and hubs are written out, so that joins with them can split large ones
    shared = cut(placed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("table", "bucket", (F.col("members") > SMALL).alias("large")))
    inside = placed.join(shared, ["table", "bucket"])
    few = inside.where("not large").groupBy("table", "bucket").agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
    near = F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x.fp ^ y.fp) <= 2), y -> struct(greatest(x.rep, y.rep) as src, least(x.rep, y.rep) as dst))))")
    direct = few.select(F.inline(near))
    members = inside.where("large").select("fp", "rep", "table")
    flips = F.array(*[F.array(*[F.lit(f) for f in [0, *(_signed_bit(i) for i in range(64) if not (m >> i) & 1)]]) for m in masks])
    variants = members.select("rep", F.col("fp"), F.explode(flips[F.col("table")]).alias("flip")).select("rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    variants = cut(variants)
    hubs = cut(variants.groupBy("value").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").select("value", "hub"))
    by_hub = variants.join(hubs, "value").where("rep <> hub").select(F.col("rep").alias("src"), F.col("hub").alias("dst"))
    return direct.unionByName(by_hub).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every input row."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = cut(distinct.where("rep is not null"))
    components = connected_components(similar_links(named))
    labelled = cut(distinct.join(components.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Rows with a null doc_id can't be told from each other or named as a copy: they stay.
    """
    keep = near_duplicates(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))

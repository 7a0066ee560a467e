"""Line dedup over line-ID sequences, in DataFrame operations only.

The corpus is read as sequences of line IDs, one per document, without blank lines; a
line's ID is a pair of 64-bit digests of its text.

1. Suffix array.  Suffixes are ordered by prefix doubling: round ``k`` turns the ranks of two
   neighbouring stretches of ``2**k`` lines into the rank of ``2**(k+1)`` lines.  Distinct pairs
   are sorted by range and numbered in that order, so ranks keep the order of the
   sequences and suffixes of one rank are neighbours in the suffix array.  Rounds go on until
   no stretch is shared, so there are as many as the longest repeated run asks for.
   Only distinct pairs are sorted, so a line that a third of the corpus has is one row there,
   and a suffix whose rank nobody shares leaves, as no longer prefix of it is shared.
2. Intervals.  The suffixes of one rank at depth ``d`` are an interval of the suffix array whose
   common prefixes have ``d`` lines or more.  Its first member by (document, line) is the first
   copy, found while the interval is numbered; all others are later copies of ``d`` lines.
   Depths are the powers of two, and below ``min_words`` every other one as well (named by
   two ranks that overlap), where a line more or less decides if a run has enough words.
3. Maximal runs.  The deepest interval in which a suffix isn't first tells how far it repeats
   earlier text; these stretches overlap along a copy, so that the furthest end of all that
   start at a line or before says whether the line lies in a maximal repeated run.

A run counts from ``min_words`` words on; its lines are deleted from later copies.  Intervals
are judged on the input.  What is left of a document is its other lines, blank ones included.

Null and empty texts have no lines and stay as they are.  Rows with a null doc_id have no
place in the order: they stay whole and nothing is removed for their sake.  Rows that
repeat a doc_id are one document: equal rows lose and keep the same lines (of unequal
rows the lines are read as one sequence by their places).  Extra columns stay, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tessera.llm.words import fresh
from tessera.plans.lineage import cut, drop

_SPACES = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc, line, h1, h2, words)``: non-blank lines with their place in the text; words are counted up to ``min_words``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    exploded = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    first = F.filter(F.split("body", _SPACES, min_words + 1), lambda w: w != "")
    counted = exploded.withColumn("words", F.least(F.size(first), F.lit(min_words))).where("words > 0")
    return counted.select("doc", "line", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), F.col("body")).alias("h2"), "words").repartition("doc").distinct()


def _placed(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds ``seq``, and ``need``: how many lines from here have ``min_words`` words, and ``then``: the same of the next line (null: too few follow)."""
    numbered = lines.withColumn("seq", F.row_number().over(W.partitionBy("doc").orderBy("line", "h1")))
    words = [F.col("words"), *[F.lead("words", s).over(_here()) for s in range(1, min_words)]]
    totals = [reduce(lambda a, b: a + b, words[: s + 1]) for s in range(min_words)]
    need = F.coalesce(*[F.when(t >= min_words, F.lit(s + 1)) for s, t in enumerate(totals)])
    sized = numbered.withColumn("need", need)
    return sized.withColumn("then", F.lead("need").over(_here())).drop("words")


def _intervals(rows: DataFrame, *name: str) -> DataFrame:
    """``name, first``: the first copy in each interval of several suffixes."""
    grouped = rows.groupBy(*name).agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").select(*name, "first")


def _ranked(rows: DataFrame, *name: str) -> DataFrame:
    """Intervals numbered in the order of their names; written out, so that the join with them can split a hot one."""
    return cut(_intervals(rows, *name).orderBy(*name).select(*name, "first", F.monotonically_increasing_id().alias("place")))


def _here() -> WindowSpec:
    return W.partitionBy("doc").orderBy("seq")


def _later() -> Column:
    return F.expr("first.doc <> doc or first.line <> line")


def _found(rows: DataFrame, depth: int) -> DataFrame:
    """``(doc, line, seq, end)``: where the copy from a line ends that is not the first and has enough words."""
    return rows.where(F.col("later") & (F.col("need") <= depth)).select("doc", "line", "seq", (F.col("seq") + depth).alias("end"))


def _overlapping(rows: DataFrame, depth: int, step: int) -> DataFrame:
    """Copies of ``depth`` lines, between ``step`` and twice that, where no shorter ones say the same."""
    ahead = F.lead("rank", depth - step).over(_here())
    named = rows.withColumn("b", F.when(F.lead("seq", depth - step).over(_here()) == F.col("seq") + (depth - step), ahead))
    asked = cut(named.where((F.col("need") <= depth) & F.col("b").isNotNull() & ((F.col("need") == depth) | F.coalesce(F.col("then") >= depth, F.lit(True)))))
    joined = asked.join(cut(_intervals(asked, "rank", "b")), ["rank", "b"])
    return _found(joined.withColumn("later", _later()), depth)


def repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``(doc, lines)``: places in the text of the lines that belong to a later copy of a run."""
    lines = cut(_lines(docs, min_words))
    kept = ("doc", "line", "seq", "need", "then", "rank", "later")
    own = _placed(lines, min_words)
    current = cut(own.join(_ranked(lines, "h1", "h2"), ["h1", "h2"]).withColumn("later", _later()).withColumnRenamed("place", "rank").select(*kept))
    # later copies of single lines: what may be deleted, if a long enough run goes over them
    found = [current.where("later").select("doc", "line", "seq", F.when(F.col("need") <= 1, F.col("seq") + 1).otherwise(F.col("seq")).alias("end"))]
    step = 1
    while True:
        found += [_overlapping(current, depth, step) for depth in range(step + 1, min(2 * step, min_words + 1))]
        ahead = F.when(F.lead("seq", step).over(_here()) == F.col("seq") + step, F.lead("rank", step).over(_here()))
        pairs = cut(current.select("doc", "line", "seq", "need", "then", "rank", ahead.alias("b")).where("b is not null"))
        ranks = _ranked(pairs, "rank", "b")
        current = cut(pairs.join(ranks, ["rank", "b"]).withColumn("later", _later()).withColumn("rank", F.col("place")).select(*kept))
        drop(pairs)
        step *= 2
        if current.isEmpty():
            break
        found.append(_found(current, step))
    copies = reduce(DataFrame.unionByName, found).repartition("doc").groupBy("doc", "seq").agg(F.min("line").alias("line"), F.max("end").alias("end"))
    reach = F.max("end").over(_here().rowsBetween(W.unboundedPreceding, W.currentRow))
    return copies.withColumn("reach", reach).where("reach > seq").groupBy("doc").agg(F.collect_set("line").alias("lines"))


def line_dedup(docs: DataFrame, min_words: int = 5, lines: str = "__lines", removed: str = "__removed") -> DataFrame:
    """All rows and columns of ``docs`` with later copies deleted from ``text``, plus ``lines`` (non-blank ones) and ``removed``, which take the place of columns of their names."""
    doc, gone = fresh(docs, "doc"), fresh(docs, "gone")
    found = repeated_lines(docs, min_words).select(F.col("doc").alias(doc), F.col("lines").alias(gone))
    joined = docs.drop(lines, removed).join(found, F.col("doc_id").cast("long") == F.col(doc), "left")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    kept = F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text").cast("string")).otherwise(kept)
    own = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in (lines, removed)]
    return joined.select(*own, n_lines.alias(lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))

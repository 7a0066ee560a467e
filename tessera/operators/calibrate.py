"""Grouped distributions of features: exact percentiles of each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def calibrate(features: DataFrame, by: list[str], metrics: list[str], min_docs: int = 20, min_words: int = 0) -> DataFrame:
    """One row for each group and metric, with document and word totals and six percentiles.

    Documents of fewer than ``min_words`` words are counted apart and measured nowhere.
    Cells that aren't numbers are ignored; a group without numbers gives zeros.
    """
    missing = [c for c in by if c not in features.columns]
    if missing:
        raise ValueError(f"no columns to group by: {', '.join(missing)}")
    words = F.coalesce(F.col("words").cast("long"), F.lit(0))
    long = words >= min_words
    stats = [F.count_if(long).alias("documents"), F.coalesce(F.sum(F.when(long, words)), F.lit(0)).alias("words_total"), F.count_if(~long).alias("excluded_short_documents")]
    each = [F.percentile(F.when(long, F.col(m).try_cast("double")), F.array(*[F.lit(q) for q in QUANTILES.values()])).alias(f"q_{m}") for m in metrics]
    wide = features.groupBy(*by).agg(*stats, *each)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"q_{m}").alias("q")) for m in metrics])
    tall = wide.select(*by, "documents", "words_total", "excluded_short_documents", (F.col("documents") >= min_docs).alias("sufficient"), F.inline(rows))
    return tall.where("documents > 0").select(*by, "documents", "words_total", "excluded_short_documents", "sufficient", "metric", *[F.coalesce(F.bround(F.get("q", F.lit(i)), 4), F.lit(0.0)).alias(p) for i, p in enumerate(QUANTILES)])


def alert_burden(findings: DataFrame, documents: DataFrame, version: str = "version", key: str = "doc_id", n: str | None = None) -> DataFrame:
    """Findings per thousand words and their spread over documents, for each version of a checker.

    ``documents`` has ``key`` and ``words``; ``findings`` has ``version, key, level, code``, and ``n`` may
    name the column that says how many findings a row stands for.
    """
    times = F.col(n) if n else F.lit(1).cast("long")
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, times)), F.lit(0))
    totals = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    counted = findings.groupBy(version).agg(F.sum(times).alias("findings"), F.count_distinct(key).alias("documents_with_findings"), of("warning").alias("warnings"), of("info").alias("infos"))
    return counted.crossJoin(F.broadcast(totals)).withColumn("findings_per_1000", F.bround(F.when(F.col("words") > 0, F.col("findings") * 1000.0 / F.col("words")).otherwise(0.0), 4))

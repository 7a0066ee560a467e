"""Evaluation of versions: arm statistics, paired differences, coverage, table comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_rate(summary_rate: Column, passed: Column) -> Column:
    """The stated rate, else the share of passed assertions; null without either."""
    n = F.size(passed)
    return F.coalesce(summary_rate, F.when(n > 0, F.size(F.filter(passed, lambda x: x)) / n))


def valid_runs(runs: DataFrame) -> DataFrame:
    """Adds ``reason``: why a run's grading or timing can't be used, null for good ones."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return runs.withColumn("reason", F.when(F.col("pass_rate").isNull() | F.col("tokens").isNull() | F.col("duration_ms").isNull(), "missing").when(~(finite("pass_rate") & finite("tokens") & finite("duration_ms")), "non_finite").when(~F.col("pass_rate").between(0, 1) | (F.col("tokens") < 0) | (F.col("duration_ms") < 0), "out_of_range"))


def stats(column: str, name: str | None = None) -> list[Column]:
    """Count, mean and population deviation, rounded to six places."""
    name = name or column
    return [F.count(column).alias(f"{name}_count"), F.bround(F.avg(column), 6).alias(f"{name}_mean"), F.bround(F.stddev_pop(column), 6).alias(f"{name}_stddev")]


def arm_stats(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[c for m in metrics for c in stats(m)])


def paired_deltas(runs: DataFrame, current: str, baseline: str, keys: list[str], value: str, arm: str = "arm") -> DataFrame:
    """Differences over runs that both arms completed; published only if all planned pairs are there.

    A run without a value is planned but not completed.
    """
    side = lambda name, v: runs.where(F.col(arm) == name).select(*keys, F.col(value).alias(v))
    both = side(current, "a").join(side(baseline, "b"), keys)
    delta = F.col("a") - F.col("b")
    mean = F.bround(F.avg(delta), 6)
    complete = F.count(F.lit(1)) == F.count(delta)
    return both.agg(F.count(F.lit(1)).alias("planned_pairs"), F.count(delta).alias("paired_runs"), mean.alias("mean"), F.bround(F.stddev_pop(delta), 6).alias("stddev"), complete.alias("complete_pairs"), F.when(complete, mean).alias("published_delta")).select(F.lit(f"{current}_minus_{baseline}").alias("delta"), "*")


def coverage(cases: DataFrame, declared: DataFrame, dimensions: str = "dimensions", case: str = "id") -> DataFrame:
    """``dimension, value, cases, covered`` of each declared value."""
    seen = cases.select(case, F.explode(dimensions).alias("dimension", "value")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("cases"))
    return declared.join(seen, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("cases", F.lit(0)).alias("cases"), F.col("cases").isNotNull().alias("covered"))


def profiles_covered(sources: DataFrame, profiles: str = "profiles", source: str = "id") -> DataFrame:
    """``profile, sources``: the sources that declare each profile, in order; as many values as there are sources."""
    return sources.select(source, F.explode(profiles).alias("profile")).groupBy("profile").agg(F.array_sort(F.collect_set(source)).alias("sources"))


def run_plan(cases: DataFrame, arms: list[str], runs: int, case: str = "case_id") -> DataFrame:
    """Every case in every arm, ``runs`` times: the sizes of the product are the caller's."""
    spark = cases.sparkSession
    grid = spark.createDataFrame([(a,) for a in arms], "arm string").crossJoin(spark.range(1, runs + 1).select(F.col("id").cast("int").alias("run_index")))
    return cases.select(case).crossJoin(F.broadcast(grid))


def compare(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, state``: missing, extra or changed rows of a table that should equal another."""
    rest = [c for c in expected.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*rest, F.lit(1).alias("__one")).alias(name))
    both = pack(expected, "e").join(pack(actual, "a"), keys, "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("e")), "changed")
    return both.select(*keys, state.alias("state")).where("state is not null")


def disjoint(left: DataFrame, right: DataFrame, key: str) -> bool:
    return left.select(key).intersect(right.select(key)).isEmpty()


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def weighted_score(checks: DataFrame) -> DataFrame:
    """Sum of the weights of passed checks: ``weight, ok``."""
    return checks.agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("weight"))), F.lit(0)).alias("score"))

"""Decision protocol: leak-free splits, candidate thresholds, alerts, adjudication, decisions."""

from __future__ import annotations

import random
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicons import ANNOTATION_LABELS, DIVERSITY_GATES, GATES, SIGNALS, STRUCTURE_SIGNALS
from tessera.operators.components import connected_components
from tessera.plans.lineage import cut
from tessera.plans.session import checked_broadcast


def signal_table(spark: SparkSession, signals: Iterable[tuple] = SIGNALS) -> DataFrame:
    names = "signal string, feature string, threshold_key string, direction string, quantile double, hits string, min_hits_key string, rhythm boolean, size_feature string, min_size_key string"
    return spark.createDataFrame([tuple(s) for s in signals], names)


def _lookup(df: DataFrame, name: Column, candidates: list[str]) -> Column:
    """The value of the column whose name stands in ``name``."""
    chosen = F.lit(None).cast("double")
    for c in candidates:
        if c in df.columns:
            chosen = F.when(name == c, F.col(c).cast("double")).otherwise(chosen)
    return chosen


def signal_rows(features: DataFrame, profiles: DataFrame, signals: DataFrame, flags: Iterable[str] = ("calibration_eligible", "lexical_only")) -> DataFrame:
    """Every document with every signal: ``id, profile, signal, words, value, hits, min_hits, old, eligible``, and what else the documents have.

    ``features`` has one row for each document with its ``profile`` name, features and counts.
    """
    settings = profiles.select("profile", *[F.col(c) for c in profiles.columns if c != "profile"])
    df = features.join(checked_broadcast(settings), "profile").crossJoin(checked_broadcast(signals))
    thresholds = [s[2] for s in SIGNALS]
    wide = df.select(
        *features.columns, "signal", "direction", "quantile", "threshold_key",
        _lookup(df, F.col("feature"), [s[1] for s in SIGNALS]).alias("value"),
        F.coalesce(_lookup(df, F.concat(F.lit("n_"), F.col("hits")), ["n_road", "n_jargon"]), F.lit(0.0)).alias("hit_count"),
        F.coalesce(_lookup(df, F.col("min_hits_key"), ["min_road_hits", "min_jargon_hits"]), F.lit(0.0)).alias("min_hits"),
        _lookup(df, F.col("threshold_key"), thresholds).alias("old"),
        (F.coalesce(F.col("calibration_eligible") if "calibration_eligible" in features.columns else F.lit(True), F.lit(True))
         & ~(F.col("signal").isin(*STRUCTURE_SIGNALS) & F.coalesce(F.col("lexical_only") if "lexical_only" in features.columns else F.lit(False), F.lit(False)))
         & (~F.col("rhythm") | F.col("rhythm_checks"))
         & (F.coalesce(_lookup(df, F.col("size_feature"), ["sentences", "paragraphs"]), F.lit(0.0)) >= F.coalesce(_lookup(df, F.col("min_size_key"), ["min_sentences_for_cv", "min_paragraphs_for_ratio"]), F.lit(0.0)))).alias("eligible"),
        (~F.col("rhythm") | F.col("rhythm_checks")).alias("applicable"),
    )
    return wide


def fires(threshold: Column) -> Column:
    """Whether a row of ``signal_rows`` alerts at a threshold; never without one."""
    beyond = F.when(F.col("direction") == "high", F.col("value") >= threshold).otherwise(F.col("value") < threshold)
    return F.coalesce(threshold.isNotNull() & F.col("eligible") & (F.col("hit_count") >= F.col("min_hits")) & beyond, F.lit(False))


def group_tokens(field: str, scoped: bool, source: Column) -> Column:
    """What two rows must share to belong together; null if nothing is known."""
    raw = F.trim(F.col(field))
    known = T.known_label(raw)
    value = F.when(known.isNull(), None).otherwise(known if field == "author_or_group" else raw)
    return F.concat_ws(":", F.lit(field), F.coalesce(F.trim(source), F.lit("unknown-source")), value) if scoped else F.concat_ws(":", F.lit(field), value)


def split_components(rows: DataFrame, key: str, fields: list[str], scoped: list[str], source: str = "source_id") -> DataFrame:
    """``(key, component)``: rows that share any known token are one component, others stand alone.

    Rows hang below the smallest key of each token, so a token of any frequency adds one
    edge for each of its rows.
    """
    each = F.array_compact(F.array(*[F.when(T.known_label(F.trim(F.col(f))).isNotNull(), group_tokens(f, f in scoped, F.col(source))) for f in fields]))
    tokens = rows.select(F.col(key).alias("k"), F.explode(each).alias("token"))
    least = cut(tokens.groupBy("token").agg(F.min("k").alias("least")))  # written out, so that the join can split a hot token
    found = connected_components(tokens.join(least, "token").select(F.col("k").alias("src"), F.col("least").alias("dst")))
    return rows.select(F.col(key).alias("id")).join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("component", "id").alias("component"))


def _folded(rows: pd.DataFrame, by: list[str], fraction: float) -> pd.DataFrame:
    """Whether each component of one group goes to calibration."""
    rows = rows.sort_values("mark")
    docs, words = rows["docs"].sum(), rows["words"].sum()
    far = lambda d, w: abs(d - docs * fraction) / max(docs, 1.0) + abs(w - words * fraction) / max(words, 1.0)
    in_docs, in_words, taken = 0.0, 0.0, []
    for d, w in zip(rows["docs"], rows["words"], strict=True):
        taken.append(far(in_docs + d, in_words + w) <= far(in_docs, in_words))
        if taken[-1]:
            in_docs, in_words = in_docs + d, in_words + w
    return rows[[*by, "component", "mark"]].assign(cal=taken)


def greedy_split(components: DataFrame, by: list[str], fraction: float = GATES["calibration_fraction"], seed: str = GATES["seed"], in_task: int = 100_000) -> DataFrame:
    """``(by.., component, arm)``: components in the order of a seeded digest go to calibration while that brings both sizes nearer.

    ``components`` has ``by, component, docs, words``, one row for each component.  A group of at most
    ``in_task`` components is folded in one task, a larger one in rounds: sizes in calibration only
    grow, so a component that doesn't bring them nearer never will.  A round therefore keeps those
    that would by themselves, adds them up in order (blocks by the digest's leading digits, so
    that no group is one task's), takes all before the first one that doesn't fit any more, and goes
    on behind it.  Rounds follow how often that happens, not the rows.  Either way gives the same arms.
    """
    mark = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(b).cast("string") for b in by], F.col("component").cast("string")), 256)
    every = cut(components.select(*by, "component", mark.alias("mark"), F.col("docs").cast("double").alias("docs"), F.col("words").cast("double").alias("words")))
    counts = cut(every.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("all_docs"), F.sum("words").alias("all_words"), F.lit(0.0).alias("in_docs"), F.lit(0.0).alias("in_words")))
    same = lambda left, right: reduce(lambda x, y: x & y, [left[b].eqNullSafe(right[b]) for b in by])
    few, sizes = counts.where(F.col("n") <= in_task), counts.where(F.col("n") > in_task).drop("n")
    kinds = f"{components.select(*by, 'component')._jdf.schema().toDDL()}, mark string, cal boolean"
    chosen = every.join(few, same(every, few), "left_semi").groupBy(*by).applyInPandas(lambda rows: _folded(rows, by, fraction), kinds)
    if not sizes.isEmpty():
        rows = cut(every.join(sizes, same(every, sizes), "left_semi"))
        chosen = chosen.unionByName(_in_rounds(rows, sizes, by, fraction))
    chosen = cut(chosen)
    ends = cut(chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("cal").alias("in_cal"), F.min("mark").alias("first"), F.max("mark").alias("last")))
    arm = F.when((F.col("n") > 1) & (F.col("in_cal") == F.col("n")) & (F.col("mark") == F.col("last")), "validation").when((F.col("n") > 1) & (F.col("in_cal") == 0) & (F.col("mark") == F.col("first")), "calibration").when(F.col("cal"), "calibration").otherwise("validation")
    return chosen.join(ends, same(chosen, ends)).select(*[chosen[b] for b in by], "component", arm.alias("arm"))


def _in_rounds(rows: DataFrame, sizes: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """The same as ``_folded`` over groups of any size; ``sizes`` has each group's sums and what calibration holds."""
    state = ("all_docs", "all_words", "in_docs", "in_words")
    same = lambda left, right: reduce(lambda x, y: x & y, [left[b].eqNullSafe(right[b]) for b in by])
    far = lambda d, w: F.abs(d - F.col("all_docs") * fraction) / F.greatest(F.col("all_docs"), F.lit(1.0)) + F.abs(w - F.col("all_words") * fraction) / F.greatest(F.col("all_words"), F.lit(1.0))
    nearer = lambda d, w: far(d + F.col("docs"), w + F.col("words")) <= far(d, w)
    block, left, taken = F.left("mark", F.lit(3)), rows, None
    names = [*by, "component", "mark", "docs", "words"]
    while True:
        fits = left.join(sizes, same(left, sizes)).select(*[left[c] for c in names], *state).where(nearer(F.col("in_docs"), F.col("in_words"))).withColumn("block", block)
        fits = cut(fits)
        if fits.isEmpty():
            break
        before = lambda column, *keys: F.coalesce(F.sum(column).over(W.partitionBy(*by, *keys).orderBy("mark" if keys else "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        blocks = fits.groupBy(*by, "block").agg(F.sum("docs").alias("d"), F.sum("words").alias("w")).select(*by, "block", before("d").alias("block_docs"), before("w").alias("block_words"))
        blocks = blocks.select(*[F.col(c).alias(f"of_{c}") for c in (*by, "block")], "block_docs", "block_words")
        placed = fits.join(blocks, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "block")]))
        docs, words = F.col("in_docs") + F.col("block_docs") + before("docs", "block"), F.col("in_words") + F.col("block_words") + before("words", "block")
        tried = placed.withColumn("d", docs).withColumn("w", words).withColumn("fits", nearer(F.col("d"), F.col("w")))
        tried = cut(tried.select(*names, "fits"))
        stops = tried.groupBy(*[F.col(b).alias(f"of_{b}") for b in by]).agg(F.min(F.when(~F.col("fits"), F.col("mark"))).alias("stop"))
        marked = tried.join(stops, reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by])).select(*names, "stop")
        inside = marked.where("stop is null or mark < stop").select(*names)
        taken = inside if taken is None else taken.unionByName(inside)
        left = marked.where("mark > stop").select(*names)
        grown = inside.groupBy(*by).agg(F.sum("docs").alias("d"), F.sum("words").alias("w"))
        sizes = cut(sizes.join(grown, same(sizes, grown), "left").select(*[sizes[b] for b in by], "all_docs", "all_words", (F.col("in_docs") + F.coalesce("d", F.lit(0.0))).alias("in_docs"), (F.col("in_words") + F.coalesce("w", F.lit(0.0))).alias("in_words")))
    if taken is None:
        return rows.select(*by, "component", "mark", F.lit(False).alias("cal"))
    own = taken.select(F.col("mark").alias("m"), F.lit(True).alias("cal"))
    return rows.join(own, F.col("mark") == F.col("m"), "left").select(*by, "component", "mark", F.coalesce("cal", F.lit(False)).alias("cal"))


def candidate_thresholds(rows: DataFrame, by: list[str]) -> DataFrame:
    """``old, observed, candidate`` for each group of eligible rows, by exact interpolated quantile.

    Thresholds counted in words are rounded up.
    """
    both = F.percentile(F.col("value"), F.array(F.lit(0.95), F.lit(0.05)))
    grouped = rows.where("eligible").groupBy(*by).agg(F.first("old").alias("old"), F.first("direction").alias("direction"), F.first("threshold_key").alias("threshold_key"), both.alias("q"))
    observed = F.when(F.col("direction") == "high", F.get("q", F.lit(0))).otherwise(F.get("q", F.lit(1)))
    bound = F.when(F.col("direction") == "high", F.greatest("old", observed)).otherwise(F.least("old", observed))
    return grouped.select(*by, "old", observed.alias("observed"), F.when(F.col("threshold_key").endswith("words_info"), F.ceil(bound).cast("double")).otherwise(bound).alias("candidate"))


def annotation_summary(alerts: DataFrame, annotations: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """Alerts and their labels: counts and the actionable share of decisive ones (null without any)."""
    joined = alerts.join(annotations.select(*on, "label"), on, "left")
    decisive = F.count_if(F.col("label").isin("actionable", "non_actionable"))
    actionable = F.count_if(F.col("label") == "actionable")
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("alerts"), F.count("label").alias("annotated"), decisive.alias("decisive"), actionable.alias("actionable"), F.count_if(F.col("label") == "non_actionable").alias("non_actionable"), F.count_if(F.col("label") == "uncertain").alias("uncertain"), F.when(decisive > 0, F.bround(actionable / decisive, 4)).alias("actionable_precision"))


def unknown_references(annotations: DataFrame, documents: DataFrame, signals: DataFrame, key: str = "document_id") -> DataFrame:
    """Annotations of documents or signals that don't exist."""
    lost = annotations.join(documents.select(key).distinct(), key, "left_anti")
    odd = annotations.join(checked_broadcast(signals.select("signal").distinct()), "signal", "left_anti").select(*annotations.columns)
    return lost.select(*annotations.columns).unionByName(odd).distinct()


def unknown_labels(annotations: DataFrame, allowed: tuple[str, ...] = ANNOTATION_LABELS, label: str = "label") -> DataFrame:
    """Annotations whose label isn't one of the allowed; blank labels say nothing."""
    said = F.trim(F.coalesce(F.col(label), F.lit("")))
    return annotations.where((said != "") & ~said.isin(*allowed))


def conflicting_labels(annotations: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more than one label; blank labels say nothing."""
    return annotations.where(F.coalesce(F.trim("label"), F.lit("")) != "").groupBy(*on).agg(F.count_distinct("label").alias("labels")).where("labels > 1")


def diversity_gate(rows: DataFrame, by: str = "profile", gates: dict[str, tuple] = DIVERSITY_GATES, source: str = "source_id", channel: str = "channel", author: str = "author_or_group", words: str = "words", within: tuple[str, ...] = ()) -> DataFrame:
    """Eight checks of provenance for each profile (and each value of ``within`` in it), and whether all hold."""
    measured, keys = None, [by, *within]
    for kind, column in (("source", source), ("channel", channel), ("author", author)):
        label = T.known_label(F.col(column))
        each = rows.groupBy(*keys, label.alias("l")).agg(F.count(F.lit(1)).alias("d"), F.sum(words).alias("w"))
        known = F.col("l").isNotNull()
        total = lambda c, known=known: F.sum(F.when(known, F.col(c)).otherwise(0))
        ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        top = lambda c, known=known: F.coalesce(F.max(F.when(known, F.col(c))), F.lit(0))
        part = each.groupBy(*keys).agg(F.count_if(known).alias(f"{kind}s"), ratio(total("d"), F.sum("d")).alias(f"{kind}_document_coverage"), ratio(total("w"), F.sum("w")).alias(f"{kind}_word_coverage"), ratio(top("d"), total("d")).alias(f"{kind}_document_share"), ratio(top("w"), total("w")).alias(f"{kind}_word_share"))
        measured = part if measured is None else measured.join(part, keys)
    names = "least_sources int, least_channels int, max_source_documents double, max_source_words double, author_needed boolean, least_author_coverage double, max_author_documents double, max_author_words double"
    table = rows.sparkSession.createDataFrame([(p, *g) for p, g in gates.items()], f"{by} string, {names}")
    df = measured.join(F.broadcast(table), by)
    checks = {
        "source_metadata_coverage": "source_document_coverage >= 1 and source_word_coverage >= 1",
        "channel_metadata_coverage": "channel_document_coverage >= 1 and channel_word_coverage >= 1",
        "minimum_sources": "sources >= least_sources",
        "minimum_channels": "channels >= least_channels",
        "maximum_source_document_share": "source_document_share <= max_source_documents",
        "maximum_source_word_share": "source_word_share <= max_source_words",
        "author_metadata_coverage": "not author_needed or (author_document_coverage >= least_author_coverage and author_word_coverage >= least_author_coverage)",
        "maximum_known_author_concentration": "not author_needed or (author_document_share <= max_author_documents and author_word_share <= max_author_words)",
    }
    shares = [F.bround(c, 4).alias(c) for c in measured.columns if c.endswith(("coverage", "share"))]
    return df.select(*keys, "sources", "channels", "authors", *shares, *[F.expr(v).alias(k) for k, v in checks.items()], F.expr(" and ".join(f"({v})" for v in checks.values())).alias("gate_met"))


def bootstrap_reduction(flags: DataFrame, by: list[str], rounds: int = 2000, order: str = "id") -> DataFrame:
    """Mean and 95 % interval of the alert-rate difference by seeded resampling; ``flags`` has ``by, order, old, candidate``.

    Resampling needs only how often each pair of flags occurs, so a group of any size
    travels as four counts and the draws are multinomial.
    """
    counted = flags.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") & ~F.col("candidate")).alias("lost"), F.count_if(~F.col("old") & F.col("candidate")).alias("won"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        row = rows.iloc[0]
        n = int(row["n"])
        seed = random.Random("|".join(str(row[b]) for b in by)).getrandbits(64)
        draws = np.random.default_rng(seed).multinomial(n, [row["lost"] / n, row["won"] / n, 1 - (row["lost"] + row["won"]) / n], rounds)
        found = np.sort((draws[:, 0] - draws[:, 1]) / n)
        return pd.DataFrame({**{b: [row[b]] for b in by}, "n": [n], "mean": [round(float(found.mean()), 4)], "low": [round(float(found[int(0.025 * (rounds - 1))]), 4)], "high": [round(float(found[int(0.975 * (rounds - 1))]), 4)]})

    kinds = ", ".join(f"{b} {flags.schema[b].dataType.simpleString()}" for b in by)
    return counted.groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean double, low double, high double")


def candidate_decision() -> Column:
    """The candidate ladder over ``evidence_gate, candidate, old, control, removed, removed_decisive, removed_non_actionable``."""
    least = GATES["removed_annotations"]
    share = F.col("removed_non_actionable") / F.col("removed_decisive")
    return (
        F.when(~F.col("evidence_gate"), "blocked_evidence_gate_not_met")
        .when(F.col("candidate") == F.col("old"), "keep_old_candidate_equals_old")
        .when(~F.col("control"), "keep_old_candidate_loses_positive_control")
        .when(F.col("removed") < least, "keep_old_candidate_effect_sample_too_small")
        .when(F.col("removed_decisive") < least, "candidate_blocked_needs_removed_alert_adjudication")
        .when(share >= GATES["removed_non_actionable"], "candidate_supported_on_validation_pending_human_review")
        .otherwise("keep_old_removed_alerts_include_too_many_actionable_cases")
    )


def off_decision() -> Column:
    """The off ladder over ``evidence_gate, alerts, alerts_decisive, alerts_precision``."""
    least = GATES["off_annotations"]
    return (
        F.when(~F.col("evidence_gate"), "off_blocked_evidence_gate_not_met")
        .when(F.col("alerts") < least, "off_not_evaluable_insufficient_natural_alert_sample")
        .when(F.col("alerts_decisive") < least, "off_blocked_needs_alert_adjudication")
        .when(F.col("alerts_precision") <= GATES["off_precision"], "off_supported_by_low_actionable_precision_pending_human_review")
        .otherwise("off_not_supported_signal_has_actionable_natural_alerts")
    )

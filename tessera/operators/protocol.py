"""Evidence behind decisions: gates, global readiness, the first ladder, workflow states, capped selection.

A decision is evaluated for a signal and a profile only where its evidence gate is met: enough
documents and words of the profile and of the signal's eligible rows, provenance that is
diverse enough for both, and enough of each on either side of the split.  All tables here
have one row for each profile, signal or group; rows of documents are only ever counted.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexicons import DIVERSITY_GATES, GATES
from tessera.operators.decisions import diversity_gate


def profile_gates(docs: DataFrame, gates: dict = GATES, diversity: dict[str, tuple] = DIVERSITY_GATES) -> DataFrame:
    """``profile, documents, words, size_gate_met, diversity_met, profile_gate_met`` of documents with ``profile, words`` and provenance."""
    sizes = docs.groupBy("profile").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    enough = (F.col("documents") >= gates["profile_documents"]) & (F.col("words") >= gates["profile_words"])
    diverse = diversity_gate(docs, gates=diversity).select("profile", F.col("gate_met").alias("diversity_met"))
    joined = sizes.join(diverse, "profile", "left").withColumn("diversity_met", F.coalesce("diversity_met", F.lit(False)))
    return joined.select("profile", "documents", "words", enough.alias("size_gate_met"), "diversity_met", (enough & F.col("diversity_met")).alias("profile_gate_met"))


def evidence_gates(rows: DataFrame, arms: DataFrame, profiles_ready: DataFrame, gates: dict = GATES, diversity: dict[str, tuple] = DIVERSITY_GATES) -> DataFrame:
    """Counts and gates of every signal and profile; ``evidence_gate`` is true where all are met.

    ``rows``: ``signal_rows`` with provenance; ``arms``: ``profile, signal, id, arm`` of eligible
    ones; ``profiles_ready``: ``profile_gates``.
    """
    eligible = rows.where("eligible")
    keys = ["profile", "signal"]
    with_arm = eligible.select(*keys, "id", "words").join(arms, [*keys, "id"], "left")
    total = lambda condition, name: [F.count_if(condition).alias(f"{name}_documents"), F.coalesce(F.sum(F.when(condition, F.col("words"))), F.lit(0)).alias(f"{name}_words")]
    counts = with_arm.groupBy(*keys).agg(*total(F.lit(True), "eligible"), *total(F.col("arm") == "calibration", "calibration"), *total(F.col("arm") == "validation", "validation"))
    diverse = diversity_gate(eligible, gates=diversity, within=("signal",)).select(*keys, F.col("gate_met").alias("signal_diversity_met"))
    every = rows.where("applicable").select(*keys).distinct().join(counts, keys, "left").join(diverse, keys, "left").join(profiles_ready.select("profile", "profile_gate_met"), "profile", "left")
    names = [f"{k}_{w}" for k in ("eligible", "calibration", "validation") for w in ("documents", "words")]
    filled = every.na.fill(0, names).na.fill(False, ["signal_diversity_met", "profile_gate_met"])
    enough = lambda name: (F.col(f"{name}_documents") >= gates[f"{name}_documents"]) & (F.col(f"{name}_words") >= gates[f"{name}_words"])
    return filled.select(
        *keys, *names, "profile_gate_met", enough("eligible").alias("signal_gate_met"), "signal_diversity_met",
        (enough("calibration") & enough("validation")).alias("split_gate_met"),
        (F.col("profile_gate_met") & enough("eligible") & F.col("signal_diversity_met") & enough("calibration") & enough("validation")).alias("evidence_gate"),
    )


def readiness(decisions: DataFrame, profiles_ready: DataFrame) -> DataFrame:
    """One row of global flags over ``evidence_gate, candidate_decision, off_decision`` of all applicable signals and profiles."""
    waits = (F.col("candidate_decision") == "candidate_blocked_needs_removed_alert_adjudication") | (F.col("off_decision") == "off_blocked_needs_alert_adjudication")
    signals = decisions.agg(F.coalesce(F.bool_and("evidence_gate"), F.lit(False)).alias("all_applicable_signal_evidence_gates_met"), F.count_if(waits).alias("natural_alert_adjudication_pending"))
    whole = profiles_ready.agg(F.coalesce(F.bool_and("profile_gate_met"), F.lit(True)).alias("all_profile_gates_met"))
    ready = F.col("all_profile_gates_met") & F.col("all_applicable_signal_evidence_gates_met")
    flags = whole.crossJoin(signals).withColumn("ready_for_decision_evaluation", ready)  # one row each
    complete = F.col("ready_for_decision_evaluation") & (F.col("natural_alert_adjudication_pending") == 0)
    return flags.withColumn("natural_alert_adjudication_complete_where_required", complete).withColumn("automatic_policy_update_allowed", F.lit(False))


def first_decision() -> Column:
    """The first ladder over ``eligible_documents, eligible_words, old_alerts, candidate_alerts, control_old, control_candidate``."""
    gate = (F.col("eligible_documents") >= GATES["profile_documents"]) & (F.col("eligible_words") >= GATES["profile_words"])
    return (
        F.when(F.col("eligible_documents") == 0, "no_data_keep_old")
        .when(~gate, "keep_old_freeze_gate_not_met")
        .when((F.col("candidate_alerts") < F.col("old_alerts")) & F.col("control_candidate"), "candidate_eligible_for_activation")
        .when((F.col("old_alerts") == 0) & F.col("control_old"), "keep_old_no_clean_noise_observed")
        .when(~F.col("control_candidate"), "keep_old_candidate_loses_positive_control")
        .otherwise("keep_old_no_measured_gain")
    )


def overall_decision(rows: DataFrame) -> DataFrame:
    """``signal, overall_decision`` over ``signal, old, candidate, freeze_gate_met`` of its profiles."""
    changed = F.col("candidate") != F.col("old")
    each = rows.groupBy("signal").agg(F.bool_or(changed).alias("changed"), F.bool_and(~changed | F.col("freeze_gate_met")).alias("frozen"))
    said = F.when(F.col("changed") & F.col("frozen"), "review_candidate_for_activation").when(F.col("changed"), "do_not_activate_candidate_freeze_gate_not_met").otherwise("keep_old_no_evidence_for_threshold_change")
    return each.select("signal", said.alias("overall_decision"))


#: Exit code and state of the gate's workflow, first failure first; each speaks where its flag is as given.
WORKFLOW = (
    ("frozen_before", False, 4, "blocked_frozen_input_mismatch_before_acquisition"),
    ("manifest", False, 2, "blocked_no_manifest"),
    ("validation_report", False, 2, "blocked_validator_no_report"),
    ("validator_clean", False, 2, "blocked_validator_errors"),
    ("frozen_after_acquisition", False, 4, "blocked_frozen_input_mismatch_after_acquisition"),
    ("profile_stage_ready", False, 3, "profile_freeze_stage_not_met_decision_v3_blocked"),
    ("frozen_after_decision", False, 4, "failed_frozen_input_mismatch_after_decision"),
    ("decision_run", False, 5, "decision_v3_subprocess_failed"),
    ("evidence_ready", False, 6, "profile_freeze_met_v3_evidence_incomplete"),
    ("adjudication_pending", True, 7, "v3_evidence_ready_natural_alert_adjudication_pending"),
)
COMPLETE = (0, "v3_decision_evidence_complete_pending_explicit_policy_review")


def workflow_state() -> Column:
    """``struct<exit_code, status>`` over the flags of ``WORKFLOW``; an unknown flag counts as not met."""
    chosen = F.struct(F.lit(COMPLETE[0]).alias("exit_code"), F.lit(COMPLETE[1]).alias("status"))
    for flag, said, code, status in reversed(WORKFLOW):
        speaks = F.coalesce(F.col(flag) == F.lit(said), F.lit(True))
        chosen = F.when(speaks, F.struct(F.lit(code).alias("exit_code"), F.lit(status).alias("status"))).otherwise(chosen)
    return chosen


def capped_selection(pool: DataFrame, key: str, author: str, year: str, author_caps: tuple[int, ...] = (1, 2, 3, 5), year_cap: int = 5, most: int = 100, page: int = 1000) -> DataFrame:
    """``most`` rows at most in the order of their keys' digests, while no author and no year has too many; the author's cap widens from pass to pass.

    Only what may still be chosen is asked for, a page in order at a time, so the driver holds
    ``page`` keys and the choice itself, whatever the pool's size.
    """
    spark = pool.sparkSession
    marked = pool.select(F.col(key).cast("string").alias("k"), F.col(author).cast("string").alias("a"), F.col(year).cast("long").alias("y"), F.sha2(F.col(key).cast("string"), 256).alias("mark"))
    chosen: dict[str, int] = {}
    authors, years = Counter(), Counter()
    for cap in author_caps:
        after = ""
        while len(chosen) < most:
            full_authors, full_years = [a for a, n in authors.items() if n >= cap], [y for y, n in years.items() if n >= year_cap]
            open_ = (F.col("mark") > after) & ~F.col("k").isin(list(chosen)) & ~F.coalesce(F.col("a"), F.lit("")).isin(full_authors) & ~F.coalesce(F.col("y").isin(full_years), F.lit(False))
            rows = marked.where(open_).orderBy("mark").limit(page).collect()
            for k, a, y, _ in rows:
                if len(chosen) < most and k not in chosen and authors[a or ""] < cap and years[y] < year_cap:
                    chosen[k] = len(chosen) + 1
                    authors[a or ""] += 1
                    years[y] += 1
            if len(rows) < page:
                break
            after = rows[-1]["mark"]
    picked = spark.createDataFrame(list(chosen.items()), "picked string, place int")
    return pool.join(F.broadcast(picked), F.col(key).cast("string") == F.col("picked")).drop("picked")  # at most ``most`` rows


def digest_order(key: object) -> str:
    """Where a key stands in ``capped_selection``'s order."""
    return hashlib.sha256(str(key).encode()).hexdigest()

"""Corpus validation, components, calibration, decisions, evaluation."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import calibrate, corpus, decisions, evaluation
from tessera.operators.components import connected_components


def test_components_match_union_find(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_triage(spark):
    rows = [("a", "prose", "t1", None), ("a", "prose", "t2", None), ("", "prose", "t3", None), ("b", "prose", None, None), ("c", "prose", "t4", "bad"), ("d", "none", "t5", None), ("e", "prose", "t6", "")]
    df = spark.createDataFrame(rows, "id string, profile string, text string, sha256 string")
    got = sorted((r["id"], r["reason"] or "") for r in corpus.triage(df, ["prose"]).collect())
    assert got == sorted([("a", "duplicate_id"), ("a", "duplicate_id"), ("", "missing_id"), ("b", "missing_file"), ("c", "sha256_mismatch"), ("d", "unknown_profile:none"), ("e", "")])
    with pytest.raises(ValueError):
        corpus.triage(df.drop("profile"), ["prose"])


def _docs(spark):
    draw = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = [" ".join(draw.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "p") for i, t in enumerate(base)]
    rows += [(100 + i, t, "p") for i, t in enumerate(base[:4])]  # exact copies
    rows += [(200 + i, t + " end", "p") for i, t in enumerate(base[:6])]  # near copies
    rows += [(300, base[0], "q"), (400, "", "p"), (401, None, "p"), (402, "one two", "p")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, grp string")


def _shingles(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_match_brute_force(spark):
    rows, docs = _docs(spark)
    got = {r["key"]: r["component"] for r in corpus.near_duplicate_groups(docs, "grp").collect()}
    sets = {i: (_shingles(t), g, len((t or "").split())) for i, t, g in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            (sa, ga, wa), (sb, gb, wb) = sets[a], sets[b]
            same = sa == sb or (sa and sb and len(sa & sb) / len(sa | sb) >= 0.92 and max(wa, wb) / max(min(wa, wb), 1) <= 1.35)
            if a < b and ga == gb and same:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def test_first_of_copies_and_representatives(spark):
    rows, docs = _docs(spark)
    kept = {r["doc_id"] for r in corpus.first_of_copies(docs, ["grp"], "doc_id").collect()}
    assert 100 not in kept and 300 in kept and {0, 200, 400} <= kept
    df = spark.createDataFrame([(1, 10, "a"), (2, 30, "a"), (3, 30, "a"), (4, 5, "b")], "doc_id long, words long, c string")
    assert sorted(r["doc_id"] for r in corpus.representatives(df, "c", "words", "doc_id").collect()) == [2, 4]


def test_provenance_ignores_unknown(spark):
    df = spark.createDataFrame([("p", "A ", 10), ("p", "a", 10), ("p", "unknown", 80), ("p", "B", 20), ("q", None, 1)], "profile string, source string, words long")
    got = {r["profile"]: r for r in corpus.provenance(df, "profile", "source", "words").collect()}
    assert got["p"]["known_sources"] == 2 and got["p"]["document_coverage"] == 0.75 and got["p"]["word_coverage"] == 0.3333
    assert got["p"]["largest_document_share"] == 0.6667 and got["p"]["largest_word_share"] == 0.5
    assert got["q"]["known_sources"] == 0 and got["q"]["largest_document_share"] == 0.0


def test_calibration(spark):
    df = spark.createDataFrame([("a", 10, "1.5"), ("a", 20, "x"), ("a", 3, "9"), ("b", 30, "2")], "g string, words long, m string")
    got = {(r["g"], r["metric"]): r for r in calibrate.calibrate(df, ["g"], ["words", "m"], min_docs=2, min_words=5).collect()}
    assert got["a", "words"]["documents"] == 2 and got["a", "words"]["excluded_short_documents"] == 1 and got["a", "words"]["sufficient"]
    assert got["a", "words"]["p50"] == 15.0 and got["a", "m"]["p90"] == 1.5 and not got["b", "m"]["sufficient"]
    with pytest.raises(ValueError):
        calibrate.calibrate(df, ["missing"], ["words"])


def test_split_keeps_components_and_fills_both_arms(spark):
    rows = [(i, f"author{i // 3}", None, f"s{i % 2}", "g" if i in (0, 29) else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, author_or_group string, source_document_id string, source_id string, split_group string")
    parts = decisions.split_components(df, "id", ["author_or_group", "split_group", "source_document_id"], ["source_document_id"])
    of = {r["id"]: r["component"] for r in parts.collect()}
    assert of[0] == of[1] == of[2] == of[27] == of[29] == 0 and of[3] == of[5] == 3
    sized = parts.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.lit(10).alias("words")).withColumn("profile", F.lit("p"))
    arms = {r["component"]: r["arm"] for r in decisions.greedy_split(sized, ["profile"]).collect()}
    assert set(arms) == set(of.values()) and set(arms.values()) == {"calibration", "validation"}


def test_bootstrap(spark):
    rows = [("s", i, i % 2 == 0, i % 4 == 0) for i in range(400)]
    row = decisions.bootstrap_reduction(spark.createDataFrame(rows, "signal string, id long, old boolean, candidate boolean"), ["signal"]).first()
    assert abs(row["mean"] - 0.25) < 0.01 and row["low"] < 0.25 < row["high"] and row["n"] == 400


def test_ladders(spark):
    base = {"evidence_gate": True, "candidate": 2.0, "old": 1.0, "control": True, "removed": 20, "removed_decisive": 20, "removed_non_actionable": 18, "alerts": 40, "alerts_decisive": 30, "alerts_precision": 0.2}
    cases = [({}, "candidate_supported_on_validation_pending_human_review", "off_supported_by_low_actionable_precision_pending_human_review"), ({"evidence_gate": False}, "blocked_evidence_gate_not_met", "off_blocked_evidence_gate_not_met"), ({"candidate": 1.0, "alerts": 3}, "keep_old_candidate_equals_old", "off_not_evaluable_insufficient_natural_alert_sample"), ({"control": False, "alerts_decisive": 1}, "keep_old_candidate_loses_positive_control", "off_blocked_needs_alert_adjudication"), ({"removed": 2, "alerts_precision": 0.5}, "keep_old_candidate_effect_sample_too_small", "off_not_supported_signal_has_actionable_natural_alerts"), ({"removed_decisive": 2}, "candidate_blocked_needs_removed_alert_adjudication", None), ({"removed_non_actionable": 5}, "keep_old_removed_alerts_include_too_many_actionable_cases", None)]
    for change, candidate, off in cases:
        row = base | change
        got = spark.createDataFrame([tuple(row.values())], list(row)).select(decisions.candidate_decision(), decisions.off_decision()).first()
        assert got[0] == candidate and (off is None or got[1] == off)


def test_annotations(spark):
    alerts = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("s", 4)], "signal string, id long")
    labels = spark.createDataFrame([(1, "actionable"), (2, "non_actionable"), (3, "uncertain"), (9, "actionable")], "id long, label string")
    row = decisions.annotation_summary(alerts, labels, ["signal"], ["id"]).first()
    assert (row["alerts"], row["annotated"], row["decisive"], row["actionable_precision"]) == (4, 3, 2, 0.5)
    twice = spark.createDataFrame([("d", "s", "a"), ("d", "s", "b"), ("e", "s", " ")], "document_id string, signal string, label string")
    assert decisions.conflicting_labels(twice, ["document_id", "signal"]).count() == 1
    docs, signals = spark.createDataFrame([("d",)], "document_id string"), spark.createDataFrame([("s",)], "signal string")
    assert decisions.unknown_references(twice, docs, signals).count() == 1


def test_diversity_gate(spark):
    rows = [("technical", f"s{i % 2}", "c", None, 10) for i in range(4)] + [("prose", "s", "c", "a", 10)]
    got = {r["profile"]: r for r in decisions.diversity_gate(spark.createDataFrame(rows, "profile string, source_id string, channel string, author_or_group string, words long")).collect()}
    assert got["technical"]["gate_met"] and not got["prose"]["gate_met"] and not got["prose"]["minimum_sources"]


def test_evaluation(spark):
    runs = [("c1", "cur", 1, 1.0), ("c1", "old", 1, 0.5), ("c2", "cur", 1, 0.0), ("c2", "old", 1, None)]
    df = spark.createDataFrame(runs, "case_id string, arm string, run_index int, v double")
    row = evaluation.paired_deltas(df, "cur", "old", ["case_id", "run_index"], "v").first()
    assert (row["planned_pairs"], row["paired_runs"], row["published_delta"]) == (2, 1, None)
    stats = {r["arm"]: r for r in evaluation.arm_stats(df, ["arm"], ["v"]).collect()}
    assert stats["cur"]["v_stddev"] == statistics.pstdev([1.0, 0.0]) and stats["old"]["v_stddev"] == 0.0
    odd = spark.createDataFrame([(float("nan"), 1.0, 1.0), (2.0, 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, 1.0)], "pass_rate double, tokens double, duration_ms double")
    assert [r["reason"] for r in evaluation.valid_runs(odd).collect()] == ["non_finite", "out_of_range", "missing", None]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert sorted(map(tuple, evaluation.compare(a, b, ["k"]).collect())) == [(1, "missing"), (2, "changed"), (4, "extra")]


def test_greedy_split_in_rounds_equals_the_fold(spark):
    import random

    from tessera.operators import decisions

    draw = random.Random(4)
    rows = [(g, i, draw.choice((1, 1, 1, 2, 9)), draw.choice((5, 40, 40, 300, 2000))) for g in ("a", "b", None) for i in range({"a": 400, "b": 7}.get(g, 60))]
    rows += [("one", 1, 1, 10), ("two", 1, 1, 10), ("two", 2, 1, 10)]
    table = spark.createDataFrame(rows, "g string, component long, docs long, words long")
    folded = {(r["g"], r["component"]): r["arm"] for r in decisions.greedy_split(table, ["g"]).collect()}
    rounds = {(r["g"], r["component"]): r["arm"] for r in decisions.greedy_split(table, ["g"], in_task=0).collect()}
    assert len(folded) == len(rows) and folded == rounds
    assert {r[3] for r in rows if r[0] == "a"} and {"calibration", "validation"} == {a for (g, _), a in folded.items() if g == "a"}


@pytest.mark.parametrize("rare", [1, 3, 64])
def test_similar_classes_match_all_pairs(spark, monkeypatch, rare):
    """With shingles that most sets have, sets of a few shingles, and sets that are made of hot shingles alone."""
    monkeypatch.setattr(corpus, "RARE", rare)
    draw = random.Random(8)
    hot = [draw.getrandbits(62) for _ in range(60)]
    sets = [{draw.getrandbits(62) for _ in range(draw.choice([1, 3, 12, 13, 40, 200]))} | set(hot[: draw.choice([0, 0, 30, 60])]) for _ in range(60)]
    sets += [set(draw.sample(hot, 58)) for _ in range(10)]
    for s in list(sets):  # near copies, some of them just above the threshold and some below
        for _ in range(2):
            less = draw.sample(sorted(s), max(1, round(len(s) * draw.choice([0.9, 0.93, 0.97]))))
            sets.append(set(less) | {draw.getrandbits(62) for _ in range(draw.choice([0, 0, 1, 3]))})
    sets = [list(x) for x in {tuple(sorted(s)) for s in sets}]
    rows = [(i, ["p", None][i % 13 == 0], 100 + i % 60, len(s), [h for h in s if h % corpus.SAMPLED == 0], [h for h in s if h % corpus.SAMPLED]) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "class long, grp string, words long, n int, few array<long>, rest array<long>").cache()
    got = sorted(tuple(r) for r in corpus.similar_classes(table.drop("rest"), table.withColumnRenamed("class", "key")).select("a", "b").collect())
    want = []
    for a, (_, ga, wa, na, *_) in enumerate(rows):
        for b in range(a + 1, len(rows)):
            _, gb, wb, nb, *_ = rows[b]
            both = len(set(sets[a]) & set(sets[b]))
            if ga == gb and both / (na + nb - both) >= 0.92 and max(wa, wb) / min(wa, wb) <= 1.35:
                want.append((a, b))
    assert got == want and len(want) > 20


def test_near_duplicates_move_few_shingles(spark):
    """Shingles are dealt out by the sampled part: less than 40 bytes written by shuffles for each of them."""
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), *[(1000 + i, t + " end") for i, t in enumerate(texts[:30])]], "doc_id long, text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved() -> int:
        stages = store.stageList(None, *[getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)])
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = moved()
    assert corpus.near_duplicate_groups(docs).where("key <> component").count() == 30
    assert moved() - before < 40 * 330 * 396

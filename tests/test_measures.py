"""The array reader of prose against the expressions of ``text``, which read a text pattern by pattern."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import measures
from tessera.functions import text as T
from tessera.functions.lexicons import ENGLISH, RUSSIAN
from tessera.operators import calibrate, features

BITS = [
    "А. С. Пушкин", "т. е. давно", "т.д. И", "См. рис. 5", "ул. Ленина", "5 г. Иванов", "НАПР. это", "3.5 руб. за", "A. B. Smith", "²A. Smith", "_A. Smith",
    "the", "of the", "Of The", "in the", "a", "by", "that", "is the", "важно отметить", "короче", "таким образом", " ", "\n", "\n\n", "\n \n", "\r\n", "\x85", " ", "\x1c",
    ".", "!", "?", "…", "....", "—", " – ", ":", "1:2", "a:1", "`code x`", "``", "```\nx\n```", "http://a.b/c)", "[l](u)", "<b>", "\n> q", "«q»", "“q”", "- item x y", "1. a b c", "# head a b",
    "а-б-в", "-", "1,2.3", "1..2", "5.a", "1∯2", " ", "é", "😀", "İ.", "x١٢", "---\n", "\0", "",
]


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(11)
    texts = [draw.choice([" ", "", "\n"]).join(draw.choice(BITS) for _ in range(draw.choice([0, 1, 5, 30, 120]))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate([*texts, None, "---\na b c\n---\nText of it. And more of it."])), "id long, text string").coalesce(2).cache()


@pytest.mark.parametrize("include_quotes", [False, True])
def test_counts_and_places(odd, include_quotes, monkeypatch):
    phrases = {"road": ENGLISH.road, "fillers": ENGLISH.fillers, "russian": RUSSIAN.road, "odd": ("а-б", ". the", "a a")}
    got = odd.select("id", "text", measures.measured(F.col("text"), phrases, {"road": 3, "fillers": 0}, include_quotes).alias("m"))
    mask = T.mask_markup(F.coalesce("text", F.lit("")))
    df = features.once(got, style=mask if include_quotes else T.mask_quotes(mask))
    style = F.col("style")
    df = features.once(df, s=T.sentence_places(style), p=T.paragraphs(style))
    starts = lambda p: F.regexp_count(F.lower(style), F.lit(rf"(?<![{T.LETTERS}])(?=\Q{p}\E(?![{T.LETTERS}]))"))
    pack = lambda hits: F.transform(hits, lambda h: F.shiftleft(h["pos"].cast("long"), 32) + F.length(h["matched"]))
    want = {
        "style": F.coalesce("m.style", F.coalesce("text", F.lit(""))) == style, "words": F.col("m.words") == T.token_count(style),
        "lengths": F.col("m.lengths") == F.transform("s", lambda s: s["n"]), "spans": F.col("m.spans") == pack(F.col("s")),
        "paragraphs": F.col("m.paragraphs") == F.size("p"), "single": F.col("m.single") == F.size(F.filter("p", lambda p: F.size(T.sentences(p)) <= 1)),
        "first": F.col("m.first") == F.coalesce(T.first_paragraph_place(style), F.lit(-1)),
        "dashes": F.col("m.dashes") == T.count(style, features.DASH), "colons": F.col("m.colons") == T.count(style, features.COLON), "ellipses": F.col("m.ellipses") == T.count(style, features.ELLIPSIS),
        **{f"n_{f}": F.col(f"m.n_{f}") == sum((starts(p) for p in given), F.lit(0)) for f, given in phrases.items()},
        "at_road": F.col("m.at_road") == F.slice(pack(T.family_hits(style, [T.literal(p) for p in ENGLISH.road])), 1, 3),
        "at_fillers": F.col("m.at_fillers") == pack(T.family_hits(style, [T.literal(p) for p in ENGLISH.fillers])),
    }
    wrong = df.select(*[F.count_if(~F.coalesce(same, F.lit(False))).alias(name) for name, same in want.items()]).first().asDict()
    assert wrong == dict.fromkeys(want, 0)


def test_a_stretch_of_any_size_gives_the_same(odd, monkeypatch):
    texts = [r["text"] for r in odd.orderBy("id").collect()]
    given = measures.Families({"road": ENGLISH.road}, {"road": 2})
    want = measures.measure(texts, given)
    for size in (1, 100, 10**9):
        monkeypatch.setattr(measures, "STRETCH", size)
        assert measures.measure(texts, given).equals(want)
    assert measures.measure([], given).to_pylist() == []


def test_features_run_no_patterns_over_whole_texts(spark, odd):
    """With phrases alone, a text is read once: no pattern, and one stage of Python."""
    plan = features.compute_features(odd, ENGLISH).select("id", *features.METRICS)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "ArrowEvalPython" in plan


def test_counts_are_those_of_the_findings(spark, odd):
    docs = odd.withColumn("mode", F.when(F.col("id") % 7 < 5, F.element_at(F.array(*[F.lit(p) for p in features.PROFILE_NAMES]), (F.col("id") % 7 + 1).cast("int"))))
    loud = features.profiles(spark).withColumns({"dash_level": F.lit("info"), "colon_level": F.lit("info"), "punctuation_min_words": F.lit(3), "long_sentence_words_info": F.lit(6), "rhythm_checks": F.lit(True), "min_paragraphs_for_ratio": F.lit(1)})
    for pack in (ENGLISH, RUSSIAN):
        want = features.prose_findings(docs, loud, pack).groupBy("id", "code", "level").agg(F.count(F.lit(1)).alias("n"))
        counted = features.finding_counts(docs, loud, pack)
        got = counted.select("id", F.inline("found"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert counted.count() == docs.count()


def test_alert_burden_of_counted_rows(spark):
    docs = spark.createDataFrame([(1, 10), (2, 30)], "doc_id long, words long")
    counted = spark.createDataFrame([("a", 1, "warning", "x", 2), ("a", 2, "info", "y", 1), ("b", 2, "info", "y", 3)], "version string, doc_id long, level string, code string, n long")
    each = counted.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert sorted(map(tuple, calibrate.alert_burden(counted, docs, n="n").collect())) == sorted(map(tuple, calibrate.alert_burden(each, docs).collect()))


def test_shingles_are_those_of_the_expressions(odd):
    """As many distinct ones, and equal sets in the same documents."""
    long = odd.withColumn("text", F.when(F.col("id") % 50 == 3, F.repeat("text", F.lit(700))).otherwise(F.col("text")))
    got = long.select("id", "text", measures.shingled(F.col("text")).alias("m"))
    df = features.once(got, w=T.matches(F.lower(F.coalesce("text", F.lit(""))), T.WORD))
    df = features.once(df, s=F.array_sort(T.shingle_set(F.col("w"))))
    rows = df.select("id", "s", "m", F.size("w").alias("size"), T.token_count(F.col("text")).alias("words")).collect()
    assert max(r["size"] for r in rows) > 10_000
    for r in rows:
        both = set(r["m"]["few"]) | set(r["m"]["rest"])
        assert (len(r["s"]), r["words"]) == (r["m"]["n"], r["m"]["words"]) == (len(both), r["words"])
    plain, digest = {}, {}
    for r in rows:
        plain.setdefault(tuple(r["s"]), set()).add(r["id"])
        digest.setdefault(r["m"]["mark"], set()).add(r["id"])
    assert sorted(map(sorted, plain.values())) == sorted(map(sorted, digest.values()))
    each = {}
    for r in rows:  # one digest for each shingle, wherever it stands
        for h in (*r["m"]["few"], *r["m"]["rest"]):
            each.setdefault(h, set()).add(r["id"])
    said = {}
    for r in rows:
        for x in r["s"]:
            said.setdefault(x, set()).add(r["id"])
    assert sorted(map(sorted, each.values())) == sorted(map(sorted, said.values()))

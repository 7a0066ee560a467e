"""Prose features and findings on small Russian texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.features import compute_features, profiles, prose_findings

CASES = {
    "abbreviations": ("Он пришёл, т. е. опоздал. Были дела и т. д. Потом ушёл домой. В 2020 г. вышел закон. На ул. Ленина тихо. Конец дня настал.", "prose"),
    "initials": ("А. С. Пушкин написал текст. Версия 2.1.4 вышла вчера. Третье предложение тут.", "prose"),
    "ranges": ("Диапазон 10–15, отношение 1:2, время 12:30.", "prose"),
    "quote": ("Он сказал «очень важные слова здесь» и ушёл.", "prose"),
    "passive": ("Было принято решение о запуске. Была проведена проверка системы.", "technical"),
    "dashes": ("Это — пример такой. " * 25, "prose"),
    "hype": ("Синергия команд. Бесшовный опыт и синергия роста. Новый уровень сервиса.", "product"),
    "hype_once": ("Синергия команд помогла всем нам сегодня.", "prose"),
    "fillers": ("Ну вот, короче, мы пришли. Вот так, собственно, и было.", "oral"),
    "road": ("Таким образом, всё готово. Кроме того, есть план. Более того, он принят. Важно отметить итог.", "prose"),
    "pivots": ("Это не просто дом, а крепость. На самом деле всё просто. Казалось бы, всё ясно.", "prose"),
    "markup": ("---\ntitle: x\n---\n# Заголовок тут есть\n\nТекст с `кодом` и https://example.org/a-b ссылкой.\n\n```\nкод код код\n```\n", "prose"),
    "empty": ("", "prose"),
    "null": (None, "prose"),
}


@pytest.fixture(scope="module")
def measured(spark):
    docs = spark.createDataFrame([(k, t, m) for k, (t, m) in CASES.items()], "id string, text string, mode string")
    rows = {r["id"]: r for r in compute_features(docs).collect()}
    found = {}
    for r in prose_findings(docs, profiles(spark)).collect():
        found.setdefault(r["id"], []).append((r["code"], r["level"]))
    return rows, found


def test_sentences(measured):
    rows, _ = measured
    assert rows["abbreviations"]["sentences"] == 6
    assert rows["initials"]["sentences"] == 3
    assert rows["dashes"]["sentences"] == 25


def test_punctuation(measured):
    rows, found = measured
    assert rows["ranges"]["dash_per_1000"] == rows["ranges"]["colon_per_1000"] == 0
    assert rows["dashes"]["dash_per_1000"] > 0
    assert "dash-density" not in dict(found.get("dashes", []))


def test_quotes_are_left_out(spark, measured):
    rows, _ = measured
    text = spark.createDataFrame([(CASES["quote"][0],)], "text string")
    assert compute_features(text, include_quotes=True).first()["words"] > rows["quote"]["words"]


def test_markup_is_left_out(measured):
    rows, _ = measured
    assert rows["markup"]["words"] == 7  # the heading's three words, and four of the paragraph
    assert rows["markup"]["paragraphs"] == 1


def test_findings(measured):
    _, found = measured
    assert found["passive"] == [("nominalization", "info")] * 2
    assert ("hype-density", "warning") in found["hype"]
    assert "hype_once" not in found
    assert ("filler-density", "info") in found["fillers"]
    assert [c for c, _ in found["road"]].count("road-sign-density") == 4
    assert [c for c, _ in found["pivots"]].count("rhetorical-pivot") >= 3


def test_empty_and_null(measured):
    rows, found = measured
    for name in ("empty", "null"):
        assert rows[name]["words"] == rows[name]["sentences"] == rows[name]["paragraphs"] == 0
        assert rows[name]["sentence_cv"] == 0.0
        assert name not in found


def test_places(spark):
    df = spark.createDataFrame([("один\nдва три\nдва",)], "t string")
    hits = df.select(T.hits(F.col("t"), "два").alias("h")).first()["h"]
    assert [(h["pos"], h["matched"]) for h in hits] == [(5, "два"), (13, "два")]
    lines = df.select(*[T.line_of(F.col("t"), F.lit(h["pos"])) for h in hits]).first()
    assert list(lines) == [2, 3]


def test_safe_normalize(spark):
    text = "a \nb  \nx y\n```\nc \n```\n\n\n\n\n\nd\n"
    got = spark.createDataFrame([(text,)], "t string").select(T.safe_normalize(F.col("t"))).first()[0]
    assert got == "a\nb  \nx y\n```\nc \n```\n\n\nd\n"


def test_percentile_and_labels(spark):
    row = spark.createDataFrame([([4, 1, 3, 2], " N/A ", "Yes")], "v array<int>, p string, b string").select(T.percentile_of(F.col("v"), 0.9), T.known_label(F.col("p")), T.truthy(F.col("b"))).first()
    assert abs(row[0] - 3.7) < 1e-9
    assert row[1] is None and row[2] is True


def test_unknown_mode_gives_nothing(spark):
    docs = spark.createDataFrame([("x", CASES["passive"][0], "nowhere")], "id string, text string, mode string")
    assert prose_findings(docs, profiles(spark)).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id string, text string, mode string")
    assert prose_findings(docs, profiles(spark)).count() == 0


def test_places_of_paragraphs(spark):
    text = "# слово слово слово\n\nслово слово слово\n \n\n- пункт пункт пункт\n\nслово слово слово"
    rows = spark.createDataFrame([(text,)], "t string").select(T.paragraph_places(F.col("t")).alias("p"), T.paragraphs(F.col("t")).alias("q"), T.first_paragraph_place(F.col("t")).alias("f")).first()
    assert [(r["pos"], r["text"]) for r in rows["p"]] == [(text.index("\n\nслово") + 2, "слово слово слово"), (text.rindex("слово слово слово"), "слово слово слово")]
    assert rows["q"] == [r["text"] for r in rows["p"]] and rows["f"] == rows["p"][0]["pos"]


def test_profiles_from_json(spark, tmp_path):
    import json

    from tessera.operators.features import read_profiles

    path = tmp_path / "profiles.json"
    path.write_text(json.dumps({"own": {"min_road_hits": 2, "road_per_1000_warn": 4.5, "rhythm_checks": False, "hype_level": "off"}, "bare": {}}))
    found = {r["profile"]: r for r in read_profiles(spark, str(path)).collect()}
    assert (found["own"]["min_road_hits"], found["own"]["road_per_1000_warn"], found["own"]["rhythm_checks"], found["own"]["hype_level"]) == (2, 4.5, False, "off")
    built_in = profiles(spark).where("profile = 'prose'").first()
    assert all(found["bare"][c] == built_in[c] for c in built_in.asDict() if c != "profile")
    assert read_profiles(spark, str(path)).columns == profiles(spark).columns

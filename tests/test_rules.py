"""Requirement checks and edit integrity."""

import pytest

from tessera.operators.integrity import integrity_findings
from tessera.operators.requirements import requirement_findings

BAD = """# Требования

- Система должна работать быстро.
- Система должна по возможности сохранять данные.
- Желательно, чтобы система должна была вести журнал.
- Отчёт должен формироваться оперативно.
- Система должна обработать указанный файл.
- Система должна обеспечивать безопасность.
- TODO уточнить
- Модуль должен принимать запрос и должен вернуть ответ.
- Система должна сохранять журнал событий пользователя.
- REQ-7: Система должна сохранять журнал событий пользователя.
"""
GOOD = """# Требования

REQ-1: Система должна вернуть ответ не более чем за 2 с при нагрузке 100 запросов/с.

# Критерии приёмки

Проверка по журналу.
"""


def codes(spark, text, profile="generic"):
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r["code"], r["line"]) for r in requirement_findings(docs, profile).collect()]


def test_bad_specification(spark):
    found = {c for c, _ in codes(spark, BAD)}
    assert {"TZ001", "TZ002", "TZ004", "TZ005", "TZ006", "TZ007", "TZ008", "TZ009", "TZ010", "TZ011", "TZ012"} <= found


def test_good_specification(spark):
    assert codes(spark, GOOD) == []


def test_code_fences_are_ignored(spark):
    assert codes(spark, "```\nTODO\nСистема должна работать быстро.\n```\n") == []


def test_structure_profile(spark):
    lines = ["# Введение", "# Основания для разработки", "# Назначение разработки"]
    found = codes(spark, "\n".join(lines), "gost19")
    assert [c for c, _ in found] == ["TZ014"] * 5
    with pytest.raises(ValueError):
        codes(spark, "x", "unknown")


def test_null_and_empty(spark):
    assert codes(spark, None) == codes(spark, "") == []


PAIRS = {
    "number": ("Рост составил 12%.", "Рост составил 15%.", {"numeric-change"}),
    "date": ("Срок 12.05.2024 истёк.", "Срок 13.05.2024 истёк.", {"date-change"}),
    "url_case": ("См. Https://Example.org/A", "См. https://example.org/A", set()),
    "url_path": ("См. https://example.org/A", "См. https://example.org/a", {"url-change"}),
    "modality": ("Это, возможно, поможет.", "Это точно поможет.", {"modality-strengthened"}),
    "marker": ("Это, возможно, поможет.", "Это поможет.", {"modality-marker-loss"}),
    "negation": ("Это не работает.", "Это работает.", {"negation-loss"}),
    "condition": ("Если дождь, идём домой.", "Идём домой.", {"condition-loss"}),
    "attribution": ("По данным банка, рост есть.", "Рост есть.", {"attribution-loss"}),
    "causal": ("Ушёл, потому что устал.", "Ушёл, устал.", {"causal-relation-change"}),
    "quote": ("Он сказал «важное слово».", "Он сказал важное слово.", {"quote-changed-or-removed"}),
    "entity": ("Приехал Иван Петров вчера.", "Приехал Пётр Иванов вчера.", {"entity-like-change"}),
    "same": ("Ничего нового.", "Ничего нового.", set()),
    "null": (None, None, set()),
}


def test_integrity(spark):
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b, _) in PAIRS.items()], "id string, source string, edited string")
    found = {}
    for r in integrity_findings(pairs).collect():
        found.setdefault(r["id"], {})[r["code"]] = r
    for name, (*_, expected) in PAIRS.items():
        assert expected <= set(found.get(name, {})), name
        if not expected:
            assert name not in found
    number = found["number"]["numeric-change"]
    assert number["removed"] == ["12%"] and number["added"] == ["15%"]


def test_bags_keep_multiplicity(spark):
    pairs = spark.createDataFrame([("1 1 1 2", "1 2 2")], "source string, edited string")
    row = next(r for r in integrity_findings(pairs).collect() if r["code"] == "numeric-change")
    assert row["removed"] == ["1", "1"] and row["added"] == ["2"]


def test_capped_selection_equals_the_plain_loop(spark):
    from collections import Counter

    from tessera.operators.protocol import capped_selection, digest_order

    rows = [(i, f"a{i % 7}" if i % 11 else None, 2000 + i % 9) for i in range(300)]
    for most, page in ((100, 1000), (20, 3), (400, 50)):
        got = capped_selection(spark.createDataFrame(rows, "id long, author string, year long"), "id", "author", "year", most=most, page=page)
        chosen, authors, years = [], Counter(), Counter()
        for cap in (1, 2, 3, 5):
            for i, a, y in sorted(rows, key=lambda r: digest_order(r[0])):
                if len(chosen) < most and i not in chosen and authors[a or ""] < cap and years[y] < 5:
                    chosen.append(i)
                    authors[a or ""] += 1
                    years[y] += 1
        assert [r["id"] for r in got.orderBy("place").collect()] == chosen


def test_workflow_says_the_first_failure(spark):
    from tessera.operators import protocol

    good = {f: not said for f, said, *_ in protocol.WORKFLOW}
    rows = [good, *({**good, f: said} for f, said, *_ in protocol.WORKFLOW), {**good, "manifest": None}]
    names = list(good)
    table = spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in enumerate(rows)], f"i int, {', '.join(f'{n} boolean' for n in names)}")
    got = {r["i"]: r["s"]["exit_code"] for r in table.select("i", protocol.workflow_state().alias("s")).collect()}
    assert got == {0: 0, **{i + 1: code for i, (*_, code, _) in enumerate(protocol.WORKFLOW)}, len(rows) - 1: 2}

"""Small Russian texts in which every rule speaks once or more, with what it has to say.

The driver's tables hold no Russian.  Queries deal these texts out over a table's rows, and
what is expected was derived from the rules by hand, not by running them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Expected:
    """A text (or a text and its edited version), what it is checked as, and the findings: code, level or line, how often."""

    text: str
    other: str
    findings: tuple[tuple, ...]


_HOUSE = "Дом стоит тихо у реки."

#: Prose rules: text, profile, findings (code, level, how often).
PROSE = (
    Expected("Было принято решение о запуске.", "prose", (("nominalization", "warning", 1),)),
    Expected("Всё в рамках плана и в рамках сметы, в целях учёта", "prose", (("bureaucratic-density", "warning", 3),)),
    Expected("На самом деле тихо, казалось бы пусто", "prose", (("rhetorical-pivot", "warning", 2),)),
    Expected("Важно отметить срок, кроме того цену, таким образом итог", "prose", (("road-sign-density", "warning", 3),)),
    Expected("Бесшовная связь и синергия", "prose", (("hype-density", "warning", 1),)),
    Expected("Экосистема, трансформация, оптимизация, эффективность", "prose", (("context-jargon-density", "info", 1),)),
    Expected(" ".join([_HOUSE] * 10), "prose", (("sentence-uniformity", "info", 1),)),
    Expected("слово " * 33 + "тут.", "oral", (("long-sentence", "info", 1),)),
    Expected("\n\n".join([_HOUSE] * 8), "prose", (("one-sentence-paragraphs", "info", 1),)),
    Expected("Ну вот, короче, дом", "oral", (("filler-density", "info", 1),)),
    Expected("слово " * 130 + "слово — слово " * 5 + "слово: слово " * 4, "marks", (("dash-density", "info", 1), ("colon-density", "info", 1))),
    Expected("Бесшовная связь и синергия", "technical", ()),
    Expected("", "prose", ()),
)

#: Requirement rules under the profile gost19: text, findings (code, line, how often).
REQUIREMENTS = (
    Expected(
        "\n".join(
            (
                "TODO: дописать раздел",
                "Система должна быть удобной для оператора в работе.",
                "Желательно показывать журнал, но пользователь должен видеть итог.",
                "Модуль должен по возможности хранить копии.",
                "Отчёт должен формироваться оперативно.",
                "Сервис должен обработать указанные записи.",
                "Оператор должен обеспечить безопасность сети.",
                "Клиент должен войти и обязан подтвердить вход.",
                "Сервер должен хранить журналы всех операций год.",
                "Сервер должен хранить журналы всех операций год.",
                "Необходимо вести учёт. Необходимо проверять доступ.",
                "Требуется пароль. Требуется ключ.",
            )
        ),
        "gost19",
        (
            ("TZ001", 1, 1), ("TZ002", 2, 1), ("TZ005", 2, 1), ("TZ003", 3, 1), ("TZ009", 4, 1), ("TZ007", 5, 1), ("TZ005", 5, 1), ("TZ006", 6, 1),
            ("TZ008", 7, 1), ("TZ004", 8, 1), ("TZ010", 10, 1), ("TZ004", 11, 1), ("TZ004", 12, 1), ("TZ011", 1, 1), ("TZ012", 1, 1), ("TZ013", 1, 1), ("TZ014", 1, 8),
        ),
    ),
    Expected("# Введение\n# Назначение разработки\nСервер должен отвечать не более 2 с.\nПорядок контроля и приёмки описан ниже.\n```\nTODO\n```", "gost19", (("TZ014", 1, 6),)),
    Expected("", "gost19", (("TZ014", 1, 8),)),
)

#: Integrity rules: before, after, findings (code, values removed, values added).
INTEGRITY = (
    Expected("Цена 100 и 5 %.", "Цена 200 и 5 %.", (("numeric-change", 1, 1),)),
    Expected("Срок 01.02.2024 прежний", "Срок 03.02.2024 прежний", (("numeric-change", 1, 1), ("date-change", 1, 1))),
    Expected("Цена 500 ₽ ровно", "Цена 600 ₽ ровно", (("numeric-change", 1, 1), ("currency-change", 1, 1))),
    Expected("Смотри https://a.example/x тут", "Смотри https://b.example/x тут", (("url-change", 1, 1),)),
    Expected("Вес 5 кг всего", "Вес 7 кг всего", (("numeric-change", 1, 1), ("measurement-change", 1, 1))),
    Expected("Приехал Иван Петров вчера", "Приехал Иван Сидоров вчера", (("entity-like-change", 1, 1),)),
    Expected("это возможно так", "это точно так", (("modality-strengthened", 0, 0),)),
    Expected("это возможно так", "это так", (("modality-marker-loss", 0, 0),)),
    Expected("это не так", "это так", (("negation-loss", 0, 0),)),
    Expected("если дождь, ждём", "дождь, ждём", (("condition-loss", 0, 0),)),
    Expected("по словам врача, всё хорошо", "врача, всё хорошо", (("attribution-loss", 0, 0),)),
    Expected("дождь, поэтому ждём", "дождь, ждём", (("causal-relation-change", 0, 0),)),
    Expected("он сказал «добрый день» утром", "он сказал утром", (("quote-changed-or-removed", 1, 0),)),
    Expected("без правок", "без правок", ()),
)


def sql_values(fixtures: tuple[Expected, ...]) -> str:
    """``(i, code, second, third)`` of all expected findings as SQL rows."""
    said = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({i}, {', '.join(map(said, finding))})" for i, fixture in enumerate(fixtures) for finding in fixture.findings)

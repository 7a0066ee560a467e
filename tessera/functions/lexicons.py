"""Word lists, patterns and thresholds that rules are measured with.

Everything here is data: operators take a pack, a profile table or a rule table as a
parameter, and these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Letters that make up a token.
LETTERS = "А-Яа-яЁёA-Za-z"


@dataclass(frozen=True)
class Pack:
    """Lexicons of a language: phrases are literal, the other families are patterns."""

    road: tuple[str, ...] = ()
    hype: tuple[str, ...] = ()
    jargon: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    bureau: tuple[str, ...] = ()
    pivots: tuple[str, ...] = ()
    fillers: tuple[str, ...] = ()
    phrase_families: tuple[str, ...] = field(default=("road", "fillers"))


# The Russian lexicons.
RUSSIAN = Pack(
    road=(
        "важно отметить", "стоит отметить", "следует отметить",
        "необходимо отметить", "необходимо подчеркнуть", "важно понимать",
        "ключевой момент", "таким образом", "более того", "кроме того",
        "вместе с тем", "с другой стороны", "в конечном счёте",
        "в конечном счете", "подводя итог", "в заключение",
    ),
    hype=(
        r"\bсинерги\w*\b",
        r"\bбесшовн\w*\b",
        r"\bдрайвер\w*\s+рост\w*\b",
        r"\bточк\w*\s+рост\w*\b",
        r"\bнов\w*\s+уровн\w*\b",
        r"\bпереосмыслен\w*\b",
        r"\bнов\w*\s+реальност\w*\b",
        r"\bреволюционн\w*\b",
        r"\bфлагманск\w*\b",
        r"\bкак\s+никогда\b",
    ),
    jargon=(
        r"\bэкосистем\w*\b",
        r"\bтрансформаци\w*\b",
        r"\bмасштабировани\w*\b",
        r"\bоптимизаци\w*\b",
        r"\bэффективност\w*\b",
        r"\bинновационн\w*\b",
        r"\bкомплексн\w*\b",
        r"\bценностн\w*\s+предложени\w*\b",
    ),
    nominal=(
        r"\b(?:осуществить|осуществлять|осуществлено|осуществляется|осуществлялось)\s+(?:проведение|реализацию|настройку|проверку|анализ|обработку)\b",
        r"\b(?:произвести|производить|произведено|производится)\s+(?:настройку|проверку|анализ|обработку|расч[её]т|оценку)\b",
        r"\bбыло\s+принято\s+решение\s+(?:о|об)\b",
        r"\b(?:была|было|были)\s+(?:проведена|проведено|проведены|осуществлена|осуществлено|осуществлены)\b",
        r"\bреализован[аоы]?\s+возможност\w*\b",
    ),
    bureau=(
        r"\bв\s+рамках\b",
        r"\bв\s+целях\b",
        r"\bв\s+части\b",
        r"\bпо\s+причине\s+наличия\b",
        r"\bимеет\s+место\b",
        r"\bимеется\s+возможность\b",
    ),
    pivots=(
        r"\bэто\s+не\s+просто\b",
        r"\bне\s+просто\b.{0,100}\b(?:а|но)\b",
        r"\bне\s+столько\b.{0,100}\bсколько\b",
        r"\bна\s+первый\s+взгляд\b",
        r"\bказалось\s+бы\b",
        r"\bна\s+самом\s+деле\b",
        r"\b(?:истинная|настоящая)\s+проблема\b",
    ),
    fillers=("ну", "вот", "короче", "собственно", "как бы", "типа", "в общем", "скажем так"),
)

#: A pack for the English-like driver corpus; single words and pairs of its commonest syllable words.
ENGLISH = Pack(
    road=("of the", "in the", "to the", "and the", "for the"),
    hype=("ing", "tion"),
    jargon=("that", "this", "with"),
    nominal=("is the",),
    bureau=("by", "at", "from"),
    pivots=("not", "on", "it"),
    fillers=("the", "a", "of"),
    phrase_families=("road", "hype", "jargon", "nominal", "bureau", "pivots", "fillers"),
)

# Thresholds of the five profiles, in the order prose, oral, product, technical, official.
PROFILE_NAMES = ("prose", "oral", "product", "technical", "official")
PROFILE_VALUES = {
    "long_sentence_words_info": (100000, 32, 100000, 55, 100000),
    "bureau_per_1000_warn": (7.0, 7.0, 9.0, 14.0, 18.0),
    "road_per_1000_warn": (10.0, 10.0, 10.0, 15.0, 18.0),
    "dash_per_1000_info": (14.0, 16.0, 16.0, 18.0, 20.0),
    "colon_per_1000_info": (10.0, 8.0, 12.0, 14.0, 16.0),
    "sentence_cv_min_info": (0.32, 0.28, 0.3, 0.25, 0.22),
    "one_sentence_paragraph_ratio_info": (0.7, 0.75, 0.90674, 0.8, 0.85),
    "jargon_per_1000_info": (12.0, 10.0, 18.0, 28.0, 32.0),
    "pivot_per_1000_warn": (5.0, 5.0, 5.0, 8.0, 8.0),
    "filler_per_1000_info": (12.0, 12.0, 12.0, 12.0, 12.0),
    "rhythm_checks": (True, True, True, False, False),
    "nominalization_level": ("warning", "warning", "warning", "info", "info"),
    "hype_level": ("warning", "warning", "warning", "off", "off"),
    "min_bureau_hits": (3, 3, 3, 3, 3),
    "min_road_hits": (3, 3, 3, 3, 3),
    "min_pivot_hits": (2, 2, 2, 2, 2),
    "min_jargon_hits": (4, 4, 4, 4, 4),
    "min_filler_hits": (3, 3, 3, 3, 3),
    "punctuation_min_words": (120, 120, 120, 120, 120),
    "min_sentences_for_cv": (10, 10, 10, 10, 10),
    "min_paragraphs_for_ratio": (8, 8, 8, 8, 8),
    "dash_level": ("off", "off", "off", "off", "off"),
    "colon_level": ("off", "off", "off", "off", "off"),
    "min_hype_hits": (2, 2, 2, 2, 2),
    "hype_per_1000_emit": (5.0, 5.0, 5.0, 5.0, 5.0),
}


# Patterns of requirement lines.
REQ_MARKER = r"(?:\b(?:долж(?:ен|на|но|ны)|обязан\w*|требуется|необходимо|запрещается)\b|\bне\s+допускается\b)"
REQ_ID = r"^\s*(?:[-*+]\s*)?(?:REQ|FR|NFR|ТР|ТЗ)[-_ ]?\d+[\w.-]*\s*[:.)-]?"
HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
PLACEHOLDER = r"(?:\bTODO\b|\bTBD\b|\bFIXME\b|\bXXX\b|\[\s*(?:уточнить|заполнить|согласовать|tbd|todo)[^\]]*\]|\b(?:уточнить|согласовать позднее|определить позднее)\b)"
SUBJECTIVE = r"\b(?:быстр(?:о|ый|ая|ое|ые)|удобн\w*|современн\w*|качественн\w*|интуитивн\w*|оптимальн\w*|высок\w*\s+производительност\w*|наилучш\w*)\b"
WEAK = r"\b(?:желательно|по\s+возможности|рекомендуется|предпочтительно)\b"
CONFLICT = r"\bдолж(?:ен|на|но|ны)\b.{0,80}\b(?:по\s+возможности|желательно|при\s+необходимости)\b"
VAGUE_TIME = r"\b(?:в\s+кратчайш\w*\s+срок\w*|оперативно|своевременно|регулярно|периодически|без\s+задержек|немедленно)\b"
SECURITY = r"\b(?:обеспеч(?:ить|ивает|ивать|иваться)\s+(?:информационную\s+)?безопасност\w*|обеспеч(?:ить|ивает|ивать)\s+защищ[её]нност\w*|долж(?:ен|на|но|ны).{0,60}(?:быть\s+)?безопасн\w*)\b"
AMBIGUOUS_OBJECT = r"\b(?:обработать|сохранить|использовать|передать|удалить|учитывать|вернуть|изменить|проверить)\s+(?:это|этот|эту|эти|данн(?:ый|ую|ые)|указанн(?:ый|ую|ые)|соответствующ(?:ий|ую|ие))\b"
VERIFY_HINT = r"(?:\bне\s+(?:более|менее)\b|\b(?:не\s+позднее|не\s+ранее)\b|\bв\s+течение\b|\bесли\b|\bпосле\b|\bдо\b|\bпри\s+нагрузке\b|\bпровер(?:яется|ить|ка)\b|\bиспытан\w*\b|\bкритери\w*\b|\bкод\s+ответа\b|\bстатус\w*\b|\bошибк\w*\b|\d\s*(?:мс|с|сек\.?|мин\.?|ч|%|МБ|ГБ|шт\.?|запрос\w*/с))"
ACCEPTANCE = r"(?:порядок\s+контроля\s+и\s+при[её]мки|критерии\s+при[её]мки|при[её]мочн\w*\s+(?:испытан\w*|критери\w*)|verification|acceptance)"
NON_FUNCTIONAL = r"\b(?:производительност|доступност|надежност|над[её]жност|масштабируемост|безопасност|врем[яе]\s+отклика|скорост|нагрузк|RTO|RPO|SLA)\b"
BRANCH = r"\b(?:а\s+также|либо|или)\b"
NORM_FORMS = {
    "должен": r"\bдолж(?:ен|на|но|ны)\b",
    "необходимо": r"\bнеобходимо\b",
    "требуется": r"\bтребуется\b",
    "обязан": r"\bобязан\w*\b",
    "следует": r"\bследует\b",
}
NUMBERED_HEADING = r"^\s*\d+(?:\.\d+)*[.)]?\s+[А-ЯЁA-Z]"
SEVERITY = {"TZ001": "warning", "TZ002": "warning", "TZ003": "warning", "TZ004": "info", "TZ005": "info", "TZ006": "warning", "TZ007": "warning", "TZ008": "info", "TZ009": "warning", "TZ010": "info", "TZ011": "info", "TZ012": "warning", "TZ013": "info", "TZ014": "warning"}
REQUIRED_SECTIONS = {
    "generic": [],
    "gost34": [
        ["общие сведения"],
        ["цели и назначение создания автоматизированной системы", "цели и назначение создания ас"],
        ["характеристика объектов автоматизации", "характеристика объекта автоматизации"],
        ["требования к автоматизированной системе", "требования к ас"],
        ["состав и содержание работ по созданию автоматизированной системы", "состав и содержание работ"],
        ["порядок разработки автоматизированной системы", "порядок разработки ас"],
        ["порядок контроля и приемки автоматизированной системы", "порядок контроля и приёмки автоматизированной системы", "порядок контроля и приемки"],
        ["требования к составу и содержанию работ по подготовке объекта автоматизации к вводу автоматизированной системы в действие", "подготовка объекта автоматизации к вводу"],
        ["требования к документированию"],
        ["источники разработки"],
    ],
    "gost19": [
        ["введение"],
        ["основания для разработки", "основание для разработки"],
        ["назначение разработки"],
        ["требования к программе или программному изделию", "требования к программе"],
        ["требования к программной документации"],
        ["технико-экономические показатели", "технико экономические показатели"],
        ["стадии и этапы разработки"],
        ["порядок контроля и приемки", "порядок контроля и приёмки"],
    ],
}

# Patterns and word lists of edit integrity.
NUMBER = r"(?<![\w])(?:\d{1,4}(?:[ .]\d{3})+|\d+)(?:[,.]\d+)?(?:\s*[%‰])?(?![\w])"
DATE = r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
URL = r"https?://[^\s)\]}>]+"
CURRENCY = r"(?<!\w)(?:[$€₽¥£]\s*\d[\d\s.,]*|\d[\d\s.,]*\s*(?:₽|руб\.?|рублей|доллар(?:а|ов)?|евро))(?!\w)"
QUOTE = r"«([^«»\n]{2,300})»|\"([^\"\n]{2,300})\""
MEASURE = r"(?<![\w])(?:\d+(?:[,.]\d+)?)\s*(?:%|‰|°C|°F|м²|м³|м3|мм|см|км|м|кг|мг|г|мл|л|сек\.?|с|мин\.?|ч|час(?:а|ов)?|дн(?:я|ей)?|КБ|МБ|ГБ|ТБ|KB|MB|GB|TB|кбит/с|Мбит/с|Гбит/с|kbps|Mbps|Gbps)(?![\w])"
ENTITY = r"(?<![\w])(?:[А-ЯЁA-Z][а-яёa-z]+(?:[-’'][А-ЯЁA-Z]?[а-яёa-z]+)?)(?:\s+[А-ЯЁA-Z][а-яёa-z]+(?:[-’'][А-ЯЁA-Z]?[а-яёa-z]+)?)+(?![\w])"
ACRONYM = r"(?<![\w])(?:[А-ЯЁA-Z]{2,}[0-9]*)(?![\w])"
MODALITY = {
    "weak": ("может", "могут", "мог", "могла", "возможно", "вероятно", "предположительно", "похоже", "ожидается", "предполагается", "способен", "способна", "можно"),
    "strong": ("точно", "однозначно", "обязательно", "гарантированно", "неизбежно", "доказано", "всегда", "никогда", "безусловно", "несомненно"),
    "negation": ("не", "нет", "нельзя", "никогда", "ни"),
    "condition": ("если", "при условии", "в случае", "только если", "если только"),
    "attribution": ("по данным", "по словам", "согласно", "сообщил", "сообщила", "сообщает", "заявил", "заявила", "отмечает", "отметил", "отметила", "как сообщил", "как заявила", "как заявил"),
    "causal": ("потому что", "поскольку", "поэтому", "из-за", "вследствие", "привело к", "приводит к"),
}

# Labels that stand for unknown provenance, and true words.
UNKNOWN_PROVENANCE = ("", "unknown", "unknown-source", "n/a", "na", "none", "null", "?")
TRUE_WORDS = ("1", "true", "yes", "y")

# Signals, gates and adjudication limits of the decision protocol.
SIGNALS = (
    # signal, feature, threshold, direction, quantile, hit count, least hits, rhythm only, size feature, least size
    ("road-sign-density", "road_per_1000", "road_per_1000_warn", "high", 0.95, "road", "min_road_hits", False, None, None),
    ("sentence-uniformity", "sentence_cv", "sentence_cv_min_info", "low", 0.05, None, None, True, "sentences", "min_sentences_for_cv"),
    ("long-sentence", "sentence_max_words", "long_sentence_words_info", "high", 0.95, None, None, False, None, None),
    ("one-sentence-paragraphs", "one_sentence_paragraph_ratio", "one_sentence_paragraph_ratio_info", "high", 0.95, None, None, True, "paragraphs", "min_paragraphs_for_ratio"),
    ("context-jargon-density", "jargon_per_1000", "jargon_per_1000_info", "high", 0.95, "jargon", "min_jargon_hits", False, None, None),
)
STRUCTURE_SIGNALS = ("sentence-uniformity", "long-sentence", "one-sentence-paragraphs")
DIVERSITY_GATES = {
    # sources, channels, largest source share (documents, words), author needed, author coverage, largest author share (documents, words)
    "prose": (3, 3, 0.6, 0.6, True, 0.5, 0.5, 0.5),
    "oral": (2, 2, 0.75, 0.75, True, 0.6, 0.5, 0.5),
    "product": (2, 2, 0.75, 0.75, False, 0.0, 0.6, 0.6),
    "technical": (2, 1, 0.8, 0.8, False, 0.0, 0.7, 0.7),
    "official": (2, 1, 0.8, 0.8, False, 0.0, 0.6, 0.6),
}
GATES = {
    "profile_documents": 50, "profile_words": 10000, "eligible_documents": 50, "eligible_words": 10000,
    "calibration_documents": 30, "calibration_words": 6000, "validation_documents": 20, "validation_words": 4000,
    "calibration_fraction": 0.6, "seed": "split-1",
    "removed_annotations": 10, "removed_non_actionable": 0.8, "off_annotations": 20, "off_precision": 0.25,
}
ANNOTATION_LABELS = ("actionable", "non_actionable", "uncertain")

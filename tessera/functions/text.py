"""Text functions as native expressions.

Patterns are compiled with Unicode classes and with newline as the only line end.  Places
in a text are counted in characters from zero.  All functions take and give columns and
pass nulls on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lexicons import LETTERS, TRUE_WORDS, UNKNOWN_PROVENANCE

#: Prefixes of Java patterns: Unicode classes, unix lines; and case-insensitive.
U, UI = "(?Ud)", "(?iUd)"
TOKEN = rf"[{LETTERS}]+(?:-[{LETTERS}]+)*|\d+(?:[.,]\d+)*"
WORD = rf"[{LETTERS}]+(?:[-'][{LETTERS}]+)*"
#: Marks around matches and in place of protected full stops; noncharacters and a rare sign.
OPEN, CLOSE, DOT = "\ufdd0", "\ufdd1", "∯"


def count(text: Column, pattern: str, flags: str = U) -> Column:
    return F.regexp_count(text, F.lit(flags + pattern)).cast("long")


def replace(text: Column, pattern: str, by: str, flags: str = U) -> Column:
    return F.regexp_replace(text, F.lit(flags + pattern), F.lit(by))


def matches(text: Column, pattern: str, flags: str = U) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))


def literal(phrase: str) -> str:
    """A phrase between characters that aren't letters."""
    return rf"(?<![{LETTERS}])\Q{phrase}\E(?![{LETTERS}])"


def tokens(text: Column) -> Column:
    return matches(text, TOKEN)


def token_count(text: Column) -> Column:
    return count(text, TOKEN)


def word_count(text: Column) -> Column:
    return count(text, WORD)


def _marked(text: Column, pattern: str, flags: str) -> Column:
    """The text cut into what lies between matches (even places) and matches (odd places)."""
    return F.split(F.regexp_replace(text, F.lit(f"{flags}({pattern})"), F.lit(f"{OPEN}$1{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)


def blank_out(text: Column, pattern: str, flags: str = U) -> Column:
    """Matches become spaces, their newlines stay, so no place in the text moves."""
    parts = _marked(text, pattern, flags)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, F.lit("[^\n]"), F.lit(" "))).otherwise(x)), "")


def hits(text: Column, pattern: str, flags: str = U) -> Column:
    """``array<struct<pos int, matched string>>`` of all matches, in order."""
    parts = _marked(text, pattern, flags)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<pos:int,matched:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.when(acc["i"] % 2 == 1, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("pos"), part.alias("matched"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), (acc["i"] + 1).alias("i"), grown.alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def family_hits(text: Column, patterns: list[str], flags: str = UI) -> Column:
    """Hits of several patterns by place; overlapping ones all count."""
    if not patterns:
        return F.array().cast("array<struct<pos:int,matched:string>>")
    return F.array_sort(F.flatten(F.array(*[hits(text, p, flags) for p in patterns])))


def mask_markup(text: Column) -> Column:
    """Front matter, code, addresses, links and tags out of the way."""
    for pattern in (r"\A---\s*\n(?s:.*?)\n---\s*(?:\n|$)", r"```(?s:.*?)```", r"`[^`\n]*`", r"https?://[^\s)>]+", r"\[[^\]]*\]\([^)]+\)", r"<[^>\n]+>"):
        text = blank_out(text, pattern)
    return text


def mask_quotes(text: Column) -> Column:
    """Quoted lines and quotations out of the way."""
    text = blank_out(text, r"^\s*>[^\n]*(?:\n|$)", "(?mUd)")
    for pattern in (r"«[^»\n]*»", r"“[^”\n]*”"):
        text = blank_out(text, pattern)
    return text


def protect_stops(text: Column) -> Column:
    """Full stops that end no sentence: in numbers, initials and abbreviations."""
    capital, name = "[А-ЯЁA-Z]", "[А-ЯЁA-Z][а-яёa-z-]{2,}"
    text = replace(text, r"(?<=\d)\.(?=\d)", DOT)
    for n in (3, 2, 1):  # initials before a name, the longest row first
        pattern = "".join(rf"\b({capital})\.(\s*)" for _ in range(n)) + f"(?={name})"
        text = replace(text, pattern, "".join(f"${2 * k + 1}{DOT}${2 * k + 2}" for k in range(n)))
    # two-part abbreviations: the inner stop always, the last one before a small letter or digit
    text = replace(text, r"\b([тТ])\.(\s*)([екдпнЕКДПН])\.(?=\s{1,23}[а-яё\d])", f"$1{DOT}$2$3{DOT}")
    text = replace(text, r"\b([тТ])\.(\s*)([екдпнЕКДПН])\.", f"$1{DOT}$2$3.")
    text = replace(text, r"\b((?iu:г|гг|ул|д|кв|стр|рис|табл|см|им|др|напр|млн|млрд|руб))\.(?=\s+[а-яё\d])", f"$1{DOT}")
    return replace(text, r"(?<!\d\s)\b(г|ул|им)\.(?=\s+[А-ЯЁ])", f"$1{DOT}")


#: A run without sentence ends, and the ends after it or the end of the text; possessive, so linear.
SENTENCE = r"(?<![^.!?…\n])[^.!?…\n]++(?:[.!?…]+|$)"


def sentences(text: Column) -> Column:
    """``array<struct<n bigint, text string>>`` of sentences of two tokens or more."""
    raw = F.transform(matches(protect_stops(text), SENTENCE), lambda x: F.translate(x, DOT, "."))
    return F.filter(F.transform(raw, lambda x: F.struct(token_count(x).alias("n"), x.alias("text"))), lambda s: s["n"] >= 2)


def sentence_places(text: Column) -> Column:
    """``array<struct<pos int, matched string, n bigint>>`` of the same sentences."""
    found = F.transform(hits(protect_stops(text), SENTENCE), lambda h: F.struct(h["pos"].alias("pos"), F.translate(h["matched"], DOT, ".").alias("matched")))
    return F.filter(F.transform(found, lambda h: F.struct(h["pos"].alias("pos"), h["matched"].alias("matched"), token_count(h["matched"]).alias("n"))), lambda s: s["n"] >= 2)


def _is_prose(block: Column) -> Column:
    return (block != "") & ~block.startswith("#") & ~block.startswith("```") & ~block.rlike(U + r"^(?:[-*+]|\d+[.)])\s") & (token_count(block) >= 3)


def _trimmed(block: Column) -> Column:
    return replace(block, r"\A\s+|\s+\z", "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines that are prose: no heading, fence or list item, three tokens or more."""
    return F.filter(F.transform(F.split(text, U + r"\n\s*\n+", -1), _trimmed), _is_prose)


def paragraph_places(text: Column) -> Column:
    """``array<struct<pos int, text string>>`` of the same blocks; ``pos`` is where the block starts, white space included."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<pos:int,text:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.when(acc["i"] % 2 == 0, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("pos"), _trimmed(part).alias("text"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), (acc["i"] + 1).alias("i"), grown.alias("out"))

    return F.filter(F.aggregate(_marked(text, r"\n\s*\n+", U), start, step, lambda acc: acc["out"]), lambda b: _is_prose(b["text"]))


def first_paragraph_place(text: Column) -> Column:
    """Where the first of these blocks starts; null without one."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("pos"))

    def step(acc: Column, part: Column) -> Column:
        found = F.when(acc["pos"].isNotNull(), acc["pos"]).when((acc["i"] % 2 == 0) & _is_prose(_trimmed(part)), acc["at"])
        return F.struct((acc["at"] + F.length(part)).alias("at"), (acc["i"] + 1).alias("i"), found.alias("pos"))

    return F.aggregate(_marked(text, r"\n\s*\n+", U), start, step, lambda acc: acc["pos"])


def per_thousand(hit_count: Column, words: Column) -> Column:
    return F.bround(F.when(words > 0, hit_count * F.lit(1000.0) / words).otherwise(F.lit(0.0)), 4)


def percentile_of(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array, zero for an empty one."""
    ordered = F.sort_array(values)
    place = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return F.when(F.size(values) == 0, 0.0).otherwise(low + (high - low) * (place - F.floor(place)))


def line_of(text: Column, place: Column) -> Column:
    """Number of the line that holds a place."""
    before = F.substring(text, F.lit(1), place)
    return (1 + F.length(before) - F.length(F.replace(before, F.lit("\n")))).cast("int")


def excerpt(text: Column, limit: int = 110) -> Column:
    flat = F.trim(replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def folded(text: Column) -> Column:
    """One space for white space, lower case."""
    return F.lower(replace(replace(text, r"\A\s+|\s+\z", ""), r"\s+", " "))


def clean_heading(text: Column) -> Column:
    bare = replace(replace(text, r"^\s*(?:\d+(?:\.\d+)*[.)]?\s+)", ""), r"[`*_]+", "")
    return replace(F.translate(F.lower(replace(bare, r"\A\s+|\s+\z", "")), "ё", "е"), r"\s+", " ")


def known_label(text: Column) -> Column:
    """A provenance label without case and extra spaces; null if it says that nothing is known."""
    plain = folded(text)
    return F.when(plain.isin(*UNKNOWN_PROVENANCE), None).otherwise(plain)


def truthy(text: Column, default: bool = False) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(F.lower(F.trim(text)).isin(*TRUE_WORDS))


def russian_share(text: Column) -> Column:
    """Cyrillic letters among Cyrillic and Latin ones."""
    own, all_ = count(text, "[А-Яа-яЁё]"), count(text, "[А-Яа-яЁёA-Za-z]")
    return F.when(all_ > 0, own / all_).otherwise(0.0)


def latin_share(text: Column) -> Column:
    own, all_ = count(text, "[A-Za-z]"), count(text, r"\p{L}")
    return F.when(all_ > 0, own / all_).otherwise(0.0)


def corpus_paragraph_count(text: Column) -> Column:
    """Blocks between blank lines with three words or more."""
    return F.size(F.filter(F.split(text, U + r"\n\s*\n", -1), lambda b: word_count(b) >= 3)).cast("long")


def normalize_url(url: Column) -> Column:
    """Scheme and host in small letters, the rest as it is."""
    parts = [F.regexp_extract(url, r"(?s)^([^:/?#]+://)([^/?#]*)(.*)$", k) for k in (1, 2, 3)]
    return F.when(parts[0] == "", url).otherwise(F.concat(F.lower(parts[0]), F.lower(parts[1]), parts[2]))


def slug(text: Column, limit: int = 80) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.left(F.when(plain == "", "doc").otherwise(plain), F.lit(limit))


def safe_normalize(text: Column) -> Column:
    """Format-only clean-up outside fences: no-break spaces, one trailing space, more than two blank lines."""
    ends_in_newline = text.endswith("\n")
    lines = F.split(F.when(ends_in_newline, F.left(text, F.length(text) - 1)).otherwise(text), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence = F.ltrim(line).startswith("```")
        plain = F.translate(line, "\u00a0", " ")
        plain = F.when(plain.endswith(" ") & ~plain.endswith("  "), F.left(plain, F.length(plain) - 1)).otherwise(plain)
        kept = F.when(fence | acc["code"], line).otherwise(plain)
        return F.struct((acc["code"] != fence).alias("code"), F.concat(acc["out"], F.array(kept)).alias("out"))

    joined = F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")
    return F.concat(F.regexp_replace(joined, "\n{4,}", "\n\n\n"), F.when(ends_in_newline, "\n").otherwise(""))


def shingle_set(words: Column, size: int = 5, most: int = 2500) -> Column:
    """Distinct shingles of an array of words, with a stride that keeps about ``most``; fewer words make one shingle."""
    n = F.size(words)
    stride = F.greatest(F.lit(1), F.floor((n - (size - 1)) / most).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n - size, stride), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(windows))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

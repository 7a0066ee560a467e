"""Counts and places of a text's prose in one pass over its characters, in Arrow batches.

The same as ``text.mask_markup``, ``mask_quotes``, ``sentences``, ``paragraphs``, ``token_count`` and
phrase patterns one after the other, which read every character some forty times.  Here the texts of
a stretch are one array of code points with a class each: tokens, sentences, blocks and
phrases are places where classes change.  Patterns run only over texts that hold what they start with.
"""

from __future__ import annotations

import hashlib
import re
import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import DOT, TOKEN, WORD

#: Characters of texts that are read together.
STRETCH = 250_000
_LETTER, _DIGIT, _SPACE, _END, _NEWLINE, _BEFORE_STOP = 1, 2, 4, 8, 16, 32
# as Java's Unicode classes have them
_WHITE = "\t-\r" + "".join(map(chr, (0x20, 0x85, 0xA0, 0x1680))) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_S = f"[{_WHITE}]"
_PAD = "\0"


def _code(char: str) -> int:
    return ord(char)


@cache
def _classes() -> np.ndarray:
    """The classes of each code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for low, high in ("АЯ", "ая", "ЁЁ", "ёё", "AZ", "az"):
        table[_code(low) : _code(high) + 1] |= _LETTER
    for low, high in ("АЯ", "ая", "ЁЁ", "ёё", "AZ"):
        table[_code(low) : _code(high) + 1] |= _BEFORE_STOP
    table[[c for c in range(sys.maxunicode + 1) if chr(c).isdecimal()]] |= _DIGIT
    white = re.compile(_S)
    table[[c for c in range(0x3001) if white.match(chr(c))]] |= _SPACE
    table[[_code(c) for c in ".!?…"]] |= _END
    table[_code("\n")] |= _NEWLINE
    return table


@cache
def _word() -> str:
    """The characters next to which Java's Unicode word boundary doesn't stand before a letter, as a class."""
    import unicodedata

    inside = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc")]
    inside += [0x200C, 0x200D, *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)]
    places = np.unique(inside)
    breaks = np.flatnonzero(np.diff(places) > 1)
    ranges = zip(places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]], strict=True)
    return "[" + "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in ranges) + "]"


@cache
def _stops() -> tuple[list[tuple[re.Pattern[str], str]], list[tuple[re.Pattern[str], str]]]:
    """The replacements of ``text.protect_stops``: those of any text, and those of Cyrillic abbreviations.

    Boundaries are looked at behind the first word, which is rare, and not before every character.
    """
    capital, name = "[А-ЯЁA-Z]", "[А-ЯЁA-Z][а-яёa-z-]{2,}"
    new = lambda word, size: f"(?:{word}(?<!{_word()}{'.' * size}))"
    either = lambda words: "|".join(new(w, len(w)) for w in words.split("|"))
    first = [(r"(?<=\d)\.(?=\d)", DOT)]
    for n in (3, 2, 1):
        first.append(("".join(rf"({new(capital, 1)})\.({_S}*)" for _ in range(n)) + f"(?={name})", "".join(rf"\{2 * k + 1}{DOT}\{2 * k + 2}" for k in range(n))))
    two = rf"({new('[тТ]', 1)})\.({_S}*)([екдпнЕКДПН])\."
    short = either("г|гг|ул|д|кв|стр|рис|табл|см|им|др|напр|млн|млрд|руб")
    before_name = "|".join(new(w, len(w)) + rf"(?<!\d{_S}{'.' * len(w)})" for w in ("г", "ул", "им"))
    second = [
        (rf"{two}(?={_S}{{1,23}}[а-яё\d])", rf"\1{DOT}\2\3{DOT}"),
        (two, rf"\1{DOT}\2\3."),
        (rf"(?i:({short}))\.(?={_S}+[а-яё\d])", rf"\1{DOT}"),
        (rf"({before_name})\.(?={_S}+[А-ЯЁ])", rf"\1{DOT}"),
    ]
    return tuple([(re.compile(p), by) for p, by in part] for part in (first, second))


_CYRILLIC_STOP = re.compile(r"[А-Яа-яЁё]\.")


def protected(text: str) -> str:
    """``text.protect_stops``: as long as before."""
    any_text, cyrillic = _stops()
    for pattern, by in any_text:
        text = pattern.sub(by, text)
    if not text.isascii() and _CYRILLIC_STOP.search(text):
        for pattern, by in cyrillic:
            text = pattern.sub(by, text)
    return text


# what a text must hold, and the pattern that is blanked out then
_MARKUP = (
    ("---", re.compile(rf"\A---{_S}*\n(?s:.*?)\n---{_S}*(?:\n|$)")),
    ("```", re.compile(r"```(?s:.*?)```")),
    ("`", re.compile(r"`[^`\n]*`")),
    ("://", re.compile(rf"https?://[^{_WHITE})>]+")),
    ("](", re.compile(r"\[[^\]]*\]\([^)]+\)")),
    ("<", re.compile(r"<[^>\n]+>")),
)
_QUOTES = ((">", re.compile(rf"^{_S}*>[^\n]*(?:\n|$)", re.M)), ("«", re.compile(r"«[^»\n]*»")), ("“", re.compile(r"“[^”\n]*”")))
_SENTENCE = re.compile(r"(?<![^.!?…\n])[^.!?…\n]++(?:[.!?…]+|$)")
_TOKEN = re.compile(TOKEN)
_NOT_NEWLINE = re.compile(r"[^\n]")


def masked(text: str, include_quotes: bool = False) -> str:
    """``text.mask_markup`` and, unless quotations count, ``mask_quotes``."""
    for needed, pattern in _MARKUP if include_quotes else _MARKUP + _QUOTES:
        if needed in text:
            text = pattern.sub(lambda m: _NOT_NEWLINE.sub(" ", m[0]), text)
    return text


def _sentence_count(text: str) -> int:
    """How many sentences of two tokens or more a block has."""
    return sum(len(_TOKEN.findall(s.replace(DOT, "."))) >= 2 for s in _SENTENCE.findall(protected(text)))


def _between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.searchsorted(places, high) - np.searchsorted(places, low)


def _token_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    letter, digit = (kinds & _LETTER) != 0, (kinds & _DIGIT) != 0
    joint, mark = codes == _code("-"), (codes == _code(".")) | (codes == _code(","))
    of = lambda own, link: own[2:] & ~own[1:-1] & ~(link[1:-1] & own[:-2])
    return np.flatnonzero(of(letter, joint) | of(digit, mark)) + 2


@dataclass(frozen=True)
class Families:
    """Phrases of each family, and how many places are wanted: all of a family (0), the first few, or none (no entry)."""

    phrases: dict[str, tuple[str, ...]]
    most: dict[str, int]


_COUNTS = ("words", "paragraphs", "single", "dashes", "colons", "ellipses")


class _Stretch:
    """Texts of some stretch as one array; a pad stands before, between and behind them, so that places start at 2."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        joined = _PAD + _PAD + _PAD.join(texts) + _PAD + _PAD
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kinds = _classes()[self.codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) + 1
        self.starts = self.ends - sizes

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of these sorted places each text has."""
        return _between(places, self.starts, self.ends)


def _phrase_places(low: _Stretch, phrase: str, starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Where a phrase stands between characters that aren't letters."""
    for k, char in enumerate(phrase):
        starts = starts[low.codes[starts + k] == _code(char)]
    return starts[~letters[starts + len(phrase)]]


def _families(texts: list[str], given: Families, out: dict[str, list]) -> None:
    low = _Stretch([t.lower() for t in texts])
    letters = (low.kinds & _LETTER) != 0
    words = np.flatnonzero(letters[1:] & ~letters[:-1]) + 1
    firsts = low.codes[words]
    same_size = None
    for family, phrases in given.phrases.items():
        found = []
        for phrase in phrases:
            if not phrase:
                continue
            if re.match(r"[А-Яа-яЁёA-Za-z]", phrase):
                begin = words[firsts == _code(phrase[0])]
            else:
                begin = np.flatnonzero(~letters[1:-1]) + 2
                begin = begin[(low.codes[begin] == _code(phrase[0])) & ~letters[begin - 1]]
            found.append((phrase, _phrase_places(low, phrase, begin[begin >= 2], letters)))
        out[f"n_{family}"].append(sum((low.per_text(p) for _, p in found), np.zeros(len(texts), np.int64)))
        if family not in given.most:
            continue
        if same_size is None:
            same_size = [len(a) == len(b) for a, b in zip(texts, low.texts, strict=True)]
        places = np.concatenate([p for _, p in found] or [np.zeros(0, np.int64)])
        sizes = np.concatenate([np.full(len(p), len(phrase)) for phrase, p in found] or [np.zeros(0, np.int64)])
        order = np.lexsort((sizes, places))
        places, sizes = places[order], sizes[order]
        own = low.text_of(places)
        local = places - low.starts[own] if len(places) else places
        rank = np.arange(len(places)) - np.searchsorted(own, own)
        keep = rank < given.most[family] if given.most[family] else np.ones(len(places), bool)
        packed = (local << 32 | sizes)[keep]
        counts = np.bincount(own[keep], minlength=len(texts))
        if not all(same_size):  # small letters that are longer or shorter move places: look them up in the text itself
            rows = np.split(packed, np.cumsum(counts)[:-1])
            for i, same in enumerate(same_size):
                if not same:
                    hits = sorted((m.start(), len(m[0])) for p in phrases if p for m in re.finditer(rf"(?i)(?<![А-Яа-яЁёA-Za-z]){re.escape(p)}(?![А-Яа-яЁёA-Za-z])", texts[i]))
                    rows[i] = np.array([a << 32 | z for a, z in hits[: given.most[family] or None]], np.int64)
            packed, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        out[f"at_{family}"].append((packed, counts))


def _listed(block: str) -> bool:
    """Whether a trimmed block is a list item."""
    return re.match(rf"(?:[-*+]|\d+[.)]){_S}", block) is not None


def _read(texts: list[str], out: dict[str, list]) -> None:
    """Adds what masked texts have to ``out``."""
    s = _Stretch(texts)
    codes, kinds = s.codes, s.kinds
    tokens = _token_starts(codes, kinds)
    out["words"].append(s.per_text(tokens))
    said = tokens  # tokens of sentences, where a protected stop is a stop again
    if (codes == _code(DOT)).any():
        again = np.where(codes == _code(DOT), np.uint32(_code(".")), codes)
        said = _token_starts(again, _classes()[again])

    # stops that end no sentence
    stop = (kinds & (_END | _NEWLINE)) != 0
    ends = (kinds & _END) != 0
    dots = np.flatnonzero(codes == _code("."))
    before, after = kinds[dots - 1], kinds[dots + 1]
    inside = dots[(before & after & _DIGIT) != 0]
    stop[inside] = ends[inside] = False
    by_pattern = np.unique(s.text_of(dots[(before & _BEFORE_STOP) != 0]))
    for i in by_pattern.tolist():
        kept = np.frombuffer(protected(texts[i]).encode("utf-32-le", "surrogatepass"), np.uint32)
        moved = np.flatnonzero(kept != codes[s.starts[i] : s.ends[i]]) + s.starts[i]
        stop[moved] = ends[moved] = False

    # sentences: runs between stops, with an end or the end of the text behind them
    stop[[0, 1]] = stop[s.ends] = stop[-1] = True
    stops = np.flatnonzero(stop)
    low, high = stops[:-1] + 1, stops[1:]
    n = _between(said, low, high)
    low, high, n = low[n >= 2], high[n >= 2], n[n >= 2]
    closed = ends[high]
    is_pad = np.zeros(len(codes), bool)
    is_pad[s.ends] = True
    whole = closed | is_pad[high] | ((codes[high] == _code("\n")) & is_pad[np.minimum(high + 1, len(codes) - 1)])
    own, at, till = s.text_of(low[whole]), low[whole], high[whole].copy()
    growing = np.flatnonzero(ends[till])
    while len(growing):
        till[growing] += 1
        growing = growing[ends[till[growing]]]
    counts = np.bincount(own, minlength=len(texts))
    out["lengths"].append((n[whole], counts))
    out["spans"].append(((at - s.starts[own]) << 32 | (till - at), counts))

    # blocks between white space that holds two newlines or more
    lines = np.flatnonzero(codes == _code("\n"))
    filled = np.cumsum((kinds & _SPACE) == 0, dtype=np.int64)
    linked = filled[lines[1:]] == filled[lines[:-1]]
    opens, closes = lines[:-1][linked & ~np.r_[False, linked[:-1]]] if len(linked) else lines[:0], lines[1:][linked & ~np.r_[linked[1:], False]] if len(linked) else lines[:0]
    start, end = np.sort(np.concatenate([s.starts, closes + 1])), np.sort(np.concatenate([s.ends, opens]))
    some = filled[end - 1] > filled[start - 1]
    start, end = start[some], end[some]
    first, last = np.searchsorted(filled, filled[start - 1] + 1), np.searchsorted(filled, filled[end - 1]) + 1
    head = codes[first]
    prose = (_between(tokens, first, last) >= 3) & (head != _code("#"))
    odd = (kinds[first] & _DIGIT != 0) | np.isin(head, [_code(c) for c in "`-*+"])
    owner = s.text_of(first)
    for b in np.flatnonzero(prose & odd).tolist():
        i = int(owner[b])
        block = texts[i][first[b] - s.starts[i] : last[b] - s.starts[i]]
        prose[b] = not block.startswith("```") and not _listed(block)
    out["paragraphs"].append(np.bincount(owner[prose], minlength=len(texts)))
    place = np.full(len(texts), -1, np.int64)
    place[owner[prose][::-1]] = (start - s.starts[owner])[prose][::-1]
    out["first"].append(place)
    block = np.searchsorted(first, high - 1, "right") - 1  # of each run with two tokens
    inner = closed | (high >= last[block]) if len(first) else closed
    sentences = np.bincount(block[inner], minlength=len(first))
    if len(by_pattern):  # what a stop stands before may differ within the block alone
        for b in np.flatnonzero(prose & np.isin(owner, by_pattern)).tolist():
            i = int(owner[b])
            sentences[b] = _sentence_count(texts[i][first[b] - s.starts[i] : last[b] - s.starts[i]])
    out["single"].append(np.bincount(owner[prose & (sentences <= 1)], minlength=len(texts)))

    # marks
    short = np.flatnonzero(codes == _code("–"))
    short = short[(kinds[short - 1] & kinds[short + 1] & _SPACE) != 0]
    out["dashes"].append(s.per_text(np.flatnonzero(codes == _code("—"))) + s.per_text(short))
    colons = np.flatnonzero(codes == _code(":"))
    out["colons"].append(s.per_text(colons[(kinds[colons - 1] & kinds[colons + 1] & _DIGIT) == 0]))
    rows = dots[np.r_[True, np.diff(dots) > 1]] if len(dots) else dots
    threes = np.diff(np.r_[np.searchsorted(dots, rows), len(dots)]) // 3
    out["ellipses"].append(s.per_text(np.flatnonzero(codes == _code("…"))) + np.bincount(s.text_of(rows), threes, len(texts)).astype(np.int64))


def measure(texts: list[str | None], given: Families, include_quotes: bool = False) -> pa.StructArray:
    """One row for each text, a missing one counting as empty; ``style`` only where masking changed something."""
    lists = ["lengths", "spans", *[f"at_{f}" for f in given.phrases if f in given.most]]
    names = [*_COUNTS, "first", *[f"n_{f}" for f in given.phrases]]
    out: dict[str, list] = {k: [] for k in (*names, *lists)}
    style: list[str | None] = []
    group, size = [], 0
    for place, text in enumerate(texts):
        plain = masked(text or "", include_quotes)
        style.append(None if plain == (text or "") else plain)
        group.append(plain)
        size += len(plain)
        if size >= STRETCH or place == len(texts) - 1:
            _read(group, out)
            _families(group, given, out)
            group, size = [], 0
    columns = {"style": pa.array(style, pa.string())}
    for k in names:
        columns[k] = pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64())
    for k in lists:
        values = np.concatenate([v for v, _ in out[k]]) if out[k] else np.zeros(0, np.int64)
        counts = np.concatenate([c for _, c in out[k]]) if out[k] else np.zeros(0, np.int64)
        columns[k] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values.astype(np.int64), pa.int64()))
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def measured(text: Column, phrases: dict[str, tuple[str, ...]], most: dict[str, int] | None = None, include_quotes: bool = False) -> Column:
    """``struct`` of a text's masked ``style`` (null where it is the text), counts, ``lengths`` and ``spans`` of
    sentences, ``first`` (place of the first prose block or -1), and ``n_<family>``, ``at_<family>`` of phrases.

    Places and sizes in characters are packed as ``place << 32 | size``.
    """
    given = Families(dict(phrases), dict(most or {}))
    kinds = ", ".join(["style string", *[f"{k} bigint" for k in (*_COUNTS, "first", *[f"n_{f}" for f in phrases])], *[f"{k} array<bigint>" for k in ("lengths", "spans", *[f"at_{f}" for f in phrases if f in given.most])]])

    @F.arrow_udf(f"struct<{kinds.replace(' ', ':').replace(',:', ', ')}>")
    def run(texts: pa.Array) -> pa.Array:
        return measure(texts.to_pylist(), given, include_quotes)

    return run(text)


_ONE_WORD = re.compile(WORD)


def _mixed(sofar: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Digests of sequences that go on by one word."""
    out = (sofar ^ digests) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _shingle_sets(texts: list[str], size: int, most: int) -> list[np.ndarray]:
    """Sorted distinct digests of each text's shingles, as ``text.shingle_set`` chooses them."""
    words = [_ONE_WORD.findall(t.lower()) for t in texts]
    counts = [len(w) for w in words]
    every = np.array([x for w in words for x in w], object)
    digests = pd.util.hash_array(every, categorize=False) if len(every) else np.zeros(0, np.uint64)
    windows = np.full(max(len(every) - size + 1, 0), np.uint64(size))
    for k in range(size):
        windows = _mixed(windows, digests[k : k + len(windows)])
    sets, at = [], 0
    for n in counts:
        if 0 < n < size:
            short = np.full(1, np.uint64(n))
            for k in range(n):
                short = _mixed(short, digests[at + k : at + k + 1])
            sets.append(short)
        else:
            sets.append(np.unique(windows[at : at + n - size + 1 : max(1, (n - size + 1) // most)]) if n else windows[:0])
        at += n
    return sets


def shingles(texts: list[str | None], size: int, most: int, sampled: int) -> pa.StructArray:
    """One row for each text; see ``shingled``."""
    sets: list[np.ndarray] = []
    words: list[np.ndarray] = []
    group, length = [], 0
    for place, text in enumerate(texts):
        group.append(text or "")
        length += len(group[-1])
        if length >= STRETCH or place == len(texts) - 1:
            stretch = _Stretch(group)
            words.append(stretch.per_text(_token_starts(stretch.codes, stretch.kinds)))
            sets += _shingle_sets(group, size, most)
            group, length = [], 0
    counted = np.concatenate(words) if words else np.zeros(0, np.int64)
    columns = {
        "words": pa.array(counted, pa.int64(), mask=np.array([t is None for t in texts], bool)),
        "n": pa.array([len(s) for s in sets], pa.int32()),
        "mark": pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in sets], pa.string()),
    }
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    first = every % np.uint64(sampled) == 0
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for name, chosen in (("few", first), ("rest", ~first)):
        counts = np.bincount(owner[chosen], minlength=len(sets))
        columns[name] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(every[chosen].view(np.int64), pa.int64()))
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def shingled(text: Column, size: int = 5, most: int = 2500, sampled: int = 6) -> Column:
    """``struct<words, n, mark, few, rest>``: tokens of a text (null without one), and digests of its ``shingle_set``.

    One in ``sampled`` stands in ``few``, by digest; ``n`` counts both parts, and equal sets have one ``mark``.
    A word's digest is SipHash of 64 bits, a shingle's mixes those of its words in order.
    """

    @F.arrow_udf("struct<words: bigint, n: int, mark: string, few: array<bigint>, rest: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        return shingles(texts.to_pylist(), size, most, sampled)

    return run(text)

"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

1. Base.  E-mail addresses, IP addresses, card and phone numbers by fixed rules, leftmost
   and without overlap for each kind.  Keys of a fixed form and long hexadecimal strings
   are seeds of a fifth kind, ``secret``.
2. Candidates.  Every other token with a digit, "@" or "=" might be an identifier; a token
   is read in the pieces that commas, quotes, brackets and the like make of it.  Seeds
   and candidates carry their lexical contexts: the word before, the two words before,
   the word after, and a leading ``key=`` or ``key:``, all of any length.
3. Graph.  Values and the contexts that at least three of them have are the graph; contexts
   are 64-bit digests and only ever joined by key.  A pass over all texts counts how often
   each such context occurs, whatever stands there; a bitmap of fixed size spares others.
4. Generations.  A context is a pattern of a kind if at least three different instances have it:
   seeds at first, then what was accepted before as well, so that identifiers that one pattern
   found teach the next.  A pattern's trust is the summed scores of its instances over all its
   occurrences; a candidate scores the chance that one of its patterns is right.  Seeds score
   one.  A pattern that ordinary words follow therefore stays weak, and one whose occurrences are
   nearly all known is trusted.  Generations end when nothing new is accepted.
5. Candidates that end above ``accept`` are added to the spans as ``found_<kind>``, seeds of
   the fifth kind as ``secret``.  Base spans stay as they are.

Null and empty texts have no spans.  Rows are told apart by a number given on the way in,
so null and repeated doc_ids give one result for each row; a value scores alike wherever
it stands.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WORD, WordDigests, batches, mix, signed
from tessera.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*KINDS, "secret", *(f"found_{k}" for k in (*KINDS, "secret"))))}
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,})(?![0-9A-Za-z])")
_TOKEN = re.compile(WORD)
_MARKS = re.compile(r"[0-9@=]")
#: Leading bits of a context's digest that the bitmap tells apart, and digests that tell kinds of contexts apart.
MARKED = 23
PLACES = {c: np.uint64(i + 1) for i, c in enumerate("LMRK")}
_PIECE = re.compile(r"(?:([A-Za-z_][A-Za-z0-9_-]++)[\"']?[=:][\"']?)?([^&,;\"'?{}\[\]]+)")
_EDGES = "\"'`()[]{}<>,;.!?#*$%&|"


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each "@": the run of address characters before it, the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = max(last, start)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _MARKS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def pieces(token: str) -> Iterator[tuple[str | None, int, int]]:
    """Key or nothing, start and end of the values in a token."""
    for m in _PIECE.finditer(token):
        yield m[1], m.start(2), m.end(2)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, str, list[str]]]:
    """``(start, end, kind or nothing, value, contexts)`` of seeds and of tokens that might be identifiers."""
    if not _MARKS.search(text):
        return []
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in spans]
    word = lambda i: text[spans[i][0] : spans[i][1]].lower()

    def contexts(start: int, end: int, key: str | None) -> list[str]:
        first = bisect_left(starts, start + 1) - 1
        last = bisect_left(starts, end) - 1
        out = [f"K {key}"] if key else []
        if first > 0 and not key:
            out.append(f"L {word(first - 1)}")
            if first > 1:
                out.append(f"M {word(first - 2)} {word(first - 1)}")
        if last + 1 < len(spans) and not key:
            out.append(f"R {word(last + 1)}")
        return out

    out: list[tuple[int, int, str | None, str, list[str]]] = []
    opened, closed = [], []  # base spans, overlapping ones joined
    keys: tuple[int, dict[int, str]] = (-1, {})  # keys before the values of a token
    for kind, a, b in base:
        first = bisect_left(starts, a + 1) - 1
        if keys[0] != first:
            low, high = spans[first]
            keys = first, {low + s: key for key, s, _ in pieces(text[low:high]) if key}
        key = keys[1].get(a)
        out.append((a, b, kind, text[a:b], contexts(a, b, key.lower() if key else None)))
        if closed and a < closed[-1]:
            closed[-1] = max(closed[-1], b)
        else:
            opened.append(a)
            closed.append(b)
    for a, b in spans:
        token = text[a:b]
        if not _MARKS.search(token):
            continue
        for key, low, high in pieces(token):
            low, high = a + low, a + high
            before = bisect_left(opened, high) - 1
            if before >= 0 and closed[before] > low:
                continue
            bare = text[low:high].lstrip(_EDGES)
            start, value = high - len(bare), bare.rstrip(_EDGES)
            if len(value) >= 4 and (key or any(c.isdigit() or c == "@" for c in value)):
                secret = _SECRET.fullmatch(value)
                out.append((start, start + len(value), "secret" if secret else None, value, contexts(start, start + len(value), key.lower() if key else None)))
    return out


_DIGESTS = WordDigests()


def digests(kind: str, words: list[str], seconds: list[str] | None = None) -> np.ndarray:
    """Digests of contexts of one kind."""
    found = mix(_DIGESTS.of(words), PLACES[kind])
    return found if seconds is None else mix(found, _DIGESTS.of(seconds))


def _digested(contexts: list[str]) -> list[int]:
    parts = [(c[0], *c[2:].split(" ")) for c in contexts]
    return [int(signed(digests(kind, [word], second or None))[0]) for kind, word, *second in parts]


_FIRST = "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, cands array<struct<s:int,e:int,kind:string,value:string,ctx:array<bigint>>>"


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        base = [base_spans(x or "") for x in frame["text"]]
        counts = [Counter(k for k, _, _ in b) for b in base]
        cands = [[{"s": a, "e": e, "kind": k, "value": v, "ctx": _digested(c)} for a, e, k, v, c in candidates(x or "", b)] for x, b in zip(frame["text"], base, strict=True)]
        yield pd.DataFrame({"rid": frame["rid"], "doc_id": frame["doc_id"].astype("Int64"), **{f"n_{k}": [c[k] for c in counts] for k in KINDS}, "base": [written(b) for b in base], "cands": cands})


def _occurrences(held):
    """How often each context that the bitmap marks stands before, around or after any token at all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool)
        for frame in batches(frames):
            parts = [_TOKEN.findall((text or "").lower()) for text in frame["text"]]
            words = _DIGESTS.of([w for p in parts for w in p])
            ends = np.cumsum([len(p) for p in parts])
            followed, preceded = np.ones(len(words), bool), np.ones(len(words), bool)
            filled = [len(p) > 0 for p in parts]
            followed[ends[filled] - 1] = False
            preceded[(ends - [len(p) for p in parts])[filled]] = False
            around = np.flatnonzero(followed[:-1] & followed[1:])
            keyed = [key.lower() for text in frame["text"] if text and ("=" in text or ":" in text) for w in _TOKEN.findall(text) if "=" in w or ":" in w for key, *_ in pieces(w) if key]
            left = mix(words, PLACES["L"])[followed]
            right = mix(words, PLACES["R"])[preceded]
            pairs = mix(mix(words[around], PLACES["M"]), words[around + 1])
            found = np.concatenate([x[marks[x >> np.uint64(64 - MARKED)]] for x in (left, right, pairs, digests("K", keyed))])
            found, n = np.unique(signed(found), return_counts=True)
            yield pd.DataFrame({"ctx": found, "occurs": n.astype(np.int64)})

    return run


def _bitmap(contexts: DataFrame) -> bytes:
    """The leading bits of the contexts' digests, one bit for each value."""
    place = F.shiftrightunsigned("ctx", 64 - MARKED)
    bits = contexts.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32_767))).alias("bits"))
    out = np.zeros((1 << MARKED) // 8, np.uint8)
    for part, own in bits.collect():
        out[part * 4096 : part * 4096 + len(own)] = np.frombuffer(bytes(own), np.uint8)
    return out.tobytes()


def find(docs: DataFrame, accept: float = 0.6, generations: int = 8, least: int = 3) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` of every row."""
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = cut(texts.mapInPandas(_scan, _FIRST))
    each = first.where(F.size("cands") > 0).select("rid", F.inline("cands"))
    edges = cut(each.select("kind", "value", F.explode("ctx").alias("ctx")).groupBy("kind", "value", "ctx").agg(F.count(F.lit(1)).alias("n")))
    found = _accepted(_graph(edges, texts, least), accept, generations, least)
    added = each.join(found, "value", "left").where("kind = 'secret' or (kind is null and found is not null)")
    spans = added.groupBy("rid").agg(F.collect_list(F.struct("s", "e", F.coalesce("kind", F.concat(F.lit("found_"), "found")).alias("k"))).alias("more"))
    joined = first.drop("cands").join(spans, "rid", "left")
    return joined.mapInPandas(_merge, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def _graph(edges: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``kind, value, ctx, n, occurs`` of contexts that could become patterns; results that are joined by key are written out, so that joins can split a hot one."""
    often = cut(edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= least).select("ctx"))
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(often))
    counted = texts.select("text").mapInPandas(_occurrences(held), "ctx long, occurs long").groupBy("ctx").agg(F.sum("occurs").alias("occurs"))
    return cut(edges.join(cut(counted.join(often, "ctx")), "ctx"))


def _accepted(graph: DataFrame, accept: float, generations: int, least: int) -> DataFrame:
    """``value, found``: accepted values with their best kind."""
    seeds = graph.where("kind is not null").select(F.col("kind").alias("as"), "value", F.lit(1.0).alias("score")).distinct()
    unknown = graph.where("kind is null")
    scores, taken = graph.sparkSession.createDataFrame([], "as string, value string, score double"), -1
    for _ in range(generations):
        instances = cut(seeds.unionByName(scores))
        known = graph.join(instances, "value").where("kind is null or kind = as")
        patterns = known.groupBy("as", "ctx").agg((F.sum(F.col("n") * F.col("score")) / F.max("occurs")).alias("trust"), F.count_if(F.col("score") >= accept).alias("support"))
        patterns = cut(patterns.where(F.col("support") >= least).select("as", "ctx", F.least("trust", F.lit(0.999)).alias("trust")))
        scores = cut(unknown.join(patterns, "ctx").groupBy("as", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score")))
        before, taken = taken, scores.where(F.col("score") >= accept).count()
        if taken == before:
            break
    return scores.where(F.col("score") >= accept).groupBy("value").agg(F.max_by("as", F.struct("score", "as")).alias("found"))


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        spans = []
        for base, more in zip(frame["base"], frame["more"], strict=True):
            own = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
            spans.append(written(own + [(m["k"], m["s"], m["e"]) for m in (more if more is not None else ())]))
        yield frame.drop(columns=["rid", "more"]).assign(spans=spans, doc_id=frame["doc_id"].astype("Int64"))

"""Requirement checks of specifications: a line program with document rules.

Lines are split as by any Unicode line end; a trailing empty line doesn't count.  A
document's lines stay in one row as an array, so fences, headings and document rules
need no shuffle.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators.features import once

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
FOUND = "array<struct<code:string,line:int,excerpt:string,detail:map<string,string>>>"


def split_lines(text: Column) -> Column:
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _has(line: Column, pattern: str) -> Column:
    return line.rlike(T.UI + pattern)


def is_fence(line: Column) -> Column:
    return T.replace(line, r"^\s+", "").startswith("```")


def numbered_lines(docs: DataFrame, text: str = "text", lines: Callable[[Column], Column] = split_lines, fence: Callable[[Column], Column] = is_fence) -> DataFrame:
    """Adds ``lines``: ``array<struct<no int, body string, code boolean, fence boolean>>`` with the state of fences.

    ``lines`` and ``fence`` say what a line and what a fence is.
    """
    df = once(docs, body=F.coalesce(F.col(text), F.lit("")))
    df = once(df, raw=lines(F.col("body")))
    start = F.struct(F.lit(0).alias("no"), F.lit(False).alias("code"), F.array().cast("array<struct<no:int,body:string,code:boolean,fence:boolean>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        row = F.struct((acc["no"] + 1).alias("no"), line.alias("body"), acc["code"].alias("code"), fence(line).alias("fence"))
        return F.struct((acc["no"] + 1).alias("no"), (acc["code"] != fence(line)).alias("code"), F.concat(acc["out"], F.array(row)).alias("out"))

    return once(df, lines=F.aggregate("raw", start, step, lambda acc: acc["out"])).drop("raw")


def fence_states(docs: DataFrame, key: str, text: str = "text", lines: Callable[[Column], Column] = split_lines, fence: Callable[[Column], Column] = is_fence) -> DataFrame:
    """``(key, line, in_code)`` of all lines; a fence line itself counts as outside."""
    return numbered_lines(docs, text, lines, fence).select(key, F.inline("lines")).select(key, F.col("no").cast("long").alias("line"), (F.col("code") & ~F.col("fence")).alias("in_code"))


def requirement_lines(docs: DataFrame, marker: str = L.REQ_MARKER, req_id: str = L.REQ_ID, text: str = "text") -> DataFrame:
    """Adds ``lines`` and ``reqs``: prose lines with an obligation or an identifier."""
    prose = lambda x: ~x["code"] & ~x["fence"] & _filled(x["body"]) & ~x["body"].rlike(T.U + L.HEADING)
    return once(numbered_lines(docs, text), reqs=F.filter("lines", lambda x: prose(x) & (_has(x["body"], marker) | _has(x["body"], req_id))))


def _filled(line: Column) -> Column:
    return line.rlike(T.U + r"\S")


def requirement_key(line: Column, req_id: str = L.REQ_ID) -> Column:
    """What two lines must share to state the same requirement; null under 25 characters."""
    bare = F.regexp_replace(line, F.lit(T.UI + req_id), F.lit(""))
    plain = F.trim(T.replace(F.translate(F.lower(bare), "ё", "е"), r"[^\p{L}\p{N}_]+", " "))
    return F.when(F.length(plain) >= 25, plain)


def repeated_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line, first_line)`` of lines that say what an earlier line of their document says, letter case and punctuation aside."""
    lines = docs.select(key, F.posexplode(split_lines(F.col(text))).alias("i", "body"))
    keyed = lines.select(key, (F.col("i") + 1).cast("long").alias("line"), requirement_key(F.col("body")).alias("said")).where("said is not null")
    first = keyed.groupBy(key, "said").agg(F.min("line").alias("first_line"))
    return keyed.join(first, [key, "said"]).where("line > first_line").select(key, "line", "first_line")


def requirement_findings(docs: DataFrame, profile: str = "generic", text: str = "text") -> DataFrame:
    """One row for each finding: columns of ``docs``, then ``code, severity, line, excerpt, detail``; first of equal ones only."""
    if profile not in L.REQUIRED_SECTIONS:
        raise ValueError(f"unknown profile: {profile}")
    df = requirement_lines(docs, text=text)
    cut = lambda x: F.left(F.trim(T.replace(x, r"\s+", " ")), F.lit(240))
    no_detail = F.lit(None).cast("map<string,string>")
    none = F.array().cast(FOUND)
    row = lambda code, no, sample, detail=no_detail: F.struct(F.lit(code).alias("code"), no.cast("int").alias("line"), cut(sample).alias("excerpt"), detail.alias("detail"))
    marked = lambda b: _has(b, L.REQ_MARKER)
    unverified = lambda b: ~_has(b, L.VERIFY_HINT)
    listed = lambda b: (T.count(b, L.BRANCH, T.UI) >= 2) & (T.count(b, "[,;]") >= 2) & (F.length(b) > 170)
    rules = (
        ("TZ002", lambda b: _has(b, L.SUBJECTIVE)),
        ("TZ003", lambda b: _has(b, L.WEAK) & ~_has(b, L.CONFLICT)),
        ("TZ009", lambda b: _has(b, L.CONFLICT)),
        ("TZ007", lambda b: _has(b, L.VAGUE_TIME)),
        ("TZ006", lambda b: marked(b) & _has(b, L.AMBIGUOUS_OBJECT)),
        ("TZ008", lambda b: _has(b, L.SECURITY) & unverified(b)),
        ("TZ004", lambda b: (T.count(b, L.REQ_MARKER, T.UI) >= 2) | listed(b)),
        ("TZ005", lambda b: marked(b) & (_has(b, L.NON_FUNCTIONAL) | _has(b, L.SUBJECTIVE) | _has(b, L.VAGUE_TIME)) & unverified(b)),
    )
    of_line = lambda x: F.filter(F.array(*[F.when(test(x["body"]), row(code, x["no"], x["body"])) for code, test in rules]), lambda f: f.isNotNull())
    keyed = F.filter(F.transform("reqs", lambda x: F.struct(x["no"].alias("no"), x["body"].alias("body"), requirement_key(x["body"]).alias("key"))), lambda x: x["key"].isNotNull())
    df = once(df, keyed=keyed)
    first_of = lambda x: F.array_min(F.transform(F.filter("keyed", lambda y: y["key"] == x["key"]), lambda y: y["no"]))
    firsts = F.transform("keyed", lambda x: F.struct(x["no"].alias("no"), x["body"].alias("body"), first_of(x).alias("first")))
    repeats = F.transform(F.filter(firsts, lambda x: x["no"] > x["first"]), lambda x: row("TZ010", x["no"], x["body"], F.create_map(F.lit("first_line"), x["first"].cast("string"))))
    df = once(df, obliged=F.filter("reqs", lambda x: marked(x["body"])), repeats=repeats)
    obliged = F.size("obliged")
    with_ids = F.size(F.filter("obliged", lambda x: _has(x["body"], L.REQ_ID)))
    forms = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), T.count(F.col("body"), p, T.UI).alias("n")) for n, p in L.NORM_FORMS.items()]), lambda x: x["n"] >= 2)
    df = once(df, forms=forms)
    heading = lambda x: F.when(x["body"].rlike(T.U + L.HEADING), T.clean_heading(F.regexp_extract(x["body"], T.U + L.HEADING, 1))).when(x["body"].rlike(T.U + L.NUMBERED_HEADING), T.clean_heading(x["body"]))
    df = once(df, headings=F.array_join(F.filter(F.transform("lines", heading), lambda h: h.isNotNull()), "\n"))
    document = [
        F.when((obliged >= 8) & (with_ids * 2 < obliged), F.array(row("TZ011", F.lit(1), F.lit("obligations without identifiers"), F.create_map(F.lit("requirements"), obliged.cast("string"), F.lit("with_ids"), with_ids.cast("string"))))),
        F.when((obliged > 0) & ~_has(F.col("body"), L.ACCEPTANCE), F.array(row("TZ012", F.lit(1), F.lit("no acceptance section")))),
        F.when((F.size("forms") >= 3) & (F.aggregate("forms", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= 8), F.array(row("TZ013", F.lit(1), F.lit("several forms of obligation"), F.map_from_entries(F.transform("forms", lambda x: F.struct(x["k"], x["n"].cast("string"))))))),
    ]
    for variants in L.REQUIRED_SECTIONS[profile]:
        names = [" ".join(v.replace("ё", "е").split()) for v in variants]
        document.append(F.when(~T.any_of([F.contains(F.col("headings"), F.lit(n)) for n in names]), F.array(row("TZ014", F.lit(1), F.lit(variants[0]), F.create_map(F.lit("expected_section"), F.lit(variants[0]), F.lit("profile"), F.lit(profile))))))
    placeholders = F.transform(F.filter("lines", lambda x: ~x["code"] & ~x["fence"] & _has(x["body"], L.PLACEHOLDER)), lambda x: row("TZ001", x["no"], x["body"]))
    everything = F.concat(placeholders, F.flatten(F.transform("reqs", of_line)), F.col("repeats"), *[F.coalesce(d, none) for d in document])
    severity = F.create_map(*[F.lit(x) for pair in L.SEVERITY.items() for x in pair])
    found = once(df, all=everything).select(*docs.columns, F.posexplode("all").alias("i", "f"), "all")
    key = lambda f: F.struct(f["code"].alias("code"), f["line"].alias("line"), f["excerpt"].alias("excerpt"))
    earlier = F.exists(F.slice("all", 1, F.col("i")), lambda f: key(f) == key(F.col("f")))
    return found.where(~earlier).select(*docs.columns, F.col("f.code").alias("code"), severity[F.col("f.code")].alias("severity"), F.col("f.line").alias("line"), F.col("f.excerpt").alias("excerpt"), F.col("f.detail").alias("detail"))

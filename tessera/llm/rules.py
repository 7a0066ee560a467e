"""Quality rules with adaptive thresholds, in DataFrame operations only.

Five measures of a text (integers, so that sketches and SQL agree to the last bit) are
summed up per language and source in mergeable quantile sketches: a value below 128 is
its own bucket, a larger one keeps its seven leading bits, which bounds the error of a
quantile to one part in 64 at any count.  Merging is adding counts, so partial sketches
form before the shuffle, hot sources are pre-aggregated, and sketches of a language or of
everything come from adding those of its sources.  A sketch is as small as its buckets, of
which there are less than 128 and 64 more for each power of two.

Quartiles of a source lean towards those of its language, and these towards the corpus's,
as if ``weight`` documents of the larger group were in the smaller: a source of any size has
thresholds of its own, and the fewer its documents, the nearer they are to its language's.
A measure's upper fence is the upper quartile plus ``SPREAD`` times the quartile
distance, which counts as a stated least distance where a source hardly varies; word
length has a lower fence too.  The fences are joined back by language and source, and a
document stays if it passes the base rules and lies within all.

Null and empty texts have no words and fail the base rules.  Null languages and sources
are groups of their own.  Repeated rows and ties count as they come, one result for each
row; null doc_ids stay null.  Columns besides the four named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPREAD = 3
#: Documents of a larger group that a smaller one is taken to hold besides its own.
WEIGHT = 100
#: Measure and the least quartile distance that counts for its fences.
MEASURES = {"symbols": 200, "length": 50, "dup_lines": 1700, "repeats": 1000, "capitals": 500}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often later lambdas read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _without(column: str, characters: str) -> Column:
    return F.translate(F.col(column), characters, "")


def base_measures(docs: DataFrame, fewer_bits: int = 0) -> DataFrame:
    """``doc_id, lang, source`` and the word, symbol, line and repetition counts of every row; tests make digests clash by ``fewer_bits``."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = _once(named, "w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    sized = split.withColumn("n_words", F.size("w")).withColumn("shift", F.length(F.bin(F.size("w"))) + fewer_bits)
    # sorted keys: leading bits of a three-word window's digest, then its first word's place
    keys = F.when(F.col("n_words") >= 3, F.expr("sort_array(transform(sequence(0, n_words - 3), i -> coalesce(shiftleft(shiftright(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), shift), shift) | i, 0L)))")).otherwise(F.expr("cast(array() as array<bigint>)"))
    keyed = _once(sized, "k", keys)
    # neighbours with equal leading bits, confirmed word by word; -1 tells of two windows that only share the bits
    at = "cast({0} - shiftleft(shiftright({0}, shift), shift) as int)"
    x, y = at.format("x"), at.format("get(k, j + 1)")
    same = " and ".join(f"get(w, {x} + {o}) = get(w, {y} + {o})" for o in range(3))
    pairs = F.expr(f"filter(transform(k, (x, j) -> if(shiftright(x, shift) = shiftright(get(k, j + 1), shift), if({same}, array({x}, {x} + 1, {x} + 2, {y}, {y} + 1, {y} + 2), array(-1)), null)), p -> p is not null)")
    found = _once(keyed, "p", F.array_distinct(F.flatten(pairs)))
    # where bits clash, the windows themselves are sorted and looked up; let() names a value inside an expression
    let = lambda name, value, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    grams = "transform(sequence(0, n_words - 3), i -> concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)))"
    twice = "array_distinct(filter(transform(gs, (x, j) -> if(x = get(gs, j - 1), x, null)), x -> x is not null))"
    covered = "size(array_distinct(flatten(filter(transform(g, (x, i) -> if(array_contains(tw, x), array(i, i + 1, i + 2), null)), q -> q is not null))))"
    exact = F.expr(let("g", grams, let("gs", "array_sort(g)", let("tw", twice, covered))))
    lines = F.expr(r"filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    repeated = _once(found, "n_repeat_words", F.when(F.array_contains("p", -1), exact).otherwise(F.size("p")).cast("long"))
    lined = _once(repeated, "lines", lines)
    return lined.select(
        "doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"),
        F.length(_without("t", SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without("t", SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(_without("t", CAPITALS))).cast("long").alias("n_capitals"),
    )


def measures() -> dict[str, Column]:
    share = lambda a, b, scale: F.when(F.col(b) > 0, F.expr(f"({a} * {scale}) div {b}")).otherwise(F.lit(0)).cast("long")
    return {"symbols": share("n_symbols", "n_words", 10000), "length": share("word_chars", "n_words", 100), "dup_lines": share("n_dup_lines", "n_lines", 10000), "repeats": share("n_repeat_words", "n_words", 10000), "capitals": share("n_capitals", "word_chars", 10000)}


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, n)`` over rows with words."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"m_{m}").alias("v")) for m in MEASURES])
    long = measured.where("n_words > 0").select("lang", "source", F.inline(each))
    bucket = F.expr("case when v < 128 then v else shiftleft(shiftright(v, length(bin(v)) - 7), length(bin(v)) - 7) end")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``keys, measure, docs, q1, q3``: a group's buckets are a bounded array, in which the quartiles are looked up."""
    held = sketch.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("held"), F.sum("n").alias("docs"))
    reached = "aggregate(held, named_struct('upto', 0L, 'at', cast(null as bigint)), (a, x) -> named_struct('upto', a.upto + x.n, 'at', coalesce(a.at, if((a.upto + x.n) * 4 >= docs * {0}, x.bucket, null))), a -> a.at)"
    return held.select(*keys, "measure", "docs", F.expr(reached.format(1)).alias("q1"), F.expr(reached.format(3)).alias("q3"))


def _leaning(quarter: str, weight: int) -> Column:
    """A group's quartile with that of the larger group (``up_``) counted as ``weight`` documents; rounded towards zero."""
    return F.expr(f"(docs * {quarter} + {weight} * up_{quarter}) div (docs + {weight})")


def fences(sketch: DataFrame, weight: int) -> DataFrame:
    """``lang, source, low_<measure>, high_<measure>`` of every source."""
    up = lambda df, *keys: df.select(*[F.col(k).alias(f"up_{k}") for k in keys], F.col("measure").alias("up_measure"), F.col("q1").alias("up_q1"), F.col("q3").alias("up_q3"))
    leaning = [_leaning("q1", weight).alias("q1"), _leaning("q3", weight).alias("q3")]
    of_measure = F.col("measure") == F.col("up_measure")
    of_lang = of_measure & F.col("lang").eqNullSafe(F.col("up_lang"))
    corpus = up(quartiles(merge(sketch)))
    by_lang = quartiles(merge(sketch, "lang"), "lang").join(corpus, of_measure).select("lang", "measure", *leaning)
    by_source = quartiles(sketch, "lang", "source").join(up(by_lang, "lang"), of_lang).select("lang", "source", "measure", *leaning)
    out = []
    for m, least in MEASURES.items():
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * SPREAD
        out += [F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"low_{m}"), F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"high_{m}")]
    return by_source.groupBy("lang", "source").agg(*out)


def quality_rules(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` of every row."""
    measured = cut(base_measures(docs).withColumns({f"m_{m}": c for m, c in measures().items()}))
    limits = fences(cut(sketches(measured)), weight)
    table = cut(limits.withColumnsRenamed({"lang": "k_lang", "source": "k_source"}))
    joined = measured.join(table, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left")
    base_failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    within = F.col("m_length") >= F.col("low_length")
    for m in MEASURES:
        within = within & (F.col(f"m_{m}") <= F.col(f"high_{m}"))
    return joined.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(*measured.columns, "base_failed", "kept")


def _sql_quartiles(keys: str) -> str:
    group = f"{keys}, " if keys else ""
    return f"""select {group}measure, max(docs) as docs, min(case when upto * 4 >= docs then bucket end)::bigint as q1, min(case when upto * 4 >= docs * 3 then bucket end)::bigint as q3 from (
    select {group}measure, bucket, sum(n) over (partition by {group}measure order by bucket) as upto, sum(n) over (partition by {group}measure) as docs
    from (select {group}measure, bucket, sum(n)::bigint as n from sketch group by all)) group by {group}measure"""


_LEANING = ", ".join(f"((a.docs * a.{q} + {WEIGHT} * b.{q}) // (a.docs + {WEIGHT}))::bigint as {q}" for q in ("q1", "q3"))
_LIMITS = ",\n".join(f"max(case when measure = '{m}' then q1 - {SPREAD} * greatest(q3 - q1, {least}) end) as low_{m}, max(case when measure = '{m}' then q3 + {SPREAD} * greatest(q3 - q1, {least}) end) as high_{m}" for m, least in MEASURES.items())


ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
r as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by rid, gram) as c from g) where c >= 2) group by rid),
b as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
  len(ls)::bigint as n_lines, (length(t) - length(translate(t, '{CAPITALS}', '')))::bigint as n_capitals from w left join r using (rid)),
m as (select *, case when n_words > 0 then n_symbols * 10000 // n_words else 0 end as m_symbols, case when n_words > 0 then word_chars * 100 // n_words else 0 end as m_length,
  case when n_lines > 0 then n_dup_lines * 10000 // n_lines else 0 end as m_dup_lines, case when n_words > 0 then n_repeat_words * 10000 // n_words else 0 end as m_repeats,
  case when word_chars > 0 then n_capitals * 10000 // word_chars else 0 end as m_capitals from b),
long as (select lang, source, unnest(['symbols', 'length', 'dup_lines', 'repeats', 'capitals']) as measure, unnest([m_symbols, m_length, m_dup_lines, m_repeats, m_capitals]) as v from m where n_words > 0),
sketch as (select lang, source, measure, case when v < 128 then v else (v >> (length(bin(v)) - 7)::int) << (length(bin(v)) - 7)::int end as bucket, count(*) as n from long group by all),
g0 as ({_sql_quartiles("")}), l0 as ({_sql_quartiles("lang")}), s0 as ({_sql_quartiles("lang, source")}),
l as (select a.lang, a.measure, {_LEANING} from l0 a join g0 b on a.measure = b.measure),
s as (select a.lang, a.source, a.measure, {_LEANING} from s0 a join l b on a.measure = b.measure and a.lang is not distinct from b.lang),
f as (select lang, source, {_LIMITS} from s group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(m_length >= low_length and m_symbols <= high_symbols and m_length <= high_length and m_dup_lines <= high_dup_lines and m_repeats <= high_repeats and m_capitals <= high_capitals, false) as kept
from (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m) m
left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source
"""

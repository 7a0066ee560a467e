"""Registered queries of single functions, sinks and table operations over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixtures
from tessera.functions import markup
from tessera.functions import text as T
from tessera.operators import calibrate, corpus, decisions, evaluation
from tessera.queries import _TOKEN, _WORD, _sql_count, query, table
from tessera.queries_protocol import _dealt
from tessera.sources import readers, sinks

_FLAT = "trim(regexp_replace(text, '[\\s\\x{A0}\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'))"


@query(f"select doc_id, case when length(f) <= 110 then f else left(f, 109) || '…' end as excerpt, length(regexp_replace(left(text, place), '[^\\n]', '', 'g'))::int + 1 as line from (select doc_id, text, {_FLAT} as f, length(text) // 2 as place from documents)")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.line_of(F.col("text"), half).alias("line"))


_SLUG = "case when s = '' then 'doc' else left(s, 80) end"


@query(f"""with d as (select doc_id, sha256(text) as h, regexp_replace(regexp_replace(source || ' (' || lang || ')/' || doc_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') as s from documents)
select doc_id, {_SLUG} || '-' || left(h, 10) || '.txt' as name, 'new/' || {_SLUG} as path from d""")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("source", F.lit(" ("), "lang", F.lit(")/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sinks.document_path(said, F.col("text")).alias("name"), sinks.rebased(F.concat(F.lit("old/"), T.slug(said)), "old", "new/").alias("path"))


@query(r"""with f as (select doc_id, ['# ', '1.2) ', '3. ', ''][(doc_id % 4 + 1)::int] || '**Раздел**  Ёж `' || source || '` ' || lang as h from documents)
select doc_id, trim(regexp_replace(replace(lower(regexp_replace(regexp_replace(h, '^\s*\d+(?:\.\d+)*[.)]?\s+', ''), '[`*_]+', '', 'g')), 'ё', 'е'), '\s+', ' ', 'g')) as heading from f""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.get(F.array(*[F.lit(x) for x in ("# ", "1.2) ", "3. ", "")]), (F.col("doc_id") % 4).cast("int"))
    said = F.concat(start, F.lit("**Раздел**  Ёж `"), "source", F.lit("` "), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_heading(said).alias("heading"))


@query("""with l as (select doc_id, ['1', 'YES', ' true ', 'no', '', null, '0'][(doc_id % 7 + 1)::int] as flag, ['', 'unknown', ' N/A ', 'Desk  One', null][(doc_id % 5 + 1)::int] as label from labels)
select doc_id, case when flag is null or flag = '' then false else lower(trim(flag)) in ('1', 'true', 'yes', 'y') end as flag, case when regexp_replace(lower(trim(label)), '\\s+', ' ', 'g') in ('', 'unknown', 'n/a') then null else regexp_replace(lower(trim(label)), '\\s+', ' ', 'g') end as label from l""")
def flags_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % n).cast("int"))
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", T.truthy(of(("1", "YES", " true ", "no", "", None, "0"), 7)).alias("flag"), T.known_label(of(("", "unknown", " N/A ", "Desk  One", None), 5)).alias("label"))


#: Markup and its text, by hand.
MARKUP = (
    fixtures.Expected("# Title\n\nSee [the  page](http://x.y) and ![alt](z.png).\n\n```\ncode\n```\n- item\n> said\n", "md", (("Title\n\nSee the page and alt.\n\nitem\nsaid",),)),
    fixtures.Expected("| a | b |\n|---|---|\n| 1 | 2 |\n", "markdown", (("a. b\n1. 2",),)),
    fixtures.Expected("<doc><speech n=\"1\"><p>One &amp; two</p><p>three</p></speech><p>not</p></doc>", "xml", (("One & two\n\nthree",),)),
    fixtures.Expected("<nav>menu</nav><p>One&nbsp;two</p><script>x</script><div>three<br>four</div>", "html", (("One two\n\nthree\nfour",),)),
    fixtures.Expected("plain\r\ntext  with\ttabs\n\n\n\nend &lt;", "txt", (("plain\ntext with tabs\n\nend <",),)),
)
_MARKUP = ", ".join(f"({i}, '{x.findings[0][0]}')" for i, x in enumerate(MARKUP))


@query(f"select doc_id, body from documents join (values {_MARKUP}) e(i, body) on doc_id % {len(MARKUP)} = i")
def texts_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), MARKUP)
    return docs.select("doc_id", markup.by_suffix(F.concat(F.lit("file."), "other"), F.col("text")).alias("body"))


# ---- sinks and tables ---------------------------------------------------------------------


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.last_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""with o as (select doc_id, quality, 'old' as run from labels where doc_id % 2 = 0), n as (select doc_id, quality, 'new' as run, doc_id * 10 + k as place from labels, range(2) r(k))
select * from o union all select doc_id, min_by(quality, place) as quality, 'new' from n where doc_id not in (select doc_id from o) group by doc_id""")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    old = labels.where("doc_id % 2 = 0").withColumn("run", F.lit("old"))
    twice = labels.withColumn("k", F.explode(F.array(F.lit(1), F.lit(0)))).select("doc_id", "quality", F.lit("new").alias("run"), (F.col("doc_id") * 10 + F.col("k")).alias("at"))
    return sinks.append_new(old, twice, ["doc_id"], "at").select("doc_id", "quality", "run")


@query(f"select lang, count(*) as documents, sum({_sql_count('text', _WORD)})::bigint as words, sum(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: len(regexp_extract_all(x, '{_WORD}')) >= 3)))::bigint as paragraphs from documents group by lang")
def prepared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.prepared_totals(table(spark, sf_dir, "documents"), "lang")


@query("select doc_id as id, lang, null::int as quality from documents union all select doc_id, null, quality from labels")
def union_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    return sinks.union_of_columns(docs, labels).select("id", "lang", "quality")


@query("""select 'report ' || doc_id || ':' || (doc_id % 9) || ' [info] long-sentence: ' || lang as said from documents union all select 'report ' || doc_id || ': 1' from documents""")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.concat(F.lit("report "), F.col("doc_id").cast("string")).alias("doc_id"), (F.col("doc_id") % 9).cast("int").alias("line"), F.lit("info").alias("level"), F.lit("long-sentence").alias("code"), F.col("lang").alias("message"))
    return sinks.console_lines(found)


# ---- readers ------------------------------------------------------------------------------


@query(r"""with l as (select doc_id as stream, unnest(string_split(text, chr(10))) as v, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
m as (select *, starts_with(v, 'Licensed') as mark, sum(starts_with(v, 'Licensed')::int) over (partition by stream order by n) as r from l)
select stream, max(v) filter (mark) as id, coalesce(string_agg(v, chr(10) order by n) filter (not mark), '') as text from m where r > 0 group by stream, r""")
def marked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    return readers.marked_records(lines, "^(Licensed.*)")


@query(f"""with c as (select conv_id, max(text) filter (turn = 0) as a, max(text) filter (turn = 1) as b from conversations group by conv_id),
n as (select *, {_sql_count("coalesce(a, '')", _WORD)} as x, {_sql_count("coalesce(b, '')", _WORD)} as y from c)
select conv_id, case when x >= y then a else b end as text from n""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    wide = talk.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    return readers.best_candidate(wide, ["a", "b"]).select("conv_id", "text")


@query("select lang, string_agg(source, chr(10) order by doc_id) as text from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where (lang = 'en' and r <= 40) or (lang = 'de' and r <= 7) group by lang")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.labelled_documents(table(spark, sf_dir, "documents"), "lang", "source", "doc_id", {"en": 40, "de": 7})


# ---- evaluation and decisions -------------------------------------------------------------


@query("""with r as (select doc_id, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'nan'::double else (doc_id % 7) / 5.0::double end as pass_rate, (doc_id % 11 - 1)::bigint as tokens, 5 as duration_ms from labels)
select doc_id, case when pass_rate is null then 'missing' when isnan(pass_rate) then 'non_finite' when pass_rate > 1 or tokens < 0 then 'out_of_range' end as reason from r""")
def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, F.lit(float("nan"))).otherwise((F.col("doc_id") % 7) / 5.0)
    runs = table(spark, sf_dir, "labels").select("doc_id", rate.alias("pass_rate"), (F.col("doc_id") % 11 - 1).cast("double").alias("tokens"), F.lit(5.0).alias("duration_ms"))
    return evaluation.valid_runs(runs).select("doc_id", "reason")


@query("""select doc_id, case when doc_id % 3 = 0 then 0.5::double else round_even(len(list_filter([quality = 1, toxic = 0, doc_id % 2 = 0], lambda x: x)) / 3.0::double, 6) end as rate from labels""")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.array(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 2 == 0)
    stated = F.when(F.col("doc_id") % 3 == 0, F.lit(0.5))
    return table(spark, sf_dir, "labels").select("doc_id", F.bround(evaluation.pass_rate(stated, passed), 6).alias("rate"))


@query("select coalesce(sum(doc_id % 7) filter (quality = 1), 0)::bigint as score from labels")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.weighted_score(table(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("weight"), (F.col("quality") == 1).alias("ok"))).select(F.col("score").cast("long").alias("score"))


@query("select doc_id, case when doc_id % 4 = 1 then 'changed' when doc_id % 4 = 2 then 'missing' end as state from labels where doc_id % 4 in (1, 2) union all select -doc_id, 'extra' from labels where doc_id % 4 = 3 and doc_id > 0")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    actual = labels.where("doc_id % 4 <> 2").withColumn("quality", F.when(F.col("doc_id") % 4 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    extra = labels.where("doc_id % 4 = 3 and doc_id > 0").select((-F.col("doc_id")).alias("doc_id"), "quality")
    return evaluation.compare(labels, actual.unionByName(extra), ["doc_id"])


@query("select lang, count(*) as labels from (select distinct lang, source from documents) group by lang having count(*) > 1")
def conflicting_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.conflicting_labels(table(spark, sf_dir, "documents").select("lang", F.col("source").alias("label")), ["lang"])


@query("select source, count(*) as n from documents group by source having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.duplicate_keys(table(spark, sf_dir, "documents").select("source"), ["source"])


@query("select min(doc_id) as doc_id from (select doc_id, lang, source, text from documents) group by text")
def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_of_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), [], "doc_id").select("doc_id")


_METRIC = ("words", "n")


@query(f"""with m as (select lang, {_sql_count("text", _TOKEN)} as words, try_cast(['12', 'x', null, '7.5'][(doc_id % 4 + 1)::int] as double) as n from documents), v as (select lang, words, unnest(['words', 'n']) as metric, unnest([words::double, n]) as v from m)
select lang, count(*) as documents, sum(words)::bigint as words_total, metric, coalesce(round_even(quantile_cont(v, 0.5), 4), 0) as p50, coalesce(round_even(quantile_cont(v, 0.95), 4), 0) as p95 from v group by lang, metric""")
def calibrate_odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.get(F.array(F.lit("12"), F.lit("x"), F.lit(None).cast("string"), F.lit("7.5")), (F.col("doc_id") % 4).cast("int"))
    rows = table(spark, sf_dir, "documents").select("lang", T.token_count(F.col("text")).alias("words"), cell.alias("n"))
    return calibrate.calibrate(rows, ["lang"], list(_METRIC)).select("lang", "documents", "words_total", "metric", "p50", "p95")


@query("select lang as profile, string_agg(source, ',' order by source) as sources, count(*) as n from (select distinct lang, source from documents) group by lang")
def profiles_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.collect_set("lang").alias("profiles"))
    return evaluation.profiles_covered(declared).select("profile", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("long").alias("n"))

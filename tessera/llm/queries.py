"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, decontaminate, html, linededup, lm, pii, rules, simhash, substrings
from tessera.plans.session import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), source)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"), whole=True)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All windows of 50 words by their words, and the smallest document of each.
SUBSTRINGS = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
s as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as said from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
m as (select said, min(doc_id) as low from s group by said having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from (select doc_id, i from s join m using (said) where doc_id > low)),
e as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
k as (select doc_id, count(gone.p) as n_removed, string_agg(word, ' ' order by p) filter (gone.p is null) as kept from e left join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""


def _runs(most: int) -> str:
    """Windows of 1 to ``most`` lines that have ``most`` words, by their lines."""
    said = ["body", *(f"lead(body, {k}) over here" for k in range(1, most))]
    words = ["n", *(f"lead(n, {k}) over here" for k in range(1, most))]
    return " union all ".join(f"select doc_id, seq, {j} as j, [{', '.join(said[:j])}] as said, {' + '.join(words[:j])} as words from l window here as (partition by doc_id order by seq)" for j in range(1, most + 1))


#: Runs of up to five lines with five words or more; as every line has a word, these cover all longer runs.
LINES = rf"""
with a as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from documents where text is not null),
l as (select *, row_number() over (partition by doc_id order by line) as seq from (select *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) as n from a) where n > 0),
r as (select * from ({_runs(5)}) where words >= 5),
f as (select j, said, min(doc_id * 10000000 + seq) as first from r group by j, said having count(*) > 1),
gone as (select distinct doc_id, unnest(range(seq, seq + j)) as seq from (select doc_id, seq, j from r join f using (j, said) where doc_id * 10000000 + seq <> first)),
g as (select doc_id, line from gone join l using (doc_id, seq)),
k as (select doc_id, string_agg(body, chr(10) order by line) filter (g.line is null) as kept, count(g.line) as n_removed from a left join g using (doc_id, line) group by doc_id),
n as (select doc_id, count(*) as n_lines from l group by doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join k using (doc_id) left join n using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE,
    "op6_substring_dedup": SUBSTRINGS,
    "op8_line_dedup": LINES,
}

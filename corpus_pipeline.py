"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept.

All stages but the last give the columns of ``documents``.  Rejected documents, documents of
which line dedup leaves nothing, later members of a near-duplicate group, and documents
that hold a benchmark item go; everything else stays, with repeated lines cut out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, decontaminate, linededup, simhash
from tessera.llm.queries import table
from tessera.llm.words import fresh
from tessera.plans.lineage import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents made of nothing else."""
    count, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    done = linededup.line_dedup(docs, lines=count, removed=gone).where((F.col(gone) == 0) | (F.col(gone) < F.col(count)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, encoded and decoded again."""
    return bpe.encode_digests(docs, bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("bpe", encode),
]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

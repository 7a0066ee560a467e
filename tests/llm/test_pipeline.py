"""The pipeline's stages: columns, effects, and agreement of run() with its stages; SQL of the registered queries."""

import duckdb

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    contaminated = {r["doc_id"] for r in queries.op3_decontamination(spark, DATA).collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert not contaminated & {r["doc_id"] for r in docs.collect()}
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    assert last == {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, DATA).collect()}


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "plain text of some words here", "en", "s", 5), (3, "plain text of some words here", "en", "s", 5), (3, "plain text of some words here", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for source in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, source, DATA).columns == docs.columns, name
            assert stage(spark, source, DATA).count() <= source.count()


def test_stages_on_columns_of_any_name(spark):
    names = ["doc", "gone", "n_lines", "n_removed", "__removed", "__lines", "digest", "fp", "rep", "component", "rid", "toxic", "posterior", "kept"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    wide = docs.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, found = stage(spark, docs, DATA), stage(spark, wide, DATA)
        assert found.columns == wide.columns, name
        assert sorted(map(tuple, found.select(*docs.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str), name
        assert {tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect()} <= {tuple(range(len(names)))}, name


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, DATA)
        columns = sorted(got.columns)
        listed = ", ".join(f'"{c}"' for c in columns)
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, con.sql(f"select {listed} from ({sql})").fetchall())), name

"""Sinks: CSV with a header even without rows, JSON, manifests, resumable appends, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; an empty table still writes one file that holds the header."""
    spark = df.sparkSession
    out = df.select(*[F.col(c).cast("string") for c in df.columns])
    if out.isEmpty():
        spark.createDataFrame([tuple(df.columns)], ", ".join(f"`_{i}` string" for i in range(len(df.columns)))).coalesce(1).write.mode(mode).option("header", False).csv(path)
    else:
        out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def union_of_columns(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns, first seen first."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def document_path(name: Column, text: Column, suffix: str = ".txt") -> Column:
    """A file name that no other text of the same name shares."""
    return F.concat(T.slug(name), F.lit("-"), F.left(F.sha2(text, 256), F.lit(10)), F.lit(suffix))


def rebased(path: Column, old_base: str, new_base: str) -> Column:
    """A path relative to another folder, where it lies below the old one."""
    inside = F.concat(F.lit(new_base.rstrip("/") + "/"), F.substr(path, F.lit(len(old_base.rstrip("/")) + 2)))
    return F.when(path.startswith(old_base.rstrip("/") + "/"), inside).otherwise(path)


def append_new(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows, then new rows whose keys are new; of equal new keys the first by ``order`` (or as they were read) wins."""
    placed = new.withColumn("__place", F.col(order) if order else F.monotonically_increasing_id())
    first = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*new.columns), "__place").alias("r")).select("r.*")
    on = [first[k].eqNullSafe(old[k]) for k in keys]
    return old.unionByName(first.join(old, on, "left_anti").select(*old.columns))


def kept_rows(old: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of an earlier manifest whose file is still there."""
    return old.join(files.select(F.col("path").alias("__path")).distinct(), F.col(path) == F.col("__path"), "left_semi")


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    packed = F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(packed).select("r.*")


def inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Files of each top folder."""
    return files.groupBy(F.element_at(F.split(path, "/"), 1).alias("top")).agg(F.count(F.lit(1)).alias("files"))


def prepared_totals(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Documents, words and paragraphs of each prepared source."""
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(T.word_count(F.col(text))).alias("words"), F.sum(T.corpus_paragraph_count(F.col(text))).alias("paragraphs"))


def prepared_corpus(docs: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Documents as Parquet, a folder for each source."""
    docs.write.mode(mode).partitionBy(by).parquet(path)


def representative_manifest(rows: DataFrame, old_base: str, new_base: str, path: str = "path", text: str = "text") -> DataFrame:
    """Rows with paths relative to another folder and their file's SHA-256."""
    return rows.withColumn("sha256", F.sha2(text, 256)).withColumn(path, rebased(F.col(path), old_base, new_base)).drop(text)


def hash_manifest(files: DataFrame, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(path, sha256)`` of ``(path, content)`` rows below a folder, without top folders that are excluded."""
    base = root.rstrip("/") + "/"
    own = files.select(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{base}", "").alias("path"), F.sha2("content", 256).alias("sha256"))
    return own.where(~F.element_at(F.split("path", "/"), 1).isin(*exclude)) if exclude else own


def console_lines(findings: DataFrame, name: str = "doc_id") -> DataFrame:
    """One line of text for each finding, and one for each document with its number of findings, in reading order."""
    line = F.format_string("%s:%d [%s] %s: %s", F.col(name).cast("string"), F.col("line"), F.col("level"), F.col("code"), F.col("message"))
    each = findings.select(F.col(name).alias("of"), F.lit(0).alias("last"), F.col("line").alias("at"), line.alias("said"))
    total = findings.groupBy(F.col(name).alias("of")).agg(F.count(F.lit(1)).alias("n")).select("of", F.lit(1).alias("last"), F.lit(0).alias("at"), F.format_string("%s: %d", F.col("of").cast("string"), F.col("n")).alias("said"))
    return each.unionByName(total).orderBy("of", "last", "at", "said").select("said")


def show(findings: DataFrame, name: str = "doc_id", lines: int = 100) -> None:
    """Print the first lines of the report."""
    for row in console_lines(findings, name).limit(lines).collect():
        print(row["said"])

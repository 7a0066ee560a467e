"""Sources: files, directories, manifests, JSON lines, archives, record streams, crawls.

All readers go through Spark's file sources, so any store that Spark knows will do.
Network fetching, OCR and PDF extraction are interfaces only: callers pass a table of
fetched pages or a function from bytes to text.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.markup import read_html
from tessera.plans.lineage import cut

T_WORD = re.compile(T.WORD)
# Fields that may hold a record's text, its id and its author.
TEXT_FIELDS = ("text", "content", "body", "post", "message", "article", "description", "full_text", "plaintext", "textips")
ID_FIELDS = ("id", "post_id", "url")
AUTHOR_FIELDS = ("author", "username", "user", "journal")
ROW_AUTHORS = ("author", "speaker", "user")
MEMBER_SUFFIXES = ("txt", "md", "markdown", "json", "jsonl", "csv", "tsv", "xml", "html", "htm")
MEMBER_BYTES = 250 * 1024 * 1024


def text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md"), strict: bool = True) -> DataFrame:
    """``(path, text)`` of all files below a folder; undecodable files raise, or go if not strict."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    if strict:
        return named.select("path", F.when(valid, F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).alias("text"))
    return named.where(valid).select("path", F.col("content").cast("string").alias("text"))


def manifest(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """A CSV manifest, all columns as strings, blank paths skipped; paths are made absolute against its folder."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "path" not in rows.columns:
        return rows
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    own = F.trim("path")
    return rows.where(F.coalesce(own, F.lit("")) != "").withColumn("path", F.when(own.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), own).otherwise(F.concat(F.lit(f"{base}/"), own)))


def with_texts(rows: DataFrame, files: DataFrame, how: str = "left") -> DataFrame:
    """Manifest rows with the text of their file; ``how='left_semi'`` style readers pass ``inner``."""
    plain = lambda c: F.regexp_replace(F.col(c), r"^file:/*", "/")
    texts = files.select(plain("path").alias("__path"), "text")
    return rows.join(texts, plain("path") == F.col("__path"), how).drop("__path")


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records of a JSON-lines file; malformed lines go."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.limit(limit) if limit else rows


def loose_records(value: object, prefix: str = "record") -> Iterator[tuple[str, str, str]]:
    """``(id, text, author)`` from nested JSON: the wordiest text field of an object, else what its parts hold."""
    stack: list[tuple[object, str]] = [(value, prefix)]
    count = lambda s: len(T_WORD.findall(s))
    while stack:
        item, name = stack.pop()
        if isinstance(item, list):
            stack.extend((x, f"{name}-{i}") for i, x in reversed(list(enumerate(item))))
        elif isinstance(item, dict):
            best = max((item[k] for k in TEXT_FIELDS if isinstance(item.get(k), str)), key=count, default="")
            if best and count(best):
                first = lambda names, item=item: next((str(item[n]) for n in names if item.get(n)), None)
                yield first(ID_FIELDS) or name, best, first(AUTHOR_FIELDS) or ""
            else:
                stack.extend((x, f"{name}-{k}") for k, x in reversed(list(item.items())) if isinstance(x, (dict, list)))


def member_records(name: str, raw: str) -> Iterator[tuple[str, str, str]]:
    """``(id, text, author)`` of one archive member by its suffix; malformed records go."""
    stem, _, suffix = name.rsplit("/", 1)[-1].rpartition(".")
    suffix = suffix.lower()
    if suffix in ("jsonl", "json"):
        pieces = [(f"{stem}-{i}", x) for i, x in enumerate(raw.splitlines()) if x.strip()] if suffix == "jsonl" else [(stem, raw)]
        for prefix, piece in pieces:
            try:
                value = json.loads(piece)
            except ValueError:
                continue
            yield from loose_records(value, prefix)
    elif suffix in ("csv", "tsv"):
        table = pd.read_csv(io.StringIO(raw), sep="\t" if suffix == "tsv" else ",", dtype=str, keep_default_na=False, on_bad_lines="skip")
        count = lambda s: len(T_WORD.findall(s))
        for i, row in enumerate(table.to_dict("records")):
            best = max((row[k] for k in TEXT_FIELDS if row.get(k)), key=count, default="") or max(row.values(), key=count, default="")
            if best:
                first = lambda names, row=row: next((row[n] for n in names if row.get(n)), None)
                yield first(ID_FIELDS) or f"{stem}-{i}", best, first(ROW_AUTHORS) or ""
    elif suffix in ("html", "htm"):
        yield stem, read_html(raw)[0], ""
    else:
        yield stem, raw, ""


def zip_records(spark: SparkSession, path: str | list[str], md5: dict[str, str] | None = None) -> DataFrame:
    """``(archive, member, id, text, author)`` of ZIP members with known suffixes; directories and huge members go.

    ``md5`` has the stated digest of archives by file name; one that differs raises.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    if md5:
        stated = F.create_map(*[F.lit(x) for pair in md5.items() for x in pair])[F.element_at(F.split("path", "/"), -1)]
        wrong = stated.isNotNull() & (F.md5("content") != F.lower(stated))
        archives = archives.withColumn("content", F.when(wrong, F.raise_error(F.concat(F.lit("md5 differs: "), "path")).cast("binary")).otherwise(F.col("content")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as file:
                    for info in sorted(file.infolist(), key=lambda x: x.filename):
                        if info.is_dir() or info.file_size > MEMBER_BYTES or info.filename.rpartition(".")[2].lower() not in MEMBER_SUFFIXES:
                            continue
                        rows = list(member_records(info.filename, file.read(info).decode("utf-8", "replace")))
                        if rows:
                            ids, texts, authors = zip(*rows, strict=True)
                            yield pd.DataFrame({"archive": archive, "member": info.filename, "id": ids, "text": texts, "author": authors})

    return archives.mapInPandas(run, "archive string, member string, id string, text string, author string")


def marked_records(lines: DataFrame, marker: str, stream: str = "stream", order: str = "line", text: str = "value") -> DataFrame:
    """Records of a line stream that starts each with a marker line: ``(stream, id, text)``; lines before the first go."""
    upto = W.partitionBy(stream).orderBy(order)
    found = F.regexp_extract(text, marker, 1)
    numbered = lines.withColumn("__mark", found != "").withColumn("__id", found).withColumn("__no", F.sum(F.col("__mark").cast("int")).over(upto))
    grouped = numbered.where("__no > 0").groupBy(stream, "__no").agg(F.max(F.when(F.col("__mark"), F.col("__id"))).alias("id"), F.array_sort(F.collect_list(F.when(~F.col("__mark"), F.struct(F.col(order), F.col(text))))).alias("rows"))
    return grouped.select(stream, "id", F.array_join(F.transform("rows", lambda r: r[text]), "\n").alias("text"))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_rounds: int, limit: int | None = None) -> DataFrame:
    """Breadth-first order over fetched pages: ``(url, depth)`` of all, or at most ``limit``, pages on the seeds' hosts.

    ``pages``: url; ``links``: src, dst; ``seeds``: url.
    """
    host = lambda c: F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#]+)", 1))
    hosts = seeds.select(host("url").alias("host")).distinct()
    known = pages.select("url").distinct()
    seen = seeds.join(known, "url").select("url", F.lit(0).alias("depth")).distinct()
    for depth in range(1, max_rounds + 1):
        front = seen.where(F.col("depth") == depth - 1)
        ahead = links.join(front, links["src"] == front["url"]).select(F.col("dst").alias("url")).distinct()
        inside = ahead.withColumn("host", host("url")).join(hosts, "host", "left_semi").select("url").join(known, "url")
        seen = cut(seen.unionByName(inside.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))))
    ordered = seen.orderBy("depth", "url")
    return ordered if limit is None else ordered.limit(limit)


def best_candidate(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``text``: the wordiest of several fields."""
    each = F.array(*[F.struct(T.word_count(F.coalesce(F.col(f), F.lit(""))).alias("n"), F.lit(-i).alias("i"), F.col(f).alias("t")) for i, f in enumerate(fields)])
    return rows.withColumn("text", F.array_max(each)["t"])


def labelled_documents(rows: DataFrame, label: str, text: str, order: str, limits: dict[str, int]) -> DataFrame:
    """The first lines of each class joined into one document."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(order)))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    kept = ranked.where(F.col("__r") <= most[F.col(label)])
    return kept.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", text))), lambda x: x[text]), "\n").alias("text"))


def refuse_unverified(sources: DataFrame, status: str = "status") -> DataFrame:
    """Sources whose format nobody has verified raise."""
    return sources.withColumn(status, F.when(F.contains(F.col(status), F.lit("format_unverified")), F.raise_error(F.lit("source format is unverified"))).otherwise(F.col(status)))


def load_sources(registry: dict[str, Callable[[SparkSession, dict], DataFrame]], spark: SparkSession, sources: list[dict]) -> DataFrame | None:
    """All sources by their adapter, in one table with the union of their columns; unknown adapters are reference only."""
    out: DataFrame | None = None
    for source in sources:
        build = registry.get(source.get("adapter", ""))
        if build is not None:
            part = build(spark, source).withColumn("source_id", F.lit(source.get("id")))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def discover_local(spark: SparkSession, root: str, sources: list[dict], given: dict[str, str] | None = None, adapter: str = "manual_or_local_tree") -> dict[str, str]:
    """Folders of local sources: the given ones, and ``root/<id>`` of others with that adapter where a manifest lies."""
    found = dict(given or {})
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for source in sources:
        folder = f"{root.rstrip('/')}/{source['id']}"
        path = hadoop(f"{folder}/manifest.csv")
        if source.get("adapter") == adapter and source["id"] not in found and path.getFileSystem(settings).exists(path):
            found[source["id"]] = folder
    return found


def local_tree(files: DataFrame, root: str, declared: list[str], sidecar: DataFrame | None = None) -> DataFrame:
    """Files of a tree with their provenance: ``path, text, id, channel, ...`` and ``reason``, null where the row may be imported.

    ``sidecar`` has ``path`` relative to the root, ``id``, ``channel`` and any other columns; without
    one a file's id is its relative path and its channel is unknown.
    """
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^file:/*", "/")
    inside = files.select(F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).alias("own"), "text")
    if sidecar is None:
        rows = inside.select(F.col("own").alias("path"), "text", F.col("own").alias("id"), F.lit(None).cast("string").alias("channel"))
    else:
        rows = sidecar.join(inside, F.trim(sidecar["path"]) == F.col("own"), "left").drop("own")
    twice = rows.groupBy(F.trim("id").alias("of_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of_id")
    name = F.coalesce(F.trim("path"), F.lit(""))
    escapes = name.rlike(r"^([/\\\\]|[A-Za-z][A-Za-z0-9+.-]*:)|(^|/)\.\.(/|$)")
    known = F.coalesce(F.trim("channel"), F.lit(""))
    reason = (
        F.when(escapes, "path_escapes_tree")
        .when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing_id")
        .when(F.col("of_id").isNotNull(), "duplicate_id")
        .when((known != "") & ~known.isin(*declared), "undeclared_channel")
        .when(F.col("text").isNull(), "missing_file")
    )
    return rows.join(twice, F.trim("id") == F.col("of_id"), "left").withColumn("reason", reason).drop("of_id")


def strict(rows: DataFrame, reason: str = "reason", key: str = "id") -> DataFrame:
    """Rows without a reason; the first row that has one raises when it is read."""
    bad = F.raise_error(F.concat_ws(": ", F.col(reason), F.col(key).cast("string")))
    return rows.where(F.when(F.col(reason).isNotNull(), bad.isNull()).otherwise(True)).drop(reason)


def numbered_books(spark: SparkSession, path: str, pattern: str = r"book_[0-9]+\.txt") -> DataFrame:
    """``(path, text)`` of the text files whose names match."""
    return text_files(spark, path, ("txt",)).where(F.element_at(F.split("path", "/"), -1).rlike(f"^{pattern}$"))


def fetched(requests: DataFrame, fetch: Callable[[str], bytes], extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """What is at each ``url``: ``(url, content, text, error)``, through functions that the caller brings.

    The plug-in point of sources that need a network, OCR or PDF reading: ``fetch`` brings the bytes (with
    what retries and delays it likes), ``extract`` turns them into text (UTF-8 if there is none).  A
    failure is a row with an error, so that one page doesn't end a job.  Pages of a listing, trees and
    search results are ``requests`` whose contents give further ones.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    content = fetch(url)
                    rows.append((url, content, extract(content) if extract else content.decode("utf-8", "replace"), None))
                except Exception as problem:  # any failure of the caller's function is that row's result
                    rows.append((url, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["url", "content", "text", "error"])

    return requests.select(F.col("url").cast("string")).mapInPandas(run, "url string, content binary, text string, error string")

"""Sources, markup, sinks and streams."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.sources import readers, sinks
from tessera.streaming import streams

PROSE = "слово " * 120


def text_of(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_html(spark):
    page = f"<nav>меню</nav><main><h1>Заголовок</h1><p>{PROSE}&amp; &laquo;да&raquo;</p><script>x</script></main><footer>низ</footer><a href='/a?b&amp;c'>л</a>"
    got = text_of(spark, lambda c: markup.html_to_text(c), page)
    assert got["text"].startswith("Заголовок\n") and "меню" not in got["text"] and "& «да»" in got["text"] and got["links"] == ["/a?b&c"]
    chosen = text_of(spark, lambda c: markup.html_to_text(c, "post"), "<div class='menu'>m</div><div class='post-body'>коротко</div>")
    assert chosen["text"] == "коротко"
    assert text_of(spark, lambda c: markup.html_to_text(c)["text"], None) is None


def test_markdown_and_xml(spark):
    raw = "---\na: b\n---\n# Имя\n\n> цитата ![к](u) и [метка](http://x)\n\n```\ncode\n```\n- пункт\n\n| a | b |\n|---|---|\n| в | г |\n{% include x %}\n"
    assert text_of(spark, markup.markdown_to_text, raw) == "Имя\n\nцитата к и метка\n\nпункт\n\na. b\nв. г"
    assert text_of(spark, markup.xml_to_text, "<r><meta>no</meta><speech><p>раз &lt;</p><p>два</p></speech></r>") == "раз <\n\nдва"


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("привет", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.csv").write_text("id,path\n1,sub/a.txt\n2,\n3,none.txt\n", encoding="utf-8")
    files = readers.text_files(spark, str(tmp_path), strict=False)
    assert [r["text"] for r in files.collect()] == ["привет"]
    rows = readers.manifest(spark, str(tmp_path / "c.csv"), "id", "path")
    got = {r["id"]: r["text"] for r in readers.with_texts(rows, files).collect()}
    assert got == {"1": "привет", "3": None}


def test_zip_records(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x.jsonl", json.dumps({"id": 7, "author": "A", "text": "один два три"}, ensure_ascii=False) + "\nbroken\n" + json.dumps({"items": [{"content": "вложенный текст"}]}, ensure_ascii=False))
        z.writestr("t.tsv", "id\tspeaker\ttext\n5\tB\tдлинный текст тут\n")
        z.writestr("p.txt", "просто")
        z.writestr("skip.bin", "no")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    got = {r["id"]: (r["text"], r["author"]) for r in readers.zip_records(spark, str(tmp_path / "a.zip")).collect()}
    assert got == {"7": ("один два три", "A"), "x-2-items-0": ("вложенный текст", ""), "5": ("длинный текст тут", "B"), "p": ("просто", "")}


def test_marked_records(spark):
    lines = [("f", i, v) for i, v in enumerate(["lost", "Item: 1", "a", "b", "Item: 2", "c"])]
    got = readers.marked_records(spark.createDataFrame(lines, "stream string, line int, value string"), r"^Item: (\d+)")
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [("1", "a\nb"), ("2", "c")]


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, b int")
    sinks.write_csv(empty, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["a", "b"]
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, sinks.append_new(old, new, ["k"]).collect())) == [(1, "x"), (2, "z")]
    rows = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r")], "k string, n int, v string")
    assert sorted(r["v"] for r in sinks.last_of_each(rows, ["k"], "n").collect()) == ["q", "r"]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 7}", "p") for i in range(40)], "id int, text string, profile string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.first_arrivals(streams.file_stream(spark, str(tmp_path / "in"), rows.schema), ["profile"])
    query = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select count(distinct digest), count(*) from kept").first()[:] == (7, 7)


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0, cast(id as int) * 10) as ts, cast(id % 2 as string) as kind, 1.0 as v from range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    found = streams.windowed_counts(streams.file_stream(spark, str(tmp_path / "in"), rows.schema), "ts", ["kind"], "v")
    query = found.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streams.windowed_counts(rows, "ts", ["kind"], "v").collect()))


def test_html_reader_nests_as_tags_do():
    read_html = markup.read_html
    text, links = read_html("<p>a<b>b</p>c<nav>menu <a href=x>y</a></nav></i>d<br/>e<script>1</script><div>f</section>g")
    assert "".join(text.split()) == "abcdefg" and links == ["x"]
    words = "слово " * 100
    assert read_html(f"<div>before<article>{words}</article></div>")[0].strip() == words.strip()
    assert "before" in read_html("<div>before<article>слово</article></div>")[0]
    assert read_html("<div class='x body'>in</div>out", "body")[0].strip() == "in"


def test_sources_of_local_trees(spark, tmp_path):
    for name in ("a/manifest.csv", "b/other.csv", "tree/one.txt", "tree/two.txt", "tree/book_7.txt", "tree/book_x.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("text of " + name)
    sources = [{"id": "a", "adapter": "manual_or_local_tree"}, {"id": "b", "adapter": "manual_or_local_tree"}, {"id": "c", "adapter": "zip"}]
    assert readers.discover_local(spark, str(tmp_path), sources, {"c": "given"}) == {"a": f"{tmp_path}/a", "c": "given"}
    files = readers.text_files(spark, str(tmp_path / "tree"))
    rows = [("one.txt", "1", "web"), ("two.txt", "2", "secret"), ("../b/other.csv", "3", "web"), ("/etc/passwd", "4", ""), ("gone.txt", "5", "web"), ("one.txt", "6", ""), ("two.txt", "6", "web"), ("one.txt", " ", "web")]
    found = readers.local_tree(files, str(tmp_path / "tree"), ["web"], spark.createDataFrame(rows, "path string, id string, channel string")).collect()
    assert sorted((r["path"], r["id"], r["reason"] or "") for r in found) == sorted([
        ("one.txt", "1", ""), ("two.txt", "2", "undeclared_channel"), ("../b/other.csv", "3", "path_escapes_tree"), ("/etc/passwd", "4", "path_escapes_tree"),
        ("gone.txt", "5", "missing_file"), ("one.txt", "6", "duplicate_id"), ("two.txt", "6", "duplicate_id"), ("one.txt", " ", "missing_id")])
    plain = readers.local_tree(files, str(tmp_path / "tree"), [])
    assert plain.where("reason is not null").isEmpty() and readers.strict(plain).count() == 4
    with pytest.raises(Exception, match="duplicate_id"):
        readers.strict(readers.local_tree(files, str(tmp_path / "tree"), ["web"], spark.createDataFrame(rows[5:7], "path string, id string, channel string"))).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in readers.numbered_books(spark, str(tmp_path / "tree")).collect()] == ["book_7.txt"]


def test_archives_have_the_stated_digest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as file:
        file.writestr("one.txt", "some words")
    digest = hashlib.md5((tmp_path / "x.zip").read_bytes()).hexdigest()
    assert readers.zip_records(spark, str(tmp_path / "x.zip"), {"x.zip": digest.upper()}).count() == 1
    with pytest.raises(Exception, match="md5 differs"):
        readers.zip_records(spark, str(tmp_path / "x.zip"), {"x.zip": "0" * 32}).collect()


def test_fetching_is_a_plug_in(spark):
    def fetch(url: str) -> bytes:
        if url == "bad":
            raise OSError("no such host")
        return f"page of {url}".encode()

    rows = {r["url"]: r for r in readers.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), fetch).collect()}
    assert rows["a"]["text"] == "page of a" and rows["a"]["error"] is None and rows["bad"]["error"] == "OSError: no such host" and rows["bad"]["text"] is None


def test_appends_reports_and_manifests(spark):
    old = spark.createDataFrame([("p", "d1", "first", 0)], "profile string, sha256 string, text string, at int")
    new = spark.createDataFrame([("p", "d2", "late", 9), ("p", "d2", "early", 3), ("p", "d1", "again", 1), ("p", None, "none", 2)], old.schema)
    assert sorted(r["text"] for r in sinks.append_new(old, new, ["profile", "sha256"], "at").collect()) == ["early", "first", "none"]
    assert sinks.kept_rows(spark.createDataFrame([("x",), ("y",)], "path string"), spark.createDataFrame([("x",)], "path string")).count() == 1
    found = spark.createDataFrame([(2, 7, "info", "long-sentence", "m"), (2, 3, "warning", "hype-density", "n")], "doc_id long, line int, level string, code string, message string")
    assert [r["said"] for r in sinks.console_lines(found).collect()] == ["2:3 [warning] hype-density: n", "2:7 [info] long-sentence: m", "2: 2"]
    files = spark.createDataFrame([("file:/r/a/x", bytearray(b"1")), ("/r/b/y", bytearray(b"2"))], "path string, content binary")
    assert [r["path"] for r in sinks.hash_manifest(files, "/r", ("b",)).collect()] == ["a/x"]

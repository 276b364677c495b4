"""The data source of files: rows of extract(), files spared by filters, and a stream that goes on after a restart."""

import os
import time
import zipfile

from pyspark.sql import functions as F

from sedimark.sources import documents, readers


def fill(top):
    os.makedirs(top / "sub")
    (top / "a.txt").write_text("first block\n\nsecond block")
    (top / "b.md").write_text("# Head\n\nbody")
    (top / "sub" / "c.html").write_text("<html><body><p>para</p></body></html>")
    (top / "empty.txt").write_text("")
    (top / "odd.bin").write_bytes(bytes(range(256)))
    with zipfile.ZipFile(top / "bad.docx", "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("word/document.xml", "<broken")
    os.symlink(top / "a.txt", top / "link.txt")


def test_rows_are_those_of_extract(spark, tmp_path):
    fill(tmp_path)
    documents.register(spark)
    got = spark.read.format(documents.NAME).option("path", str(tmp_path)).load()
    files = readers.scan(spark, [f"file://{tmp_path}/{n}" for n in ("a.txt", "b.md", "sub/c.html", "empty.txt", "odd.bin", "bad.docx")])
    want = readers.extract(files).select("source_id", F.regexp_replace("path", "^file:/*", "/").alias("path"), "block_ord", "locator", "text", "error")
    ok = got.where("source_id is not null")
    assert sorted(map(tuple, ok.select("source_id", "path", "block_ord", "locator", "text", "error").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    refused = {(os.path.basename(r.path), r.error) for r in got.where("source_id is null").collect()}
    assert refused == {("empty.txt", "empty"), ("odd.bin", "unknown_format")}
    assert {os.path.basename(r.path) for r in spark.read.format(documents.NAME).option("path", str(tmp_path)).option("recursive", "false").load().collect()} == {"a.txt", "b.md", "empty.txt", "odd.bin", "bad.docx"}


def test_parts_are_of_about_equal_bytes():
    files = [(0, f"f{i}", n) for i, n in enumerate([40, 40, 40, 500, 0, 0, 99])]
    assert [p.paths for p in documents.dealt(files, 100)] == [("f0", "f1"), ("f2",), ("f3",), ("f4", "f5"), ("f6",)]
    assert documents.dealt([], 100) == []


def test_filters_spare_files(spark, tmp_path):
    fill(tmp_path)
    reader = documents.DocumentsReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([documents.StringStartsWith(("path",), f"{tmp_path}/sub"), documents.EqualTo(("format",), "html")]))
    assert len(kept) == 2 and [p.paths for p in reader.partitions()] == [(f"{tmp_path}/sub/c.html",)]
    # what a suffix of text names is that text or no text at all
    list(reader.pushFilters([documents.In(("format",), ("md",))]))
    assert {os.path.basename(p) for part in reader.partitions() for p in part.paths} == {"b.md", "bad.docx", "odd.bin"}
    documents.register(spark)
    df = spark.read.format(documents.NAME).option("path", str(tmp_path)).load()
    assert {r.text for r in df.where(F.col("path") == f"{tmp_path}/sub/c.html").collect()} == {"para"}
    assert {r.format for r in df.where(F.col("format").isin("md", "html")).collect()} == {"md", "html"}


def test_the_stream_reads_only_new_files_after_a_restart(spark, tmp_path):
    documents.register(spark)
    top, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    os.makedirs(top)

    def write(name, text):
        (top / name).write_text(text)
        old = time.time() - 60 + len(os.listdir(top))
        os.utime(top / name, (old, old))

    def run():
        stream = spark.readStream.format(documents.NAME).option("path", str(top)).load().select("path", "text")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted((os.path.basename(r.path), r.text) for r in spark.read.schema("path string, text string").parquet(out).collect())

    write("a.txt", "one")
    write("b.txt", "two")
    assert run() == [("a.txt", "one"), ("b.txt", "two")]
    write("c.txt", "three")
    assert run() == [("a.txt", "one"), ("b.txt", "two"), ("c.txt", "three")]
    (top / "young.txt").write_text("not settled")
    os.utime(top / "young.txt", (time.time() + 60, time.time() + 60))
    assert len(run()) == 3

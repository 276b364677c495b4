"""Files: gates, detection, decoding, readers of each format, JSON lines and the store."""

import io
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimark.sources import formats, readers
from sedimark.sources.scratch import shared_dir
from sedimark.sources.store import UnitStore

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts, stored=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name in stored else None)
    return out.getvalue()


def docx(body):
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def epub(spine=True):
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="c2.xhtml"/><item id="b" href="c%201.xhtml"/><item id="c" href="empty.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="c"/><itemref idref="b"/></spine></package>'
    container = '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
    parts = {"mimetype": "application/epub+zip", "OPS/c 1.xhtml": "<h1>first by name</h1><p>more</p>", "OPS/c2.xhtml": "<p>first in spine</p>", "OPS/empty.xhtml": "<p> </p>"}
    return zipped(parts | ({"META-INF/container.xml": container, "OPS/p.opf": opf} if spine else {}))


FILES = {
    "a.txt": "one\n\ntwo\r\n\r\nthree\n \nstill three\n\n\n\nfour".encode(),
    "b.md": b"# head\n\nbody",
    "dup.txt": "one\n\ntwo\r\n\r\nthree\n \nstill three\n\n\n\nfour".encode(),
    "c.html": b"<html><head><title>t</title></head><body><nav>no</nav><p>yes &amp; so</p><div>more<br>lines</div><script>x</script></body></html>",
    "d.docx": docx('<w:p><w:r><w:t>para one</w:t></w:r></w:p><w:p/><w:p ><w:r><w:t xml:space="preserve">two &lt;</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'),
    "e.epub": epub(),
    "f.pdf": b"plainly no pdf",
    "h.md": b"<html><body><p>a page by its content</p></body></html>",
    "gbk.txt": "中文内容在这里".encode("gbk"),
    "i.docx": b"PK\x03\x04broken",
    "j.docx": docx("<w:p><w:r><w:t>" + "0" * 5_000_000 + "</w:t></w:r></w:p>"),
    "k.docx": zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<!DOCTYPE x><w:document {W}/>"}),
    "l.rtf": rb"{\rtf1{\fonttbl Arial;}Hello\par world\tab x\'e9{\*\gen hidden}\~end}",
    "m.mobi": b"BOOKMOBI".ljust(76, b"\0") + struct.pack(">HI", 1, 90) + b"\0" * 20 + b"\0\2" + b"\0" * 9,
    "n.xyz": b"\x00\x01\x02\x03",
    "o.xyz": b"plain text of an unknown kind\x1b",
}


def test_scan_and_extract(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = readers.scan(spark, str(tmp_path))
    seen = {r.path.rsplit("/", 1)[1]: r for r in got.drop("content").collect()}
    assert {k: r.error for k, r in seen.items() if r.error} == {"dup.txt": "duplicate", "i.docx": "damaged", "j.docx": "damaged", "m.mobi": "locked", "n.xyz": "unknown_format"}
    told = {k: (r.format, r.format_source) for k, r in seen.items()}
    assert told["h.md"] == ("html", "content") and told["f.pdf"] == ("pdf", "extension") and told["a.txt"] == ("txt", "both") and told["o.xyz"] == ("txt", "content") and told["e.epub"] == ("epub", "both")
    lines = {}
    for r in sorted(readers.extract(got).collect(), key=lambda r: (r.path, r.block_ord)):
        lines.setdefault(r.path.rsplit("/", 1)[1], []).append(r.text if r.error is None else r.error)
    assert lines == {
        "a.txt": ["one", "two", "three\n \nstill three", "four"], "b.md": ["# head", "body"], "c.html": ["yes & so", "more", "lines"], "d.docx": ["para one", "two <", "x\ty"],
        "e.epub": ["first in spine", "first by name\nmore"], "f.pdf": ["no_reader"], "h.md": ["a page by its content"], "gbk.txt": ["中文内容在这里"], "k.docx": ["xml_unsafe"], "l.rtf": ["Hello\nworld xé end"], "o.xyz": ["plain text of an unknown kind"],
    }
    assert [r.locator for r in readers.extract(got).where("path like '%epub'").orderBy("block_ord").collect()] == ["chapter 1", "chapter 3"]
    clean = readers.extract(got).where("error is null")
    assert {r.issue: r.n for r in readers.contract_violations(clean).collect()} == {"blank": 0, "ordinal": 0, "repeated": 0, "gap": 0}
    assert [t for _, t in formats.file_blocks("epub", epub(False))] == ["first by name\nmore", "first in spine"]


def test_contract_violations(spark):
    good = ("s1", 1, "text", "s1-b1", "s1", "x", "x")
    rows = [good, ("s1", 3, " ", "s1-b4", "s2", "x", "y"), ("s1", 0, "t", "s1-q0", "s1", "x", "x"), good]
    blocks = spark.createDataFrame(rows, "source_id string, block_ord bigint, text string, block_id string, entry_source_id string, locator string, entry_locator string").withColumn("entry_text_sha256", F.sha2("text", 256))
    manifests = spark.createDataFrame([("s9", "s9"), ("zz", "y" * 64)], "source_id string, content_sha256 string")
    got = {r.issue: r.n for r in readers.contract_violations(blocks, manifests).collect()}
    assert got == {"blank": 1, "ordinal": 1, "repeated": 1, "gap": 0, "entry_source": 1, "locator": 1, "text_hash": 0, "block_id": 2, "repeated_id": 1, "no_blocks": 2, "no_manifest": 1, "manifest_id": 1}


def test_discover_refuses_links_and_odd_paths(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    for name in ("d/a.txt", "d/sub/b.txt", "c.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "empty.txt").write_text("")
    os.symlink(tmp_path / "c.txt", tmp_path / "d/link.txt")
    os.symlink(tmp_path / "d", tmp_path / "linked")
    got = readers.discover(spark, [f"{tmp_path}/d", f"{tmp_path}/*.txt", f"{tmp_path}/c.txt", f"{tmp_path}/none.txt", f"{tmp_path}/linked/a.txt"])
    assert {r.path.split(f"{tmp_path}/")[1]: r.error for r in got.collect()} == {"d/a.txt": None, "d/sub/b.txt": None, "c.txt": None, "empty.txt": "empty", "d/link.txt": "symlink", "none.txt": "not_found", "linked/a.txt": "symlink"}
    paths, _ = readers.expand([f"{tmp_path}/d"], recursive=False)
    assert [os.path.basename(p) for p in paths] == ["a.txt"]


def test_decoding_and_detection():
    for text, encoding in (("é ü", "utf-8"), ("中文", "gbk"), ("naïve “x”", "cp1252"), ("a中", "utf-16"), ("a中", "utf-32"), ("é", "utf-8-sig")):
        assert formats.decode(text.encode(encoding)) == text, encoding
    assert formats.decode(b"a\x81") == "a\x81"
    assert formats.looks_like_text(b"abcdefgh") and not formats.looks_like_text(b"abc") and not formats.looks_like_text(b"abcd\0efg") and not formats.looks_like_text(b"\x01\x02abcdef")
    assert formats.detect(b"{\\rtf1 x}", "txt") == ("rtf", "content") and formats.detect(b"\x00" * 8, "pdf") == ("pdf", "extension") and formats.detect(b"\x00" * 8, "") == (None, "extension")
    assert formats.zip_format(zipped({"META-INF/encryption.xml": "x"})) == "epub" and formats.zip_format(zipped({"x": "y"})) is None
    assert formats.is_locked(FILES["m.mobi"]) and not formats.is_locked(b"x" * 50)
    early = zipped({"a": "0" * 200_000, "b": os.urandom(300_000)}, stored=("b",))
    assert formats.archive_fault(early) and not formats.archive_fault(zipped({"b": os.urandom(300_000), "a": "0" * 200_000}))


def test_rtf():
    cases = {
        rb"a\{b\}\\c": r"a{b}\c", rb"x\line y\par\par0 z": "x\ny\n\nz", rb"{\info secret}shown": "shown", rb"{\*\x {deep} y}z": "z", rb"\u233?a": "??a", rb"\u-5 \'3f!": "?!", rb"\ul b": "?l b", rb"\'zzq": "q", b"a\\\r\nb": "ab", b"end\\": "end\\", rb"\_\~": "‑ ",
        rb"\fonttbl hidden": "", rb"}a": "a", rb"{\stylesheet{\s0 n;}}kept": "kept",
    }
    for data, text in cases.items():
        assert formats.rtf_text(data) == text, data


def test_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"unit_id": "a", "n": 1}\n\n{"unit_id": "b", "n": null}\n')
    got = readers.read_jsonl(spark, f"{tmp_path}/u.jsonl", "unit_id string, n bigint").orderBy("ord").collect()
    assert [(r.unit_id, r.n) for r in got] == [("a", 1), ("b", None)]
    assert readers.read_jsonl(spark, f"{tmp_path}/none.jsonl", "unit_id string").collect() == []
    for bad in ('{"unit_id": "a", "more": 1}', '{"unit_id": {"x": 1}, "n": "y"}', "no json"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception):
            readers.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "unit_id string, n bigint").collect()


def test_append_if_new_compares_whole_rows(spark, tmp_path):
    schema = "unit_id string, record_version bigint, ord bigint, kind string, review_status string"
    rows = lambda *x: spark.createDataFrame(x, schema)
    store = UnitStore(spark, f"file://{tmp_path}/store")
    first = ("a", 1, 1, "k", None)
    assert store.append_if_new(rows(first, first, ("a", 1, 1, "k", "candidate"))) == 2
    assert store.append_if_new(rows(first, ("a", 1, 1, "other", None))) == 1
    assert store.versions().count() == 3


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
    assert shared_dir(spark)

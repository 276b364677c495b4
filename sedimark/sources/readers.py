"""Sources: files to gated rows and text blocks.

Files are read by Spark's binaryFile source, so any store that Spark reaches will do. Rows that fail a gate carry an error code and go
to the rejected side; nothing raises for a bad file.
"""

from __future__ import annotations

import glob as globs
import os
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree.ElementTree import ParseError

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import MAX_BYTES, archive_fault, decode, detect, file_blocks, html_lines, is_locked

FILES = "path string, length bigint, format string, format_source string, content_sha256 string, content binary, error string"


def expand(inputs: list[str], recursive: bool = True) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths, refused): local files, folders and globs as files, once each in order of first sight, and (path, error) of those that a look at the folder refuses.

    Links are never followed: a path that is one, or lies under one, is refused, as are missing, empty and unreadable files.
    """
    found: dict[str, None] = {}
    for given in inputs:
        for path in sorted(globs.glob(given, recursive=recursive)) if any(c in given for c in "*?[") else [given]:
            if os.path.isdir(path) and not os.path.islink(path):
                walk = os.walk(path) if recursive else [next(os.walk(path))]
                links = lambda top, names: [os.path.join(top, n) for n in names if os.path.islink(os.path.join(top, n))]
                for top, folders, names in walk:
                    folders.sort()
                    found |= dict.fromkeys(links(top, folders) + [os.path.join(top, n) for n in sorted(names)])
            else:
                found[path] = None
    paths, refused = [], []
    for path in found:
        parts = os.path.abspath(path).split(os.sep)
        if any(os.path.islink(os.sep.join(parts[:n])) for n in range(2, len(parts) + 1)):
            refused.append((path, "symlink"))
        elif not os.path.exists(path):
            refused.append((path, "not_found"))
        elif not os.path.isfile(path):
            refused.append((path, "not_a_file"))
        elif not os.path.getsize(path):
            refused.append((path, "empty"))
        elif not os.access(path, os.R_OK):
            refused.append((path, "unreadable"))
        else:
            paths.append(path)
    return paths, refused


def discover(spark: SparkSession, inputs: list[str], recursive: bool = True) -> DataFrame:
    """scan() of local files, folders and globs, with a row for each path that expand() refuses."""
    paths, refused = expand(inputs, recursive)
    rows = spark.createDataFrame([(p, None, None, None, None, None, e) for p, e in refused], FILES)
    return scan(spark, [f"file://{os.path.abspath(p)}" for p in paths]).unionByName(rows) if paths else rows


def gate(path: str, length: int, content: Callable[[], bytes]) -> tuple[str | None, str | None, str | None]:
    """format, what told it, and error of one file; the content is asked for only if the length passes."""
    if not length or length > MAX_BYTES:
        return None, None, "too_large" if length else "empty"
    data, name = content(), path.rsplit("/", 1)[-1]
    kind, told = detect(data, name.rsplit(".", 1)[-1].lower() if "." in name else "")
    if kind is None:
        return kind, told, "unknown_format"
    if kind in ("epub", "docx") and archive_fault(data):
        return kind, told, "damaged"
    return kind, told, "locked" if kind in ("mobi", "azw", "azw3") and is_locked(data) else None


def read_blocks(kind: str, data: bytes) -> tuple[list[tuple[str | None, str | None]], str | None]:
    """The blocks of one file and its error; a file that cannot be read has one empty block."""
    try:
        return file_blocks(kind, data), None
    except (ValueError, zipfile.BadZipFile, KeyError, ParseError, RuntimeError) as e:
        return [(None, None)], str(e) if isinstance(e, ValueError) and not isinstance(e, UnicodeError) else "unreadable"


def scan(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, length, format, format_source, content_sha256, content and error (null if the file passes) of all files under path.

    Gates in order: empty, too_large, unknown_format, damaged (an archive), locked (a MOBI file), duplicate (same content as a file whose path comes before).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "length", "content")

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for path, length, content in zip(*[batch[c] for c in ("path", "length", "content")]):
                kind, told, error = gate(path.as_py(), length.as_py(), content.as_py)
                for column, value in zip(rows, (kind, told, error)):
                    column.append(value)
            extra = [pa.array(c, pa.string()) for c in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "format", "format_source", "error"])

    kinds = "path string, length bigint, content binary, format string, format_source string, error string"
    files = files.mapInArrow(inspect, kinds).withColumn("content_sha256", F.sha2("content", 256))
    first = files.where("error is null").groupBy("content_sha256").agg(F.min("path").alias("first_path")).withColumnRenamed("content_sha256", "h")
    files = files.join(first, F.col("content_sha256") == F.col("h"), "left")
    error = F.coalesce("error", F.when(F.col("path") != F.col("first_path"), "duplicate"))
    return files.select("path", "length", "format", "format_source", "content_sha256", "content", error.alias("error"))


def extract(files: DataFrame) -> DataFrame:
    """source_id, path, block_ord (from 1), locator, text and error of the files that passed the gates; a file that cannot be read gives one row with an error."""
    rows = files.where("error is null").select(F.substring("content_sha256", 1, 12).alias("source_id"), "path", "format", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_id", "path", "block_ord", "locator", "text", "error"]
        for batch in batches:
            for sid, path, kind, content in zip(*[batch[c] for c in ("source_id", "path", "format", "content")]):
                found, error = read_blocks(kind.as_py(), content.as_py())
                n = len(found)
                same = lambda v: pa.array([v] * n, pa.string())
                texts = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([same(sid.as_py()), same(path.as_py()), pa.array(range(1, n + 1), pa.int64()), *texts, same(error)], names)

    return rows.mapInArrow(run, "source_id string, path string, block_ord bigint, locator string, text string, error string")


def decoded(rows: DataFrame, content: str) -> DataFrame:
    """rows with decoded, the text of the bytes in content, whose encoding is found from them."""
    from pyspark.sql.types import StructType

    at = rows.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if b.as_py() is None else decode(b.as_py()) for b in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", "string"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_ord and text of the block elements of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nth, out = [], [], []
            for pid, text in zip(batch["page_id"].to_pylist(), batch["html"]):
                for k, line in enumerate(html_lines(text.as_py() or ""), 1):
                    ids.append(pid)
                    nth.append(k)
                    out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nth, pa.int64()), pa.array(out, pa.string())], ["page_id", "block_ord", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, block_ord bigint, text string")


def contract_violations(blocks: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """issue and n of what breaks the contract of an extraction.

    blocks: (source_id, block_ord, text[, block_id, entry_source_id, entry_text_sha256, locator, entry_locator]); manifests: (source_id, content_sha256, format).
    Issues: blank texts, ordinals below 1, repeated (source_id, block_ord), gaps in a source's ordinals; where the columns are there also entries of another source,
    with another locator or text hash, with an id that source and ordinal do not give, and ids that repeat; with manifests, sources without blocks or without a manifest and ids that do not begin the hash.
    """
    one = lambda df, issue: df.agg(F.lit(issue).alias("issue"), F.count(F.lit(1)).alias("n"))
    per = blocks.groupBy("source_id").agg(F.max("block_ord").alias("m"), F.countDistinct("block_ord").alias("c"), F.count(F.lit(1)).alias("n"))
    parts = [one(blocks.where("text is null or text rlike '^\\\\s*$'"), "blank"), one(blocks.where("block_ord < 1"), "ordinal"), one(per.where("n > c"), "repeated"), one(per.where("m > c"), "gap")]
    has = set(blocks.columns)
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b) if isinstance(b, str) else b)
    if "entry_source_id" in has:
        parts.append(one(blocks.where(differ("entry_source_id", "source_id")), "entry_source"))
    if "entry_locator" in has:
        parts.append(one(blocks.where(differ("entry_locator", "locator")), "locator"))
    if "entry_text_sha256" in has:
        parts.append(one(blocks.where(differ("entry_text_sha256", F.sha2("text", 256))), "text_hash"))
    if "block_id" in has:
        parts.append(one(blocks.where(~F.col("block_id").rlike("-(?:pg|c|p|t|s|b)[0-9]+$") | differ("block_id", F.concat("source_id", F.regexp_extract("block_id", "(-(?:pg|c|p|t|s|b))[0-9]+$", 1), "block_ord"))), "block_id"))
        parts.append(one(blocks.groupBy("block_id").count().where("count > 1"), "repeated_id"))
    if manifests is not None:
        ids = blocks.select("source_id").distinct()
        parts.append(one(manifests.join(ids, "source_id", "left_anti"), "no_blocks"))
        parts.append(one(ids.join(manifests, "source_id", "left_anti"), "no_manifest"))
        parts.append(one(manifests.where(differ("source_id", F.substring("content_sha256", 1, 12))), "manifest_id"))
    return reduce(DataFrame.unionByName, parts)


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each source (version, then time)."""
    w = Window.partitionBy("source_id").orderBy(F.col("version").desc(), F.col("ingested_at").desc())
    return manifests.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a closed schema, in the order of file and line (ord): a line with a field that the schema lacks, or of another type, is an error. Blank lines are left out; a missing path has no rows."""
    kinds = spark.createDataFrame([], schema).schema
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], f"{schema}, ord bigint")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("ord", F.monotonically_increasing_id())
    keys = F.json_object_keys("value")
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(f.name) for f in kinds.fields])))
    checked = F.when(keys.isNull() | (unknown > 0), F.raise_error(F.concat(F.lit("a line breaks the schema: "), "value"))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, kinds, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")

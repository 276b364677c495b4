"""WARC archives compressed record by record with Zstandard and a dictionary.

An archive starts with a skippable frame that holds the dictionary; each record is a frame of its own. The reader loads
the dictionary from the leading frame, walks from frame to frame by their block headers, and checks magic numbers, lengths,
header lines and digests. It also takes archives of other writers: frames without a content size, skippable frames between records, folded header lines. Archives are rows of a table in the shared folder (name, n_records, content), each of bounded size,
so that Spark's committers make them safe against lost executors.

Of records with equal payloads of at least `least` bytes the one with the largest id is stored as a response, the others
as revisits that refer to it.

Cases: a null payload is empty, a null URL is left out; several rows with the largest id of a group are all responses; if
a group has no id at all, all its rows are responses; a null id stays null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: Fixed values of the formats.
SKIPPABLE, DICTIONARY_FRAME, FRAME = 0x184D2A50, 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
#: Bytes of content after which an archive is closed; bytes of the dictionary; samples it is trained on and their size at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 8 << 20, 16 << 10, 200, 64 << 10
#: Bytes of a record that the reader takes at most.
RECORD_BYTES = 1 << 30


def train_dictionary(df: DataFrame, id_col: str, text_col: str) -> bytes:
    """A dictionary from at most SAMPLES payloads of at most SAMPLE_BYTES each, those with the smallest hashes of id and payload; empty if they are too few.

    Each task would send SAMPLES payloads of its own, so a limit on the hash leaves about four times SAMPLES in all before they are ordered.
    """
    text = F.col(text_col)
    rows = df.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 1).alias("h"), text.alias("t"))
    limit = min((1 << 63) - 1, 4 * SAMPLES * (1 << 63) // max(1, df.count()))
    few = rows.where(F.col("h") <= limit).groupBy("h").agg(F.first("t").alias("t"))
    texts = [r[0].encode() for r in few.orderBy("h").select("t", "h").limit(SAMPLES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(rid: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record. The block is an HTTP response, for a revisit its header alone, whose Content-Length tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at `at` ends, from its header and block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no Zstandard frame")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("a block of reserved type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def _content(reader: zstandard.ZstdDecompressor, frame: bytes, most: int) -> bytes:
    """What a frame holds, with or without its size in the header, if it is not above most."""
    try:
        size = zstandard.get_frame_parameters(frame).content_size
        if size not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
            if size > most:
                raise ValueError("a record is too large")
            return reader.decompress(frame)
        parts, size = [], 0
        with reader.stream_reader(frame) as stream:
            while part := stream.read(1 << 20):
                parts.append(part)
                size += len(part)
                if size > most:
                    raise ValueError("a record is too large")
        return b"".join(parts)
    except zstandard.ZstdError as fault:
        raise ValueError(str(fault)) from fault


def read_archive(data: bytes, most: int = RECORD_BYTES) -> Iterator[bytes]:
    """The records of an archive, decompressed, one for each frame. Skippable frames between records are passed over; any fault raises ValueError."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) < at + 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE <= magic < SKIPPABLE + 16:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_FRAME and size:
                content = data[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
                    content = _content(reader, content, most)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        end = frame_end(data, at)
        yield _content(reader, data[at:end], most)
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case; a line that begins with white space continues the one before) and block of a record; raises ValueError where it is not well formed."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last is not None:
            fields[last] = f"{fields[last]} {line.decode().strip()}".strip()
            continue
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        last = name.strip().lower()
        fields[last] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing header fields: {', '.join(sorted(missing))}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    return fields, rest[:size]


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not found:
        raise ValueError("a record id that is no page")
    return int(found[1]) if found[1] else None


def describe(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(id, payload bytes, payload digest, record type, id referred to) of a record; a response's payload is checked against its digest."""
    fields, block = parse_record(raw)
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?mi)^content-length: *(\d+)\s*$", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not found or not size:
        raise ValueError("no HTTP header")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload differs from its length or digest")
    refers = fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), int(size[1]), digest, kind, _page(refers) if refers else None


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Archives (name, n_records, content) of all rows, staged in the shared folder.

    Digests of payloads that occur more than once are found by a grouped sum of (digest, largest id); the payloads then meet
    that table in one join, which Spark broadcasts if it is small and otherwise shuffles, splitting hot digests.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= least
    groups = staged(rows.where(large).groupBy("digest").agg(F.max("id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null").select(F.col("digest").alias("__d"), "__first"), "payloads")
    roles = rows.join(groups, (F.col("digest") == F.col("__d")) & large, "left")
    roles = roles.withColumn("refers_to", F.when(~F.col("__first").eqNullSafe(F.col("id")), F.col("__first"))).select("id", "url", "payload", "digest", "refers_to")
    dictionary = train_dictionary(df, id_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        opening = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
        held, size, n, number = [opening], len(opening), 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}.warc.zst"]), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["name", "n_records", "content"])

        for batch in batches:
            columns = [batch[c] for c in ("id", "url", "payload", "digest", "refers_to")]
            for rid, url, data, digest, refers in zip(*columns):
                frame = writer.compress(record(rid.as_py(), url.as_py(), data.as_py(), digest.as_py(), refers.as_py()))
                held.append(frame)
                size, n = size + len(frame), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, n, number = [opening], len(opening), 0, number + 1
        if n:
            yield close()

    out = staged(roles.mapInArrow(run, "name string, n_records bigint, content binary"), "archives", "none")
    unstage(groups)
    return out


def read_records(archives: DataFrame) -> DataFrame:
    """record_type, record_id, date, uri, fields (all header fields) and block of each record of any archives (a column content), such as the binaryFile source gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "date", "uri", "fields", "block"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
        for batch in batches:
            for content in batch["content"]:
                for raw in read_archive(content.as_buffer().to_pybytes()):
                    f, block = parse_record(raw)
                    row = (f["warc-type"], f["warc-record-id"], f["warc-date"], f.get("warc-target-uri"), list(f.items()), block)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    return archives.select("content").mapInArrow(run, "record_type string, record_id string, date string, uri string, fields map<string,string>, block binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives (a column content, as from write_archives or the binaryFile source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = [describe(raw) for raw in read_archive(content.as_buffer().to_pybytes())]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")

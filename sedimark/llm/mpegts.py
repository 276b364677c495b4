"""Media columns: payloads as MPEG transport streams, and features read back from the stored bytes.

The writer puts each payload into access units of a private elementary stream, one PES packet with a presentation time
each, dealt over 188-byte transport packets behind a program association and a program map table. The reader parses the
tables, checks sync bytes, section CRCs and continuity counters, reassembles the PES packets and stores all presentation times
and random-access points, as runs of equal steps. A packet may come twice and a counter may jump where the packet says so; both are legal and no errors.
The streams are written to a table in the shared folder, and what is returned comes from reading that table.

Cases: a null text is empty and gives one padding unit; texts of any length stream through in units; equal texts give
equal bytes; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Fixed values of the container format.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID = 188, 0x47, 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID, PROGRAM = 0x06, 0xBD, 1
#: Bytes of padding unit and of an access unit; ticks of 90 kHz between units; units between random-access points.
UNIT, ACCESS_UNIT, TICKS, KEY_EVERY = 192, 192 * 16, 3003, 8
#: Bytes of output rows that one Arrow batch gathers.
BATCH_BYTES = 8 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC of table sections: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    out: list[bytes] = []
    count = {PAT_PID: 0, PMT_PID: 0, ES_PID: 0}

    def packet(pid: int, first: bool, adaptation: bytes | None, body: bytes) -> None:
        """adaptation: flags and fields behind the length byte; what room is left is stuffed there."""
        room = PACKET - 4 - len(body)
        if adaptation is None and not room:
            field = b""
        else:
            field = bytes([room - 1]) + ((adaptation or b"\0").ljust(room - 1, b"\xff") if room > 1 else b"")
        out.append(struct.pack(">BHB", SYNC, first << 14 | pid, (0x30 if field else 0x10) | count[pid]) + field + body)
        count[pid] = count[pid] + 1 & 15

    for k in range(-(-len(payload) // ACCESS_UNIT)):
        data = payload[k * ACCESS_UNIT : (k + 1) * ACCESS_UNIT]
        pts, key = k * TICKS, k % KEY_EVERY == 0
        if key:
            for pid, section in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
                packet(pid, True, None, (b"\0" + section).ljust(PACKET - 4, b"\xff"))
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")  # base, reserved bits, extension 0
        lead = b"\x50" + clock if key else None
        take = PACKET - 4 - (1 + len(lead) if lead else 0)
        packet(ES_PID, True, lead, pes[:take])
        for at in range(take, len(pes), PACKET - 4):
            packet(ES_PID, False, None, pes[at : at + PACKET - 4])
    return b"".join(out)


def runs(times: list[int]) -> str:
    """All of times as runs first+step*steps of equal steps, joined by commas."""
    out, at = [], 0
    while at < len(times):
        end = at + 1
        while end < len(times) and times[end] - times[end - 1] == times[at + 1] - times[at]:
            end += 1
        out.append(str(times[at]) if end == at + 1 else f"{times[at]}{times[at + 1] - times[at]:+d}*{end - at - 1}")
        at = end
    return ",".join(out)


@dataclass
class Demuxed:
    """What demux() finds."""

    payload: bytes = b""
    packets: int = 0
    programs: int = 0
    pid: int = -1
    stream_type: int = -1
    errors: int = 0
    repeats: int = 0
    jumps: int = 0
    times: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    def feature(self) -> str:
        """The stream's features as name=value pairs: pts has all presentation times, rap those of random-access points, as runs()."""
        counts = f"packets={self.packets};programs={self.programs};pid={self.pid};type={self.stream_type};pes={len(self.times)}"
        return f"{counts};cc_errors={self.errors};repeats={self.repeats};jumps={self.jumps};pts={runs(self.times)};rap={runs(self.keys)}"


def _table(body: bytes) -> bytes | None:
    """The section in a packet's body if its CRC is right."""
    at = 1 + (body[0] if body else PACKET)
    if at + 3 > len(body):
        return None
    size = struct.unpack_from(">H", body, at + 1)[0] & 0x0FFF
    whole = body[at : at + 3 + size]
    return whole if len(whole) == 3 + size and crc32_mpeg(whole) == 0 else None


def demux(stream: bytes) -> Demuxed:
    """Read a transport stream. Wrong lengths, sync bytes, table CRCs or PES headers raise ValueError; gaps in continuity are counted."""
    if len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    got = Demuxed(packets=len(stream) // PACKET)
    pmt, parts, current, key = -1, [], [], False
    last: dict[int, tuple[int, bytes, bool]] = {}  # by PID: counter, body, whether the packet is a repeat

    def close() -> None:
        if not current:
            return
        pes = b"".join(current)
        current.clear()
        if len(pes) < 9 or len(pes) < 9 + pes[8] or pes[:3] != b"\0\0\1":
            raise ValueError("no PES start code")
        length = pes[4] << 8 | pes[5]
        if length and length != len(pes) - 6:
            raise ValueError("a PES packet is not whole")
        if pes[7] & 0x80 and pes[8] >= 5:
            got.times.append(_unstamp(pes[9:14]))
            if key:
                got.keys.append(got.times[-1])
        parts.append(pes[9 + pes[8] :])

    seen: dict[bytes, bytes] = {}
    for at in range(0, len(stream), PACKET):
        sync, flags, control = struct.unpack_from(">BHB", stream, at)
        if sync != SYNC:
            raise ValueError("lost sync")
        pid, body_at, random_access, jump = flags & 0x1FFF, at + 4, False, False
        if control & 0x20:
            size = stream[body_at]
            random_access, jump = size > 0 and bool(stream[body_at + 1] & 0x40), size > 0 and bool(stream[body_at + 1] & 0x80)
            body_at += 1 + size
            if body_at > at + PACKET:
                raise ValueError("an adaptation field is longer than its packet")
        if not control & 0x10:
            continue
        counter, body = control & 15, stream[body_at : at + PACKET]
        if pid in last:
            before, same, again = last[pid]
            if counter == before and body == same and not again and not jump:
                got.repeats += 1
                last[pid] = counter, body, True
                continue
            if counter != before + 1 & 15:
                if jump:
                    got.jumps += 1
                else:
                    got.errors += 1
        last[pid] = counter, body, False
        if pid == got.pid:
            if flags & 0x4000:
                close()
                key = random_access
            current.append(body)
        elif pid in (PAT_PID, pmt):
            if body not in seen:
                section = _table(body)
                if section is None:
                    raise ValueError("a table's CRC is wrong")
                seen[body] = section
            section = seen[body]
            if pid == PAT_PID:
                entries = [struct.unpack_from(">HH", section, i) for i in range(8, len(section) - 4, 4)]
                got.programs = sum(n > 0 for n, _ in entries)
                pmt = next((p & 0x1FFF for n, p in entries if n), -1)
            else:
                skip = 12 + (struct.unpack_from(">H", section, 10)[0] & 0x0FFF)
                got.stream_type, pid_field = struct.unpack_from(">BH", section, skip)
                got.pid = pid_field & 0x1FFF
    close()
    got.payload = b"".join(parts)
    return got


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (a transport stream) of each row. Narrow, no shuffle."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, sizes, media, held = 0, batch["id"], [], [], 0
            for i, text in enumerate(batch["text"]):
                data = text.as_buffer().to_pybytes()
                sizes.append(len(data))
                media.append(mux(padded(data)))
                held += len(media[-1])
                if held > BATCH_BYTES or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
                    at, sizes, media, held = i + 1, [], [], 0

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table of encode_media(), written to the shared folder. Stuffing and repeated tables cost little, as the file format compresses its pages."""
    return staged(encode_media(df, id_col, text_col), "media", "zstd")


def read_media(df: DataFrame) -> DataFrame:
    """Digests and features of the streams that write_media() stored, from their bytes alone."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for stream in batch["media"]:
                raw = stream.as_buffer().to_pybytes()
                got = demux(raw)
                for column, value in zip(out, (len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), got.feature())):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_bytes"], *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return df.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

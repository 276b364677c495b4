"""Blocks of texts: runs of about `limit` bytes of a task's rows, whose units (words, segments) are coded by the block's own dictionary.

A block's dictionary names each unit once, most frequent first, so what leaves the block is its distinct units and small codes instead of
every occurrence. Both are packed with Zstandard, so rows are few and short. Memory holds one block at a time; a text longer than
the limit is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks of at most limit bytes of text, unless one text is longer. The number is unique among all tasks."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    parts: list[pa.RecordBatch] = []
    held, number = 0, 0
    for batch in batches:
        sizes = np.diff(_offsets(batch[text]))
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at:]) + held
            take = int(np.searchsorted(ends, limit, "right"))
            if not take and not parts:
                take = 1
            if take:
                parts.append(batch.slice(at, take))
                held += int(sizes[at : at + take].sum())
                at += take
            if at < batch.num_rows:
                yield first + number, pa.Table.from_batches(parts).combine_chunks()
                parts, held, number = [], 0, number + 1
    if parts:
        yield first + number, pa.Table.from_batches(parts).combine_chunks()


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)


def single(column: pa.ChunkedArray) -> pa.Array:
    """The column of a combined table as one array."""
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def coded(units: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the units, and the distinct units by code, most frequent first."""
    found = units.dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(codes, minlength=len(found.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], found.dictionary.take(pa.array(order))


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1, by planes of bytes, compressed."""
    data = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(data.T).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def starts(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def joined(parts: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """The parts of each run [ends[i], ends[i + 1]) joined by mark."""
    import pyarrow.compute as pc

    runs = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), parts)
    return pc.binary_join(runs, pa.scalar(mark, parts.type))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each run [ends[i], ends[i + 1])."""
    total = starts(values)
    return total[ends[1:]] - total[ends[:-1]]


def spread(ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The positions of the runs that the codes name, one run behind the other."""
    lengths = (ends[1:] - ends[:-1])[codes]
    begin = starts(lengths)
    return np.arange(begin[-1]) + np.repeat(ends[:-1][codes] - begin[:-1], lengths)

"""BPE encoding and decoding by a table of distinct words.

Texts are split into words at ASCII white space, by blocks. A block's distinct words go to the task of their bucket, where each distinct
word is encoded once; its ids go back to the blocks, and every text takes the ids of its words by their positions. Decoding looks the
ids up in the id-to-piece table of the tokenizer, once for each distinct word of a block; that table has as many rows as the vocabulary, which bounds it.

This rests on a tokenizer whose pre-tokens never span white space (WordIds.by_word) and that joins pieces by a space (no decoder). With any other
tokenizer texts are encoded and decoded as a whole.

decode_ids() decodes any table of ids by a join with the id-to-piece table.

Cases: a null text is empty and has no ids; texts of white space alone have none either; special tokens in texts are what the tokenizer takes
them for; a text of any length is encoded whole; equal texts get equal values; an empty table gives an empty result; a
null or repeated id is kept as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import coded, joined, single, spread, squeeze, starts, text_blocks, unsqueeze
from .common import bucketed, staged
from .packing import WordIds

#: Bytes of text in a block, and the distinct words that a task remembers at most.
BLOCK, REMEMBERED = 16 << 20, 1_000_000


def vocabulary(tokenizer: str) -> list[str]:
    """The pieces of a tokenizer by id; ids without a piece have ''."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    out = [""] * (max(pieces.values(), default=-1) + 1)
    for piece, i in pieces.items():
        out[i] = piece
    return out


def by_words(tokenizer: str) -> bool:
    """Whether a tokenizer may encode and decode word by word."""
    return WordIds.of_worker(tokenizer).by_word and json.loads(WordIds.of_worker(tokenizer).tokenizer.to_str())["decoder"] is None


def _digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]


def _blocks(rows: DataFrame, kind: str, buckets: int, limit: int) -> DataFrame:
    """For each block a row (bucket -1) with the ids of its documents, their numbers of words and the codes, and for each bucket a row with its words.

    A word's code is its place among the block's words by bucket and then by frequency.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for number, block in text_blocks(batches, limit):
            words = pc.ascii_split_whitespace(single(block["text"]))
            flat, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
            keep = pc.not_equal(flat, "")  # white space at an end leaves an empty part
            kept = starts(keep.to_numpy(zero_copy_only=False))[offsets - offsets[0]]
            codes, distinct = coded(flat.filter(keep))
            plain = distinct.cast(pa.binary()).to_pylist()
            bucket = np.fromiter(map(zlib.crc32, plain), np.uint32, len(plain)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            data = [zstandard.compress(b" ".join(plain[k] for k in order[cuts[b] : cuts[b + 1]]), 1) for b in full]
            n = 1 + len(full)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)),
                    pa.array([-1, *full.tolist()], pa.int32()),
                    pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), single(block["id"])), pa.nulls(n - 1, pa.list_(block["id"].type))]),
                    pa.array([squeeze(np.diff(kept)), *[b""] * (n - 1)], pa.binary()),
                    pa.array([squeeze(place[codes]), *data], pa.binary()),
                ],
                ["block", "bucket", "ids", "lengths", "data"],
            )

    return rows.mapInArrow(run, f"block bigint, bucket int, ids array<{kind}>, lengths binary, data binary")


def _encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """block, bucket, lengths and data of the ids of each row's words, each distinct word of a task encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = WordIds.of_worker(tokenizer), {}
        for batch in batches:
            lengths, data = [], []
            for packed in batch["data"]:
                ids = []
                for w in zstandard.decompress(packed.as_buffer()).split(b" "):
                    found = known.get(w)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[w] = encode.of_word(w)
                    ids.append(found)
                lengths.append(squeeze(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4))
                data.append(squeeze(np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["bucket"], pa.array(lengths, pa.binary()), pa.array(data, pa.binary())], ["block", "bucket", "lengths", "data"])

    return words.mapInArrow(run, "block bigint, bucket int, lengths binary, data binary")


def encode_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each text."""
    return _texts(df, tokenizer, id_col, text_col, limit, True)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK) -> DataFrame:
    """id, ids (array of int) and decoded of each text."""
    return _texts(df, tokenizer, id_col, text_col, limit, False)


def _results(ids: pa.Array, lengths: np.ndarray, id_texts: pa.Array | None, decoded: pa.Array, numbers: np.ndarray | None) -> pa.Table:
    if numbers is None:
        return pa.table([ids, pa.array(lengths, pa.int64()), pa.array(_digests(id_texts), pa.string()), pa.array(_digests(decoded), pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return pa.table([ids, pa.ListArray.from_arrays(pa.array(starts(lengths), pa.int32()), pa.array(numbers, pa.int32())), decoded.cast(pa.string())], ["id", "ids", "decoded"])


def _texts(df: DataFrame, tokenizer: str, id_col: str, text_col: str, limit: int, digests: bool) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    if not by_words(tokenizer):
        return rows.mapInArrow(_whole(tokenizer, digests), schema)
    buckets = 1 << min(12, max(6, rows.rdd.getNumPartitions().bit_length()))  # with more input, more buckets; at 4096 a bucket's words still fit a task
    # what the blocks hold is compressed already
    table = bucketed(_blocks(rows, kind, buckets, limit), "block", "words")
    docs = table.filter("bucket < 0").select("block", "ids", "lengths", "data")
    words = _encode_words(table.filter("bucket >= 0").select("block", "bucket", "data").repartition("bucket"), tokenizer)
    pieces = vocabulary(tokenizer)  # bounded by the vocabulary

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        per_word = np.concatenate([np.zeros(0, np.uint32), *[unsqueeze(x.as_buffer()) for x in right["lengths"]]]).astype(np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint32), *[unsqueeze(x.as_buffer()) for x in right["data"]]])
        ends = starts(per_word)
        at = pa.array(tokens)
        piece_texts = joined(pa.array(pieces, pa.large_string()).take(at), ends, " ")
        id_texts = joined(pa.array([str(i) for i in range(len(pieces))], pa.large_string()).take(at), ends, " ") if digests else None
        out = []
        for ids, n_words, data in zip(left["ids"], left["lengths"], left["data"]):
            codes, bounds = unsqueeze(data.as_buffer()), starts(unsqueeze(n_words.as_buffer()))
            some = per_word[codes] > 0  # words of other white space have no ids
            codes, bounds = codes[some], starts(some)[bounds]
            where = pa.array(codes)
            lengths = np.diff(starts(per_word[codes])[bounds])
            out.append(
                _results(
                    ids.values,
                    lengths,
                    joined(id_texts.take(where), bounds, " ") if digests else None,
                    joined(piece_texts.take(where), bounds, " "),
                    None if digests else tokens[spread(ends, codes)],
                )
            )
        return pa.concat_tables(out)

    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(back, schema)


def _whole(tokenizer: str, digests: bool):
    """Texts one by one, for tokenizers that do not work word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordIds.of_worker(tokenizer).tokenizer
        own.no_truncation()
        own.no_padding()
        for batch in batches:
            found = [own.encode(t, add_special_tokens=False).ids for t in batch["text"].to_pylist()]
            decoded = pa.array([own.decode(i, skip_special_tokens=False) for i in found], pa.large_string())
            numbers = None if digests else np.array([x for i in found for x in i], np.int64)
            texts = pa.array([" ".join(map(str, i)) for i in found], pa.large_string()) if digests else None
            yield from _results(batch["id"], np.array([len(i) for i in found], np.int64), texts, decoded, numbers).combine_chunks().to_batches()

    return run


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """piece_id and piece, one row for each id of the vocabulary."""
    return spark.createDataFrame(list(enumerate(vocabulary(tokenizer))), "piece_id int, piece string")


def decode_ids(df: DataFrame, tokenizer: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id and decoded of any table of ids, for tokenizers that join pieces by a space: a join with the id-to-piece table.

    Ids outside the vocabulary are left out, as the tokenizers library does; a null list is empty; rows may repeat.
    """
    rows = staged(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).withColumn("row", F.monotonically_increasing_id()), "ids")
    pieces = F.broadcast(piece_table(df.sparkSession, tokenizer).filter("piece <> ''"))  # as many rows as the vocabulary
    found = rows.select("row", F.posexplode("ids").alias("pos", "piece_id")).join(pieces, "piece_id")
    texts = found.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s.piece), " ").alias("decoded"))
    return rows.join(texts, "row", "left").select("id", F.coalesce("decoded", F.lit("")).alias("decoded"))

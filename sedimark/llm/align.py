"""Alignment of two tokenizers: which tokens of a byte-level BPE (A) and of a sentencepiece model (B) cover the same bytes.

A text is encoded by both. Interval coalescing: all tokens of both sides are sorted by start (lexsort), the ends' running maximum
is taken (maximum.accumulate), and a group breaks where a start reaches it; within groups overlapping tokens are expanded to links.
Corpus-wide, the documents that hold a pair of ids linked are counted, and each A id has its most frequent partners.

Texts are cut into segments, a run of white space that starts with a space and what follows up to the next such run. Neither side has tokens
across the cut (separable() checks what this rests on; other tokenizers take each text as one segment), so groups and links of a text
are those of its segments, and each distinct segment of a block is encoded and aligned once. Blocks keep their documents' segments as codes
of their own dictionary; only a block's distinct pairs are counted, joined with the corpus-wide counts, and come back to the block.

Cases: a null or empty text, and one whose joined bytes on either side differ from space + text (as where it holds U+2581), has no tokens, zeros
and '' as digest; special tokens' strings are plain text; ties for the most frequent partner all count; a text of any length is aligned whole;
rows that repeat count as documents of their own; a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import coded, joined, single, spread, squeeze, starts, sums, text_blocks, unsqueeze
from .common import bucketed
from .packing import ALPHABET

#: Bytes of text in a block, the links that are sorted at once when documents are counted, and the segments that are encoded at once.
BLOCK, AT_ONCE, LISTS = 6 << 20, 1_000_000, 20_000
SPACE_MARK = "▁"
#: Fixed value: how a byte-level BPE with use_regex splits texts.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of any kind at the end, after which a space is not a cut; characters whose class may depend on the Unicode version.
BLANK_END, UNUSUAL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\z", r"[^\x00-\x{24f}]"
_WORKER: dict[tuple[str, str], "Sides"] = {}


class Sides:
    """Both tokenizers, their tokens' bytes, and whether texts may be cut into segments."""

    @classmethod
    def of_worker(cls, a: str, b: str) -> "Sides":
        if (a, b) not in _WORKER:
            _WORKER[a, b] = cls(a, b)
        return _WORKER[a, b]

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        declared = json.loads(self.a.to_str())
        byte = {c: k for k, c in ALPHABET.items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        of_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            of_a[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        self.bytes_a, self.bytes_b = pa.array(of_a, pa.large_binary()), pa.array(of_b, pa.large_binary())
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (of_a, of_b))
        self.names_a, self.names_b = (pa.array([str(i) for i in range(len(side))], pa.large_string()) for side in (of_a, of_b))
        self.separable = separable(declared, pieces)
        self.fast = _ranked(declared, of_a)

    def encode_a(self, texts: list[str], unusual: np.ndarray) -> list[list[int]]:
        """Ids of texts. Where the merges' order is that of the ids, usual characters go through the faster library with the same vocabulary."""
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return [self.a.encode(t, add_special_tokens=False).ids if odd else self.fast.encode_ordinary(t) for t, odd in zip(texts, unusual.tolist())]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts with a space before them; the library adds none to an empty text."""
        return [ids or [self.b.piece_to_id(SPACE_MARK)] for ids in (self.b.encode(texts, num_threads=1) if texts else [])]

    def encode(self, plain: pa.Array, unusual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number by text, and those of B, of texts with a space before them; some at a time, so that few lists are held."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(plain), LISTS):
            texts = plain.slice(at, LISTS).to_pylist()
            for k, ids in ((0, self.encode_a([" " + t for t in texts], unusual[at : at + LISTS])), (2, self.encode_b(texts))):
                out[k].append(np.fromiter(chain.from_iterable(ids), np.int64))
                out[k + 1].append(np.fromiter(map(len, ids), np.int64, len(ids)))
        a, n_a, b, n_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
        return a, n_a, b, n_b


def separable(declared: dict, pieces: list[str]) -> bool:
    """Whether no token of either side spans the start of a run of white space, if that starts with a space.

    A splits as SPLIT does, whose parts never have white space behind another character; no piece of B has a space behind another character.
    """
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    split = declared["pre_tokenizer"] or {}
    return declared["normalizer"] is None and plain.items() <= split.items() and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)


def _ranked(declared: dict, of_a: list[bytes]):
    """The same BPE in the library that takes ranks for merges, or None where ids are not in the order of the merges."""
    model = declared["model"]
    merges = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if ids != sorted(set(ids)) or len(model["vocab"]) - len(ids) < 256 or declared["normalizer"] is not None or not plain.items() <= (declared["pre_tokenizer"] or {}).items():
        return None
    import tiktoken

    merged = set(ids)
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={of_a[i]: i for i in model["vocab"].values() if i in merged or len(of_a[i]) == 1}, special_tokens={})


def segments(texts: pa.Array, cut: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the texts' segments, the bounds of each text among them, and the distinct segments without their first space."""
    import pyarrow.compute as pc

    if not cut:
        full = pc.not_equal(texts, "")
        codes, distinct = coded(texts.filter(full))
        return codes, starts(full.to_numpy(zero_copy_only=False)), distinct
    parts = pc.split_pattern(texts, " ")
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    found = flat.dictionary_encode()
    open_end = pc.or_(pc.equal(found.dictionary, ""), pc.match_substring_regex(found.dictionary, BLANK_END)).to_numpy(zero_copy_only=False)
    open_end = open_end[found.indices.to_numpy(zero_copy_only=False)]
    open_end[bounds[1:] - 1] = False  # the text ends there
    if open_end.any():
        begin = np.concatenate([[True], ~open_end[:-1]])
        begin[bounds[:-1]] = True
        at = np.append(np.flatnonzero(begin), len(flat))
        flat = joined(flat, at, " ")
        bounds = np.searchsorted(at, bounds)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if empty.any():  # of these the one part is no segment
        keep = np.ones(len(flat), bool)
        keep[bounds[:-1][empty]] = False
        flat, bounds = flat.filter(pa.array(keep)), starts(keep)[bounds]
    codes, distinct = coded(flat)
    return codes, bounds, distinct


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of A and of B, and the tokens of A and of B that each link names. Each side's tokens lie one behind the other."""
    begin, side = np.concatenate([start_a, start_b]), np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, begin))
    reach = np.maximum.accumulate(np.concatenate([end_a, end_b])[order])
    new = np.ones(len(order), bool)
    new[1:] = begin[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    many = last - first
    return group[: len(start_a)], group[len(start_a) :], np.repeat(np.arange(len(start_a)), many), np.arange(many.sum()) + np.repeat(first - starts(many)[:-1], many)


class Aligned:
    """The distinct segments of a block, aligned: tokens, groups, links and the groups' spelling, all by segment."""

    def __init__(self, sides: Sides, plain: pa.Array):
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(plain, UNUSUAL).to_numpy(zero_copy_only=False)
        a, n_a, b, n_b = sides.encode(plain, odd)
        whole = pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), plain.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
        same = lambda of, ids, n: pc.equal(joined(of.take(pa.array(ids)), starts(n), b""), whole).to_numpy(zero_copy_only=False)
        self.right = same(sides.bytes_a, a, n_a) & same(sides.bytes_b, b, n_b)
        a, b = a[np.repeat(self.right, n_a)], b[np.repeat(self.right, n_b)]
        self.n_a, self.n_b = n_a * self.right, n_b * self.right
        end_a, end_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
        group_a, group_b, at_a, at_b = coalesce(end_a - sides.size_a[a], end_a, end_b - sides.size_b[b], end_b)
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        bounds_a, bounds_b = (np.searchsorted(g, np.arange(n_groups + 1)) for g in (group_a, group_b))
        segment = np.repeat(np.arange(len(plain)), self.n_a)
        self.groups = np.searchsorted(segment[bounds_a[:-1]], np.arange(len(plain) + 1))
        self.links = np.searchsorted(segment[at_a], np.arange(len(plain) + 1))
        keys, self.pair = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
        self.pairs = keys >> 32, keys & 0xFFFFFFFF
        spelled = pc.binary_join_element_wise(joined(sides.names_a.take(pa.array(a)), bounds_a, ","), joined(sides.names_b.take(pa.array(b)), bounds_b, ","), pa.scalar("|", pa.large_string()))
        self.spelling = joined(spelled, self.groups, ";")

    def documents(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many texts hold each pair."""
        out = np.zeros(len(self.pairs[0]), np.int64)
        many = sums(np.diff(self.links)[codes], bounds)
        slices = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + AT_ONCE, AT_ONCE), "left")
        cuts = np.unique(np.concatenate([[0], slices, [len(many)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = spread(self.links, codes[bounds[lo] : bounds[hi]])
            key = np.unique(np.repeat(np.arange(hi - lo), many[lo:hi]) * len(out) + self.pair[at])
            out += np.bincount(key % len(out), minlength=len(out)) if len(key) else 0
        return out


def _aligned_blocks(rows: DataFrame, kind: str, a: str, b: str, limit: int, spelled: bool) -> DataFrame:
    """A row for each block: its documents' counts and digests, their segments, the segments' links and the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides.of_worker(a, b)
        for number, block in text_blocks(batches, limit):
            codes, bounds, distinct = segments(single(block["text"]), sides.separable)
            found = Aligned(sides, distinct)
            wrong = sums(~found.right[codes], bounds) > 0
            if wrong.any():
                keep = ~np.repeat(wrong, np.diff(bounds))
                codes, bounds = codes[keep], starts(keep)[bounds]
            groups = joined(found.spelling.take(pa.array(codes)), bounds, ";")
            digests = [hashlib.sha256(g.as_buffer()).hexdigest() if g.as_buffer().size else "" for g in groups]
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            packed = lambda x: pa.array([squeeze(x)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    lists(single(block["id"]), None),
                    *[lists(sums(x[codes], bounds), pa.int64()) for x in (found.n_a, found.n_b, np.diff(found.groups), np.diff(found.links))],
                    lists(digests, pa.string()),
                    lists(groups.cast(pa.string()) if spelled else pa.nulls(len(digests), pa.string()), None),
                    *[packed(x) for x in (np.diff(bounds), codes, np.diff(found.links), found.pair)],
                    *[lists(x, pa.int32()) for x in found.pairs],
                    lists(found.documents(codes, bounds), pa.int64()),
                ],
                ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "groups", "lengths", "codes", "n_pairs", "pair", "a", "b", "docs"],
            )

    return rows.mapInArrow(
        run,
        f"block bigint, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, groups array<string>, "
        "lengths binary, codes binary, n_pairs binary, pair binary, a array<int>, b array<int>, docs array<bigint>",
    )


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def _counted(table: DataFrame) -> DataFrame:
    """a, b, docs and most (the highest of a's docs) over all blocks. A partition of the window has at most as many rows as B has ids."""
    pairs = table.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    return pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")).withColumn("most", F.max("docs").over(Window.partitionBy("a")))


def pair_counts(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK) -> DataFrame:
    """a, b, docs, most: in how many documents the ids are linked, and the highest such number of the A id."""
    rows, kind = _rows(df, id_col, text_col)
    return _counted(_aligned_blocks(rows, kind, a, b, limit, False))


def align_documents(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK, spelled: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and if spelled, groups) of each document; a and b are the tokenizers' files."""
    rows, kind = _rows(df, id_col, text_col)
    table = bucketed(_aligned_blocks(rows, kind, a, b, limit, spelled), "block", "aligned", "snappy")
    back = table.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p")).select("block", "pos", "p.a", "p.b").join(_counted(table), ["a", "b"]).select(F.col("block").alias("of"), "pos", "docs", (F.col("docs") == F.col("most")).alias("best"))
    docs = table.drop("a", "b", "docs")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pos"].to_numpy())
        count, best = right["docs"].to_numpy()[order], right["best"].to_numpy()[order]
        row = {name: left[name].combine_chunks() for name in left.column_names}
        lengths, codes, n_pairs, pair = (unsqueeze(row[c][0].as_buffer()) for c in ("lengths", "codes", "n_pairs", "pair"))
        bounds, links = starts(lengths), starts(n_pairs)
        of = lambda values: pa.array(sums(sums(values[pair], links)[codes], bounds), pa.int64())
        columns = [*[row[c].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")], of(best), of(count), row["digests"].values, row["groups"].values]
        return pa.table(columns, names[: len(columns)])

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    out = docs.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        finish, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"
    )
    return out if spelled else out.drop("groups")

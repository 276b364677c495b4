"""Best-fit packing by minimum bin slack.

Pieces of at most `size` tokens are packed into sequences. Only how many pieces have each length matters for the choice, a
table of at most `size` rows, so the choice is made on it: a bin takes the largest length left, a bitset subset-sum over
the lengths left (with their multiplicities) finds the fullest combination that goes with it, and the combination is
removed as often as its lengths last, which is what removing it bin by bin would do. The result is a list of bin patterns, at most about
one for each length. Spark then numbers the pieces of each length and looks up each number's bin and offset.

Cases: a null text is empty and has the end token alone; a text of any length is cut into pieces; repeated rows are
documents of their own; ties among equal lengths are broken by id, piece and CRC; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import single, spread, starts, text_blocks
from .common import ranked, staged

#: Words and pieces, and parts of a block's words, whose ids a Python worker remembers at most, and the longest that it remembers, in bytes.
MEMORY, PARTS, LONGEST = 200_000, 500_000, 48
#: Bytes of text in a block, whose distinct words are looked up once.
BLOCK = 16 << 20
#: A word of ASCII letters with ASCII marks behind it, but no apostrophe, which may start a contraction.
SIMPLE = re.compile(rb"([A-Za-z]*)([!-&(-/:-@\[-`{-~]*)")
#: The same marks, and the composed Latin letters before them (İ has a lower case of two characters).
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: The declared parts of a tokenizer whose texts may be tokenized word by word.
BY_WORD = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_WORKER: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of texts as little-endian bytes.

    Where the tokenizer's file declares the parts named in BY_WORD, it lower-cases and no pre-token spans ASCII white space. A word's ids then do not
    depend on its neighbours and are remembered. Letters and marks of simple words go
    to the tokenizer's model directly; all other words go through its normalizer and pre-tokenizer, and texts with an added token in them go
    through the tokenizer as a whole, as do all texts of any other tokenizer.
    """

    @classmethod
    def of_worker(cls, path: str) -> "WordIds":
        """One for each Python worker, so that the tasks it runs share what it remembers."""
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        declared = json.loads(self.tokenizer.to_str())
        self.by_word = {k: declared[k] for k in BY_WORD} == BY_WORD and declared["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in declared["added_tokens"])
        self.specials: list[bytes] = []
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        if not self.by_word:
            return
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.normalize, self.split, self.tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _remember(self, key: bytes, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[key] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        simple = SIMPLE.fullmatch(word)
        if simple:
            letters, marks = simple.groups()
            low = letters.lower()
            out = b""
            for part in (low, marks):
                if part:
                    ids = self.known.get(part) if part != word else None
                    out += ids if ids is not None else self._remember(part, self._piece(part.decode()))
            return out
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:  # composed Latin letters: one pre-token
            return self._piece("".join(map(ALPHABET.__getitem__, text.lower().encode())))
        return array("I", [t.id for piece, _ in self.split(self.normalize(text)) for t in self.tokenize(piece)]).tobytes()

    def _parts(self, parts: pa.Array) -> list[bytes]:
        """The ids of lower-case words and marks."""
        known, out = self.parts, []
        for w in parts.cast(pa.binary()).to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = self._piece(w.decode()) if w.isalpha() else self._word(w)  # isalpha() of bytes knows ASCII letters only
                if len(w) <= LONGEST:
                    if len(known) >= PARTS:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return out

    def of_word(self, word: bytes) -> bytes:
        """The ids of one word, if by_word."""
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes() if any(s in word for s in self.specials) else self._word(word)

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word or any(s in text for s in self.specials):
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        known, words = self.known, text.split()
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            out.append(ids if ids is not None else self._remember(w, self._word(w)))
        return b"".join(out)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's behind the other's, and how many each has. Each distinct word of them is taken apart once, and each distinct part looked up once."""
        import pyarrow.compute as pc

        whole = np.full(len(texts), not self.by_word)
        for special in self.specials:
            whole |= pc.match_substring(texts, special.decode()).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        found = words.flatten().dictionary_encode()
        distinct, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        # composed Latin letters with ASCII marks behind them are two pre-tokens; white space at an end leaves an empty word, which has none
        stems = pc.ascii_rtrim(distinct, MARKS)
        latin = pc.or_(pc.equal(stems, ""), pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, "[^\x01-\u024f]|\u0130"))))
        first = pc.if_else(latin, pc.utf8_lower(stems), distinct).dictionary_encode()
        marks = pc.if_else(latin, pc.utf8_ltrim(distinct, LATIN), "").dictionary_encode()
        ids = [*self._parts(first.dictionary), *self._parts(marks.dictionary)]
        long = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        both = np.stack([first.indices.to_numpy(zero_copy_only=False), marks.indices.to_numpy(zero_copy_only=False) + len(first.dictionary)], 1)
        tokens, lengths = np.frombuffer(b"".join(ids), "<u4")[spread(starts(long), both.ravel())], long[both].sum(1)
        offsets = words.offsets.to_numpy().astype(np.int64)
        out, counts = tokens[spread(starts(lengths), codes)], np.diff(starts(lengths[codes])[offsets - offsets[0]])
        if whole.any():
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(whole):
                parts[i] = np.frombuffer(self(texts[i].as_buffer().to_pybytes()), "<u4")
            out, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return out, counts


def tokenize_pieces(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length and ids_crc32 (and with_ids, ids) of the pieces of each text. Narrow, no shuffle."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = WordIds.of_worker(tokenizer)
        for _, block in text_blocks(batches, BLOCK):
            ids, counts = to_ids.of_texts(single(block["text"]))
            ends = starts(counts + 1)
            data = np.full(ends[-1], end_id, "<u4")
            data[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            pieces = counts // size + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - starts(pieces)[row]
            start = piece * size
            length = np.minimum(counts[row] + 1 - start, size)
            plain, begin = memoryview(data).cast("B"), 4 * (ends[row] + start)
            crc = [zlib.crc32(plain[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * length).tolist())]
            columns = [single(block["id"]).take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(starts(length), pa.int32()), pa.array(data.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Which lengths, how often, fill room best, taking at most counts of each: subset-sum over bitsets, larger lengths first."""
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:  # binary splitting of the multiplicity
            take = min(take, left)
            new = (reach | reach << length * take) & full
            steps.append((length, take, reach))
            reach, left, take = new, left - take, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) for each bin pattern, in the order of the bins."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        bin_ = fullest(left, size - largest)
        left[largest] += 1
        bin_[largest] = bin_.get(largest, 0) + 1
        repeats = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
        out.append((repeats, sorted(bin_.items(), reverse=True)))
    return out


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (a table or staged: id, piece, length, ids_crc32, ...).

    The counts by length (at most size rows) go to the driver, the patterns come back as a lookup table of the same order.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    used: dict[int, int] = {}
    lookup, first = [], 0
    for repeats, bin_ in patterns(counts, size):
        offsets = accumulate((k * n for k, n in bin_), initial=0)
        for (length, times), offset in zip(bin_, offsets):
            begin = used.get(length, 0)
            used[length] = begin + repeats * times
            lookup.append((length, begin, times, first, offset))
        first += repeats
    by_length: dict[int, list] = {}
    for length, *rest in lookup:
        by_length.setdefault(length, []).append(tuple(rest))
    table = spark.createDataFrame(list(by_length.items()), "l bigint, runs array<struct<begin:bigint,times:bigint,first:bigint,offset:bigint>>")
    rows = ranked(pieces, ["length"], [F.col(c) for c in ("id", "piece", "ids_crc32")], F.struct("id", "piece"), "nth", sum(counts.values()))
    # at most `size` rows: one for each length
    rows = rows.join(F.broadcast(table), F.col("length") == F.col("l"))
    run = F.filter("runs", lambda r: r.begin <= F.col("nth"))
    rows = rows.withColumn("run", F.element_at(run, -1)).drop("runs", "l")
    nth = F.col("nth") - F.col("run.begin")
    return rows.withColumn("sequence_id", F.col("run.first") + F.floor(nth / F.col("run.times")).cast("long")).withColumn("offset", F.col("run.offset") + F.pmod(nth, F.col("run.times")) * F.col("length")).drop("run", "nth")


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack; a row for each piece. The narrow table of pieces is staged, so texts are tokenized once."""
    return pack(staged(tokenize_pieces(df, tokenizer, size, 0, id_col, text_col), "pieces"), size)

"""Importance resampling, BPE by distinct words and tokenizer alignment against plain versions of them."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from sedimark.llm import align, blocks, bpe, importance, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: White space of many kinds at both sides of cuts, the mark of a space, special tokens, and characters beyond Latin.
ODD = ["", " ", "  ", "a  b", "a\n b", "\n x", "x \n y ", " lead", "tab\t z", "nb  x", "dür　 y", "▁ x", "x▁", "<|endoftext|> <s> y", "é 😀 中文 don't", "\x00 a \x85 b", None, "x" * 3000, "ends ", "\r\n q;\r x", "I'll we've", "ΑΣ ς İ ǅ", "é ́x <|startoftext|>a"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
plain = lambda rows: Counter(tuple(r) for r in rows)


@pytest.fixture(scope="session")
def odd(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")).withColumn("block", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("id", F.lit("clash"))


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# ---- op11


def resampled(docs, target, plan):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = [word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in docs]
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % plan.buckets for n in range(plan.low, plan.high + 1) for i in range(len(w) - n + 1)]
    codes = [grams(w) for w in words]
    s, t = Counter(c for x in codes for c in x), Counter(c for x in target for c in grams(word.findall((x or "").lower())))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (total_s + plan.buckets) / ((s[k] + 1) * (total_t + plan.buckets))))
    out = []
    for (i, _), w, c in zip(docs, words, codes):
        weight = sum(map(gain, c)) // len(c) if c else 0
        h = int(sha(f"{plan.seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(c), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= plan.least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(fit[: len(fit) * plan.percent // 100]):
        r[4] = k + 1
    return plain(r[:5] for r in out)


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 4)])
def test_resampling_with_lines_that_repeat_and_features_across_them(spark, odd, low, high):
    rng = random.Random(low + high)
    line = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))
    shared = [line() for _ in range(4)]
    more = [(1000 + i, "\n".join(rng.choice(shared) if rng.random() < 0.6 else line() for _ in range(rng.randint(1, 8)))) for i in range(60)]
    docs = odd.select("doc_id", "text", "row", "id").unionByName(spark.createDataFrame(more, "doc_id bigint, text string").withColumn("row", F.lit("x")).withColumn("id", F.lit("x")))
    target = ["a b c", "a\nb\nc a", None, "", "harbour evening"]
    plan = importance.Resample(low, high, buckets=50, least=3, percent=30)
    got = plain(importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), plan).collect())
    assert got == resampled(texts(docs), target, plan)


def test_resampling_of_and_towards_nothing(spark, docs, none):
    assert importance.resample(none, docs).count() == 0
    assert {r.weight for r in importance.resample(docs, none, importance.Resample(least=1)).collect() if not r.n_features} == {0}


def test_a_hot_line_is_joined_by_broadcast(spark):
    rows = [(i, "the same first line\n" + (f"own {i} words" if i % 3 else "")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plan = importance.Resample(least=1)
    assert plain(importance.resample(df, df, plan).collect()) == resampled(rows, [t for _, t in rows], plan)


# ---- op12


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_bpe_by_words_is_the_librarys(spark, odd, none, limit):
    own = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in texts(odd):
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, own.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_digests(odd, queries.tokenizer_path(), limit=limit).collect()
    assert plain(got) == plain((i, len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, ids, text in want)
    whole = bpe.encode(odd, queries.tokenizer_path(), limit=limit)
    assert plain((r.id, tuple(r.ids), r.decoded) for r in whole.collect()) == plain((i, tuple(ids), text) for i, ids, text in want)
    assert plain(bpe.decode_ids(whole, queries.tokenizer_path()).collect()) == plain((i, text) for i, _, text in want)
    assert bpe.encode_digests(none, queries.tokenizer_path()).count() == 0


def test_other_tokenizers_encode_whole_texts(spark, odd, tmp_path):
    own = Tokenizer.from_file(A)
    own.decoder = decoders.ByteLevel()
    own.save(str(tmp_path / "own.json"))
    assert not bpe.by_words(str(tmp_path / "own.json"))
    got = bpe.encode(odd, str(tmp_path / "own.json")).collect()
    assert plain((r.id, tuple(r.ids), r.decoded) for r in got) == plain((i, tuple(x := own.encode(t or "", add_special_tokens=False).ids), own.decode(x, skip_special_tokens=False)) for i, t in texts(odd))


def test_ids_of_no_piece_are_left_out(spark):
    df = spark.createDataFrame([(1, [320, 10**6, 320]), (2, []), (3, None), (1, [320])], "id int, ids array<int>")
    piece = bpe.vocabulary(queries.tokenizer_path())[320]
    assert plain(bpe.decode_ids(df, queries.tokenizer_path()).collect()) == plain([(1, f"{piece} {piece}"), (2, ""), (3, ""), (1, piece)])


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    """Of a thousand texts of the same words, the words' rows hold each word once a block."""
    rows = spark.range(1000).select(F.col("id"), F.lit("alpha beta alpha").alias("text")).coalesce(1)
    found = bpe._blocks(rows, "bigint", 64, 1 << 20).filter("bucket >= 0").collect()
    import zstandard

    assert sorted(w for r in found for w in zstandard.decompress(bytes(r.data)).split()) == [b"alpha", b"beta"]


# ---- op13


def aligned(rows):
    """Cuts where both sides' tokens end, links by overlap, over whole texts."""
    sides = align.Sides(A, B)
    per, docs = [], Counter()
    for i, t in rows:
        a, b = sides.a.encode(f" {t}", add_special_tokens=False).ids, sides.b.encode(t or "")
        bytes_a, bytes_b = ([of[x].as_py() for x in ids] for of, ids in ((sides.bytes_a, a), (sides.bytes_b, b)))
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == f" {t}".encode():
            per.append((i, None))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for x, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(str(x))
        links, starts = [], [0, *ends_b]
        for x, lo, hi in zip(a, [0, *ends_a], ends_a):
            for k in range(bisect.bisect_right(ends_b, lo), len(b)):
                if starts[k] >= hi:
                    break
                links.append((x, b[k]))
        docs.update(set(links))
        per.append((i, (len(a), len(b), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups))))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = plain((i, 0, 0, 0, 0, 0, 0, "") if p is None else (i, p[0], p[1], p[3].count(";") + 1, len(p[2]), sum(docs[x] == most[x[0]] for x in p[2]), sum(docs[x] for x in p[2]), sha(p[3])) for i, p in per)
    return out, {(x, y): (n, most[x]) for (x, y), n in docs.items()}, {(i, p[3] if p else "") for i, p in per}


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_alignment_by_segments_is_that_of_whole_texts(spark, odd, none, sf, limit, monkeypatch):
    df = odd.select("doc_id", "text", "block").unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(12).select("doc_id", "text", F.lit("x").alias("block")))
    want, counts, groups = aligned(texts(df))
    assert plain(align.align_documents(df, A, B, limit=limit).collect()) == want
    assert {(r.a, r.b): (r.docs, r.most) for r in align.pair_counts(df, A, B, limit=limit).collect()} == counts
    spelled = align.align_documents(df, A, B, limit=limit, spelled=True)
    assert {(r.id, r.groups) for r in spelled.collect()} == groups
    assert align.align_documents(none, A, B).count() == 0


def test_documents_are_counted_in_slices(monkeypatch):
    sides = align.Sides(A, B)
    rng = random.Random(2)
    rows = pa.array([" ".join(rng.choice(["antidis", "naïve", "x1", "zz", "don't"]) for _ in range(rng.randint(0, 30))) for _ in range(50)])
    codes, bounds, distinct = align.segments(rows, True)
    found = align.Aligned(sides, distinct)
    whole = found.documents(codes, bounds)
    for n in (1, 7, 100):
        monkeypatch.setattr(align, "AT_ONCE", n)
        assert (found.documents(codes, bounds) == whole).all()


def test_texts_are_not_cut_for_tokenizers_that_span_spaces():
    plain_a = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
    assert align.separable(plain_a, ["▁▁", "▁a", "a"]) and not align.separable(plain_a, ["a▁b"]) and not align.separable(plain_a | {"normalizer": {}}, [])
    codes, bounds, distinct = align.segments(pa.array(["a b", "", "a b"]), False)
    assert (codes.tolist(), bounds.tolist(), distinct.to_pylist()) == ([0, 0], [0, 1, 1, 2], ["a b"])


def test_numbers_come_back_from_planes_of_bytes():
    numbers = np.array([0, 1, 255, 256, 70000, 2**32 - 1], np.int64)
    assert blocks.unsqueeze(blocks.squeeze(numbers)).tolist() == numbers.tolist() and blocks.unsqueeze(blocks.squeeze(numbers[:0])).size == 0

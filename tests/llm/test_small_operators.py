"""Sharding, packing, archives, URL rules, media, secrets, mixing and fingerprints against brute force."""

import fnmatch
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from sedimark.llm import fingerprint, mixing, mpegts, packing, queries, secret_scan, sharding, url_filter, warc

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- sharding -------------------------------------------------------------------------------------------------------------------


def test_shards_keep_groups_and_slots(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(rows())
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 8 for _, t, *_ in rows())
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows())
    by_text = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none, 4).collect() == []


def test_schedule_is_longest_processing_time():
    rng = random.Random(7)
    for most in (1, 3, 50, 2000):
        sizes = [rng.randrange(0, 50) for _ in range(40)]
        histogram = sorted({x: rng.randrange(1, most + 1) for x in sizes}.items(), reverse=True)
        loads, want = [0] * 5, []
        for x, n in histogram:
            took = Counter()
            for _ in range(n):
                s = min(range(5), key=lambda i: (loads[i], i))
                loads[s] += x
                took[s] += 1
            want.append((x, sorted(took.items())))
        assert list(sharding.schedule(histogram, 5)) == want


def test_shards_near_equal_bytes(spark, sf):
    got = queries.op3_shard_groups(spark, sf).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 24 and max(loads) <= 1.1 * sum(loads) / 24


# --- packing --------------------------------------------------------------------------------------------------------------------


def test_fullest_against_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 50)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        got = packing.fullest(dict(Counter(lengths)), room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= Counter(lengths)[k] for k, n in got.items())


def test_patterns_use_every_piece_once():
    counts = {k: random.Random(k).randrange(0, 30) for k in range(1, 65)}
    used = Counter()
    for repeats, bin_ in packing.patterns(counts, 64):
        assert sum(k * n for k, n in bin_) <= 64
        for k, n in bin_:
            used[k] += n * repeats
    assert used == Counter({k: n for k, n in counts.items() if n})


def test_packed_pieces(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path(), 64).collect()
    want = []
    for i, t, *_ in rows():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(p := ids[at : at + 64]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, at in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(none, queries.tokenizer_path(), 64).collect() == []


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = packing.WordIds(queries.tokenizer_path())
    for t in ("it's O'Neill's 12ab", "É é  x y\x1cz", "İSTANBUL ΣΑΣ ΣΑΣ.", "<|endoftext|> a<|startoftext|>b", "𝒳漢字 ﬁ ½", "a\r\n\x0b\x0cb", "%%%***", "x" * 300):
        assert list(memoryview(ids(t.encode())).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids, t


# --- archives -------------------------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, id string"


def test_archives_round_trip(spark):
    big, other = "<p>" + "same " * 300, "y" * 1000
    pages = [(1, "http://a/ü", big), (2, None, big), (3, "x", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "v", other), (None, "n", other), (None, "n", "z" * 2000), (None, "n", "z" * 2000), (9, "long", "é" * 300_000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], PAGES).repartition(3)
    got = warc.read_archives(warc.write_archives(df)).collect()
    best = defaultdict(lambda: None)
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best[h] or i, i)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        refers = best[h] if len(data) >= 1000 and best[h] is not None and best[h] != i and sum(p[2] == h for p in pages) > 1 else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


def test_archive_faults_are_found():
    dictionary = zstandard.train_dictionary(2048, [f"<html><p>{i} lorem ipsum {i * 7}</p></html>".encode() * 3 for i in range(300)])
    writer = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    raw = warc.record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    opening = struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary.as_bytes())) + dictionary.as_bytes()
    good = opening + writer.compress(raw) + writer.compress(raw)
    assert list(warc.read_archive(good)) == [raw, raw]
    squeezed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    assert list(warc.read_archive(struct.pack("<II", warc.DICTIONARY_FRAME, len(squeezed)) + squeezed + writer.compress(raw))) == [raw]
    for bad in (good[:-3], opening[:50], opening + b"junk" + writer.compress(raw)):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    for bad in (raw[:-1], raw.replace(b"WARC/1.1", b"WURC/1.1"), raw.replace(b"WARC-Date", b"WARC-Dote"), raw.replace(b"payload\r\n", b"payloud\r\n")):
        with pytest.raises(ValueError):
            warc.describe(bad)


def test_archives_of_other_writers(spark):
    """Frames without a content size, streamed frames, skippable frames between records, no dictionary, folded header lines."""
    raws = [warc.record(i, f"http://a/{i}", (b"text %d " % i) * (1 + 40_000 * (i == 2)), "-", None) for i in range(4)]
    raws[1] = raws[1].replace(b"\r\nWARC-Date", b"\r\n folded\r\n\tonce more\r\nWARC-Date", 1)
    plain = zstandard.ZstdCompressor(write_content_size=False)
    stream = lambda raw: (c := zstandard.ZstdCompressor(write_checksum=True).compressobj()).compress(raw[:9]) + c.compress(raw[9:]) + c.flush()
    skip = struct.pack("<II", warc.SKIPPABLE + 3, 5) + b"hello"
    foreign = skip + plain.compress(raws[0]) + skip + stream(raws[1]) + stream(raws[2]) + skip + plain.compress(raws[3]) + skip
    assert list(warc.read_archive(foreign)) == raws
    fields, _ = warc.parse_record(raws[1])
    assert fields["warc-target-uri"] == "http://a/1 folded once more"
    got = warc.read_records(spark.createDataFrame([(bytearray(foreign),), (bytearray(),)], "content binary")).collect()
    assert [r.uri for r in got][0] == "http://a/0" and [bytes(r.block) for r in got] == [warc.parse_record(x)[1] for x in raws]
    for bad in (foreign[:-2], foreign[:40] + b"\xff" + foreign[41:], skip[:6], stream(raws[1])[:-1] + b"?"):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    with pytest.raises(ValueError):
        list(warc.read_archive(plain.compress(b"0" * 5000), 4000))
    with pytest.raises(ValueError):
        list(warc.read_archive(zstandard.ZstdCompressor().compress(b"0" * 5000), 4000))


# --- URL rules ------------------------------------------------------------------------------------------------------------------


def test_automaton_against_fnmatch():
    rng = random.Random(3)
    globs = ["*", "a*", "*a", "*a*b*", "", "ab", "*ab*ab", "b*a*" * 9] + ["".join(rng.choice("ab*") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    hit = url_filter.ShiftAnd(globs).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert hit[i].tolist() == [fnmatch.fnmatchcase(t, g) for g in globs]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    found = []
    for r in url_filter.LISTED:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            found.append(r)
    best = max(found, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.action if best else None


def test_url_rules(spark, sf):
    urls = ["http://EXAMPLE.com/en/71?x#y", "https://a.example.com/en/81", "http://example.com", "http://x.net/de/8", "http://a.example.net/de/8", "http://notcom/en/", "http://com/en/", "ftp://b.org/es/#q", "no scheme", "", None, "://", "http://foo.org/x.com/en/1", "http://É.com/en/é", "http://h\0.com/en/\0", "http://s.io/ads/1", "http://" + "a" * 3000 + ".com/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.id: r for r in url_filter.judge_urls(df, url_filter.LISTED + url_filter.GENERAL).collect()}
    for i, u in enumerate(urls):
        host, path, rule, action = plain_verdict(u)
        listed = got[i].rule if got[i].rule in {r.name for r in url_filter.LISTED} else None
        assert (got[i].host, got[i].path, listed) == (host, path, rule), u
        if action:
            assert got[i].verdict == action
    globs = {"http://x.org/a/b.zip": "block", "http://x.org/a/b.zip/c": "allow", "http://ads.x.org": "block", "http://bads.x.org/": "allow", "http://bit.ly/x": "block", "http://abit.ly/x": "allow", "http://casino7.net/": "block", "http://x.io/wp-login.php": "block", "http://x.io/a/wp-login": "allow", "http://x.io/.env": "block"}
    judged = spark.createDataFrame(list(enumerate(globs)), "page_id int, url string")
    for r in url_filter.judge_urls(judged, url_filter.GENERAL).collect():
        assert r.verdict == list(globs.values())[r.id], list(globs)[r.id]
    assert got[15].verdict == "block" and got[8].verdict == "block" and got[2].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0), url_filter.LISTED).collect() == []
    for r in queries.op6_url_filter(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        host, path, rule, action = plain_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (action or r.verdict)


# --- media ----------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, none):
    got = mpegts.read_media(mpegts.write_media(docs)).collect()
    want = []
    for i, t, *_ in rows():
        data = (t or "").encode()
        full = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert all(r.media_bytes % 188 == 0 and "cc_errors=0" in r.feature for r in got)
    assert mpegts.read_media(mpegts.write_media(none)).collect() == []


def test_runs_hold_all_times():
    rng = random.Random(2)
    for _ in range(200):
        times = [rng.choice([0, 3003, 6006, 9009, 9010, 5]) for _ in range(rng.randrange(0, 9))]
        out = []
        for part in filter(None, mpegts.runs(times).split(",")):
            m = re.fullmatch(r"(\d+)(?:([+-]\d+)\*(\d+))?", part)
            out += [int(m[1]) + k * int(m[2] or 0) for k in range(int(m[3] or 0) + 1)]
        assert out == times


def test_stream_faults():
    stream = mpegts.mux(mpegts.padded(bytes(range(256)) * 50))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    found = mpegts.demux(stream)
    assert found.errors == 0 and found.stream_type == mpegts.STREAM_TYPE and found.times[1] - found.times[0] == mpegts.TICKS
    with pytest.raises(ValueError):
        mpegts.demux(b"".join(packets[:5] + packets[6:]))  # a hole makes a PES packet short
    with pytest.raises(ValueError):
        mpegts.demux(b"\x00" + stream[1:])
    with pytest.raises(ValueError):
        mpegts.demux(stream[:10] + bytes([stream[10] ^ 1]) + stream[11:])  # a table's CRC
    again = b"".join(packets[:4] + packets[3:])
    assert (mpegts.demux(again).errors, mpegts.demux(again).repeats, mpegts.demux(again).payload) == (0, 1, found.payload)
    whole = mpegts.mux(mpegts.padded(bytes(range(256)) * 200))
    big = [whole[i : i + 188] for i in range(0, len(whole), 188)]
    own = [i for i, p in enumerate(big) if (p[1] & 0x1F, p[2]) == (1, 0)]
    key = next(i for i in own[1:] if big[i][3] & 0x20 and big[i][4] and big[i][5] & 0x40)
    moved = [p[:3] + bytes([p[3] & 0xF0 | p[3] + 9 & 15]) + p[4:] if i in own and i >= key else p for i, p in enumerate(big)]
    assert (mpegts.demux(b"".join(moved)).errors, mpegts.demux(b"".join(moved)).jumps) == (1, 0)
    moved[key] = moved[key][:5] + bytes([moved[key][5] | 0x80]) + moved[key][6:]  # the packet says so
    assert (mpegts.demux(b"".join(moved)).errors, mpegts.demux(b"".join(moved)).jumps) == (0, 1)
    pat_again = packets[0][:3] + bytes([packets[0][3] & 0xF0 | 5]) + packets[0][4:]
    assert mpegts.demux(pat_again + stream).errors == 1


# --- secrets --------------------------------------------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def test_base_spans(spark, docs, none):
    extra = ["Api_Key:'abcdef' SECRET==x=yyyyyyy password=token:abcdef", "AKIA" * 9 + " AKIAx", "ſecret=abcdefgh tokKen=abcdefgh", "f" * 23 + "g" + "f" * 24, "secret = short secret = longenough"]
    more = spark.createDataFrame([(100 + i, t, "en", "q") for i, t in enumerate(extra)], "doc_id bigint, text string, lang string, source string")
    every = docs.select("doc_id", "text", "lang", "source").union(more)
    got = secret_scan.scan(every).select("id", secret_scan.spell(secret_scan.F.col("base")).alias("s")).collect()
    want = [(i, base_spans(t)) for i, t, *_ in rows()] + [(100 + i, base_spans(t)) for i, t in enumerate(extra)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert secret_scan.scan(none).collect() == []


def test_wide_spans_outside_base_spans(spark):
    rng = random.Random(5)
    span = lambda kind: (a := rng.randint(0, 400), a + rng.randint(1, 9), kind, "v")
    rows_ = [(i, [span(rng.randint(0, 2)) for _ in range(rng.choice([0, 1, 30, 90]))], [span(3) for _ in range(rng.choice([0, 1, 70, 150]))]) for i in range(40)]
    df = spark.createDataFrame(rows_, f"i int, b array<{secret_scan.SPAN}>, w array<{secret_scan.SPAN}>")
    for r in df.select("b", "w", secret_scan._outside(F.col("w"), F.col("b")).alias("got")).collect():
        assert sorted(r.got) == sorted(w for w in r.w if not any(b.start < w.end and w.start < b.end for b in r.b))


def test_many_spans_cost_in_proportion_and_are_masked(spark):
    rng = random.Random(6)

    def rows_of(n):
        parts = ["".join(rng.choices("abcdefgh0123456789XYZ", k=rng.randint(34, 40))) + rng.choice([" 𝒳é ", " ", "\n"]) + f"token={rng.randint(10**6, 10**7)} " for _ in range(n)]
        return "".join(parts)

    def took(n):
        df = spark.createDataFrame([(1, rows_of(n), "en", "a")], "doc_id bigint, text string, lang string, source string")
        t = time.time()
        row = secret_scan.scan(df).first()
        return time.time() - t, row, df

    took(100)
    (small, *_), (large, row, df) = took(4000), took(16000)
    text = df.first().text
    assert large < 6 * max(small, 1.0)
    assert sum(s.kind == 0 for s in row.base) == 16000
    out, at = "", 0
    for a, b in sorted((s.start, s.end) for s in row.live):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    assert secret_scan.redact(df).first().text == out + text[at:]


def test_ownership_decides(spark):
    own, copied = "zq8Rk2Lm9Xw4Tn7Bv1Cy6Hd3", "Pq5Ws8Ed2Rf7Tg4Yh1Uj9Ik3"
    data = [(i, f"key token={copied}", "en", f"s{i % 5}") for i in range(10)] + [(50, f"mine token={own} é token={own}!", "en", "s1"), (51, f"bare {own}{own} tail", "en", "s2")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    got = {r.id: r for r in secret_scan.scan(df).collect()}
    assert all(got[i].n_copied == 1 and got[i].n_live == 0 for i in range(10))
    assert got[50].n_live == 1 and [s.kind for s in got[51].live] == [3]
    masked = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert masked[50] == "mine [secret] é [secret]!" and masked[51] == "bare [secret] tail" and masked[3] == data[3][1]


# --- mixing ---------------------------------------------------------------------------------------------------------------------


def plain_targets(words, weights, share, most):
    budget = share * sum(words)
    out, open_ = [0.0] * len(words), set(range(len(words)))
    w = [weights[i % len(weights)] for i in range(len(words))]
    while open_:
        left = budget - sum(out[i] for i in range(len(words)) if i not in open_)
        level = left / sum(w[i] for i in open_)
        over = {i for i in open_ if level * w[i] > most * words[i]}
        if not over:
            for i in open_:
                out[i] = level * w[i]
            return out
        for i in over:
            out[i] = most * words[i]
        open_ -= over
    return out


def check_mix(got, mix):
    sources = defaultdict(list)
    for r in got:
        sources[r.source].append(r)
    names = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    words = [sum(r.size for r in sources[s]) for s in names]
    for s, n, t in zip(names, words, plain_targets(words, mix.weights, mix.share, mix.most)):
        assert all(r.source_size == n and abs(r.target - t) < 1e-6 * max(1, t) for r in sources[s])
        assert abs(sum(r.taken for r in sources[s]) - t) <= 0.5 + 1e-6
        assert all(r.taken <= mix.most * r.size for r in sources[s])
        assert all(sum(d.words for d in r.draws) == r.taken for r in sources[s])


def test_mix_targets(docs, none):
    mix = mixing.Mix(shards=4)
    got = mixing.mix_plan(docs, mix).collect()
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows())
    check_mix(got, mix)
    key = lambda r: (r.key, r.taken)
    assert sorted(mixing.mix_plan(docs.repartition(5), mix).collect(), key=key) == sorted(got, key=key)
    assert mixing.mix_plan(none, mix).collect() == []


def test_mix_rows(docs, sf, spark):
    mix = mixing.Mix(shards=8)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix_plan(table, mix).collect()
    check_mix(plan, mix)
    out = mixing.mix_rows(table, mix, shard_col="out").collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in plan)
    at = defaultdict(list)
    for r in out:
        at[r.out].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in at.values())
    assert mixing.mix_rows(docs, mix, shard_col=None).columns == docs.columns
    assert mixing.mix_rows(docs, mix, shard_col=None).count() > 0


def test_tree_splits_exactly(spark):
    quotas = {0: 5, 1: 0, 2: 301, 3: 44}
    df = spark.createDataFrame(list(quotas.items()), "i bigint, q bigint")
    for shards in (1, 2, 7, 16):
        got = mixing.split_quotas(df, shards, 3).collect()
        by_source, by_shard = Counter(), Counter()
        for r in got:
            by_source[r.i] += r.n
            by_shard[r.shard] += r.n
            assert r.n >= 0
        assert {i: by_source[i] for i in quotas} == quotas
        assert max(by_shard.values()) - min(by_shard[s] for s in range(shards)) <= 2 * max(1, shards.bit_length())


def test_hypergeometric_law(spark):
    """Draws at an even grid of u must have the distribution's mean and spread."""
    df = spark.range(2000).selectExpr("(id + 0.5) / 2000d as u").selectExpr(mixing._hypergeometric("named_struct('g', 30L, 'total', 100L, 'n', 40L, 'u', u)") + " as x")
    xs = [r.x for r in df.collect()]
    mean = sum(xs) / len(xs)
    var = sum((x - mean) ** 2 for x in xs) / len(xs)
    assert abs(mean - 12) < 0.02 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.1


# --- fingerprints ---------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edits(got, data):
    got = {(r.id, r.n_chars, r.edited_sha256): r for r in got}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        assert abs(r.near_edited - jaccard(shingles(t), shingles(edited))) < 0.2
        assert abs(r.near_next - jaccard(shingles(t), shingles(after))) < 0.2


def test_fingerprints_of_edits(docs, none, spark, sf):
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == len(rows())
    check_edits(got, [(i, t or "") for i, t, *_ in rows()])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    check_edits(fingerprint.fingerprint_edits(table).collect(), [(r.doc_id, r.text) for r in table.collect()])
    assert fingerprint.fingerprint_edits(none).collect() == []
    one = spark.createDataFrame([(1, "alone in the world of texts today")], "doc_id bigint, text string")
    assert fingerprint.fingerprint_edits(one).first().near_next == 1.0


def test_each_distinct_word_of_a_block_is_taken_apart_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(queries.tokenizer_path()), packing.WordIds(queries.tokenizer_path())
    long = "9" + "x" * 60
    texts = ["", " \x0b\t", "The the THE, the.) 'tis don't", "Ä̈rger Straße, İstanbul ŉ ʼn Ĳ. É.", "H̱ ẖ ≮ a≮ ciónarco.!?", "中文 abc中 a1b 3.14  x y ==", "a <|endoftext|> B, b", f"{long} " * 50, "ﬁn ªº ǅ. Ωmega ς Σ"]
    for marks in (packing.MARKS, "&&&", "--", "'"):
        texts.append(" ".join(f"{w}{marks}" for w in ("word", "Über", "", "x2", "naïve")))
    seen = []
    keep = ids._word
    monkeypatch.setattr(ids, "_word", lambda w: seen.append(w) or keep(w))
    got, counts = ids.of_texts(pa.array(texts))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]
    assert seen.count(long.encode()) == 1

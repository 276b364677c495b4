"""Corpus operators that do the whole job, on small inputs, against plain versions of them."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimark.llm import fingerprint, mixing, near_dedup, packing, queries, secret_scan, sharding, toxicity
from sedimark.llm.common import staged

from .test_models_and_pipeline import brute_components
from .test_small_operators import BASE, WORD, plain_targets, shingles


def best_f1(rows, prior):
    """The best F1 of (bin, toxic) rows with prior (bin, rows, positives) added, at any bin."""
    n, hits = defaultdict(float), defaultdict(float)
    for b, toxic in rows:
        n[b] += 1
        hits[b] += toxic
    for b, x, y in prior:
        n[b] += x
        hits[b] += y
    total = sum(hits.values())
    f1 = lambda t: 2 * sum(v for b, v in hits.items() if b >= t) / (sum(v for b, v in n.items() if b >= t) + total)
    return max(f1(t) for t in range(toxicity.BINS)), f1


def test_thresholds_rest_on_all_labelled_rows(spark):
    rng = random.Random(3)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(i, "xx" if i % 10 == 0 else "yy" if i % 501 == 3 else None if i % 77 == 1 else "en", int(rng.random() < 0.4)) for i in range(1500)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(plain, k=8) + (["vile"] if toxic and rng.random() < 0.8 else [])), lang) for i, lang, toxic in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, toxicity.Settings(sample=200, epochs=1, least_steps=100, buckets=1 << 12, block=64))
    assert len(model.fitted) == 200
    scored = staged(toxicity.score(docs, model, lang_col="lang"), "scored")
    limits = {r.language: r.threshold for r in toxicity.thresholds(scored, labels, model).collect()}
    assert set(limits) == {None, "en", "xx", "yy"}
    scores = {r.id: r.score for r in scored.collect()}
    known = [(lang, min(int(scores[i] * toxicity.BINS), toxicity.BINS - 1), toxic) for i, lang, toxic in rows if zlib.crc32(str(i).encode()) % 5 and str(i) not in model.fitted]
    every = [(b, t) for _, b, t in known] + [(750, 1), (250, 0)] * toxicity.PRIOR
    share = toxicity.PRIOR / sum(t for _, t in every)
    prior = [(b, share, share * t) for b, t in every]
    for lang, limit in limits.items():
        best, f1 = best_f1([(b, t) for x, b, t in known if x == lang and lang is not None], prior)
        assert abs(f1(-(-limit * toxicity.BINS // 1)) - best) < 1e-9, lang
    flagged = {r.id: r.flagged for r in toxicity.flagged(scored, toxicity.thresholds(scored, labels, model), "flagged").collect()}
    assert all(flagged[i] == (scores[i] >= limits.get(lang, limits[None])) for i, lang, _ in rows)


def plain_lpt(sizes, shards):
    loads = [0] * shards
    for x in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda i: (loads[i], i))
        loads[s] += x
    return loads


@pytest.mark.parametrize("giant", [0, 900_000])
def test_shards_of_many_groups_are_those_of_longest_processing_time(spark, giant):
    rng = random.Random(1)
    sizes = [rng.choice([8, 9, 10, rng.randrange(8, 300), int(rng.paretovariate(1.1) * 8)]) for _ in range(10_000)] + [giant] * bool(giant)
    rows = [(f"g{k}", part) for k, x in enumerate(sizes) for part in ([x - 3, 3] if k % 7 == 0 else [x])]
    df = staged(spark.createDataFrame(rows, "name string, size bigint"), "rows")
    got = sharding.shard_rows(df, 7, ["name"], "size").collect()
    loads, where = Counter(), defaultdict(set)
    for r in got:
        loads[r.shard] += r["size"]
        where[r.name].add(r.shard)
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    assert sorted(loads.values()) == sorted(plain_lpt(sizes, 7))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_fingerprint(hashes):
    """Binning, densification and packing one step after the other."""
    bins = {}
    for h in hashes:
        b = (h >> 56) + 128
        bins[b] = min(bins.get(b, h), h)
    out = []
    for i in range(fingerprint.BINS):
        a = 0
        while (b := (fingerprint.OFFSET[i] + a * fingerprint.STEP[i]) % fingerprint.BINS if i not in bins else i) not in bins:
            a += 1
        out.append(bins[b] & 255)
    return bytes(out).hex()


def test_fingerprint_bytes(spark):
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (1, 4, 5, 6, 20, 100, 400, 3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", fingerprint.shingle_hashes(F.col("t")).alias("h"), fingerprint.spell(fingerprint.fingerprint(F.col("t"))).alias("f")).collect():
        assert r.f == plain_fingerprint(r.h)


def test_ownership_against_counting(spark):
    rng = random.Random(9)
    value = lambda: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", k=rng.choice([12, 24, 40])))
    shared = [value() for _ in range(30)]
    data = []
    for i in range(300):
        found = [rng.choice(shared) if rng.random() < 0.6 else value() for _ in range(rng.randrange(0, 4))]
        data.append((i, " and ".join(f"token={v}" for v in found), f"l{rng.randrange(3)}" if i % 9 else None, rng.choice(["a", "b", "c", None])))
    rule = secret_scan.Ownership(owners=3, repositories=5)
    got = secret_scan.scan(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string"), rule).collect()
    owners, repositories, values = defaultdict(set), defaultdict(set), {}
    for i, t, lang, source in data:
        values[i] = {m.group(2) for m in BASE[0][1].finditer(t) if len(m.group(2)) >= 6}
        for v in values[i]:
            owners[v].add(source)
            repositories[v].add((source, lang))
    copied = {v for v in owners if len(owners[v]) >= 3 or len(repositories[v]) >= 5}
    random_ = lambda v: len(set(v)) >= 10 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    assert copied and any(v not in copied for v in owners)
    for r in got:
        assert r.n_copied == len(values[r.id] & copied)
        assert r.n_live == sum(1 for v in values[r.id] - copied if random_(v))


def test_positions_are_a_shuffle_of_each_shard(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.Mix(shards=8)
    plan = {(r.id, d.epoch): (d.shard, d.words) for r in mixing.mix_plan(table, mix).collect() for d in r.draws}
    got = mixing.place_draws(mixing.mix_plan(table, mix), mix).collect()
    placed = {(r.id, d.epoch): d for r in got for d in r.draws}
    assert {k: (d.shard, d.words) for k, d in placed.items()} == plan
    by_shard = defaultdict(list)
    for k, d in placed.items():
        by_shard[d.shard].append((d.position, k[0]))
    for rows in by_shard.values():
        assert sorted(p for p, _ in rows) == list(range(len(rows)))
        ids = [i for _, i in sorted(rows)]
        assert len(ids) < 8 or ids not in (sorted(ids), sorted(ids, reverse=True))


def test_another_tokenizer_encodes_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.WordIds(path)
    assert not ids.by_word and packing.WordIds(queries.tokenizer_path()).by_word
    for t in ("It's  two  spaces\n\nand É", "", " lead"):
        assert list(memoryview(ids(t.encode())).cast("I")) == whole.encode(t, add_special_tokens=False).ids


def stage_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    return docs, {r.doc_id: r for r in docs.collect()}


def test_stage_toxicity_drops_what_reaches_its_threshold(spark, sf):
    docs, rows = stage_inputs(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    model = toxicity.fit(docs, labels)
    scored = staged(toxicity.score(docs, model, lang_col="lang"), "scored")
    limits = {r.language: r.threshold for r in toxicity.thresholds(scored, labels, model).collect()}
    assert kept == {r.id for r in scored.collect() if r.score < limits.get(r.lang, limits[None])} and len(kept) < len(rows)


def test_stage_near_dedup_keeps_the_first_of_each_group(spark, sf):
    docs, rows = stage_inputs(spark, sf)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, sf).collect()}
    assert kept == {i for i, n, first in brute_components(list(rows), [r.text for r in rows.values()], 5) if i == first or not n}


def test_stage_secret_scan_masks_live_values_only(spark, sf):
    docs, _ = stage_inputs(spark, sf)
    more = [(10**6 + i, f"a token={v} b {v * 2} c password: {v}", "en", f"own{i}", 0) for i, v in enumerate(["zq8Rk2Lm9Xw4Tn7Bv1Cy6Hd3", "Pq5Ws8Ed2Rf7Tg4Yh1Uj9Ik3"])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()
    rows = {r.doc_id: r for r in docs.collect()}
    spans = {r.id: [(s.start, s.end) for s in r.live] for r in secret_scan.scan(docs, corpus=spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    got = corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()
    assert len(got) == len(rows) and any(spans.values())
    for r in got:
        text, out, at = rows[r.doc_id].text, "", 0
        for a, b in sorted(spans[r.doc_id]):
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)


def test_a_value_copied_across_owners_is_not_masked_when_its_copies_are_folded(spark, tmp_path):
    text = "the same example of five owners with password=Pq5Ws8Ed2Rf7Tg4Yh1Uj9Ik3 in it and some words more"
    data = [(i, text, "en", f"own{i}", len(text)) for i in range(5)] + [(9, text.replace("Pq5W", "Xq5W") + " of one", "en", "own9", 0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    got = {r.doc_id: r.text for r in corpus_pipeline.STAGES[2][1](spark, left, str(tmp_path)).collect()}
    assert got[0] == text and len(got) == 2 and "[secret]" in got[9]
    scan = {r.id: (r.n_live, r.n_copied) for r in secret_scan.scan(left, corpus=docs).collect()}
    whole = {r.id: (r.n_live, r.n_copied) for r in secret_scan.scan(docs).collect()}
    assert scan == {i: whole[i] for i in scan}


def test_stage_mix_takes_whole_rows_near_the_targets(spark, sf):
    docs, rows = stage_inputs(spark, sf)
    got = corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()
    times = Counter(r.doc_id for r in got)
    assert all(r.text == rows[r.doc_id].text for r in got) and max(times.values()) <= 2
    words = {i: len(WORD.findall(r.text)) for i, r in rows.items()}
    sources = sorted({r.source for r in rows.values()})
    targets = plain_targets([sum(words[i] for i, r in rows.items() if r.source == s) for s in sources], (3, 1, 2), 1.5, 2)
    for s, target in zip(sources, targets):
        mine = [i for i, r in rows.items() if r.source == s]
        assert abs(sum(times[i] * words[i] for i in mine) - target) <= max(words[i] for i in mine) / 2 + 1


def test_mix_draws_texts_without_words(spark):
    df = spark.createDataFrame([(i, " " if i % 5 == 0 else "some words here", "s") for i in range(400)], "doc_id bigint, text string, source string")
    got = [r for r in mixing.mix_rows(df, mixing.Mix(shards=2, cut=False), shard_col=None).collect()]
    blank = sum(not r.text.strip() for r in got)
    assert 60 <= blank <= 160 and abs(sum(len(r.text.split()) for r in got) - 1.5 * 960) <= 3


def test_stage_pack_cuts_nothing_short(spark, sf):
    from tokenizers import Tokenizer

    docs, rows = stage_inputs(spark, sf)
    whole = Tokenizer.from_file(queries.tokenizer_path())
    lengths = defaultdict(int)
    for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}


def test_near_duplicates_of_hot_copies(spark):
    """A third of all rows are copies, with near copies around them and texts that share a passage only."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    data = [" ".join(base)] * 150 + [" ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in base) for _ in range(60)]
    data += [" ".join(base[:40] + [f"u{rng.random()}" for _ in range(40)]) for _ in range(120)] + [""] * 5
    df = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    got = {(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, near_dedup.NearDup(small=10)).collect()}
    assert got == set(brute_components(list(range(len(data))), data, 5))


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """queries() and oracle_sql() in a copy of the repository without this subpackage."""
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run(f"git ls-files | grep -v llm/ | cpio -pdm --quiet {tmp_path} 2>/dev/null || (tar cf - --exclude=.git --exclude=llm . | tar xf - -C {tmp_path})", shell=True, check=True, cwd=top)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})

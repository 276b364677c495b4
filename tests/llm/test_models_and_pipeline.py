"""Near-duplicates against brute force, toxicity on held-out rows, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sedimark.llm import near_dedup, queries, toxicity

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(texts, k):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(ids, texts, k, percent=80):
    sets, index, shared = sets_of(texts, k), defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for v in index.values():
        for a in range(len(v)):
            for b in range(a):
                shared[v[b], v[a]] += 1
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = x if least.get(r) is None else least[r] if x is None else min(least[r], x)
    return [(x, len(sets[i]), least[find(i)] if sets[i] else x) for i, x in enumerate(ids)]


def check_components(df, k, rule):
    data = df.select("doc_id", "text").collect()
    want = brute_components([r[0] for r in data], [r[1] for r in data], k)
    got = [(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, rule).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_awkward_rows(docs, none):
    for k in (4, 5):
        check_components(docs, k, near_dedup.NearDup(words=k))
    assert near_dedup.near_duplicates(none).collect() == []
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("") == 1 and texts.count(None) == 2 and " \t\n " in texts
    assert sum("password" in (t or "") for t in texts) == 1 and sum("fox" in (t or "") for t in texts) == 1


def test_documents(spark, sf):
    check_components(spark.read.parquet(f"{sf}/documents.parquet"), 4, near_dedup.NearDup(words=4))


def test_large_groups_chains_and_shared_passages(spark):
    """Buckets over `small`: a group of near copies around one text, a chain of drifting copies, and texts that share a long passage only."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    data = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        data.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for step in range(30):
        data.append(" ".join(chain))
        chain = chain[3:] + [word() for _ in range(3)]
    passage = [word() for _ in range(80)]
    data += [" ".join(passage + [word() for _ in range(rng.randrange(30, 60))]) for _ in range(80)]
    df = spark.createDataFrame([(i * 3 % 1009, t) for i, t in enumerate(data)], "doc_id bigint, text string")
    for small in (24, 3):
        check_components(df, 4, near_dedup.NearDup(words=4, small=small))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (600, 200, 200))
    sig = near_dedup.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    wins = [(p > n) + 0.5 * (p == n) for p, y in held if y for n, z in held if not z]
    assert np.mean(wins) > 0.6


def test_toxicity_learns_words_not_ids(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["blargh", "snorf"])
        data.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.id % 4 == 0) for r in held]) > 0.97
    kept = {r.doc_id for r in toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), model).collect()}
    assert sum(i % 4 != 0 for i in kept) > 440 and sum(i % 4 == 0 for i in kept) < 10


def test_toxicity_of_awkward_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(toxicity.score(docs, model).collect()) == len(rows())
    kept = toxicity.keep_clean(docs, labels, model)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    learned = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 11)], "doc_id bigint, toxic int"), toxicity.Settings(least=1, least_steps=3))
    assert learned.out is not None and len(learned.fitted) > 3
    assert toxicity.keep_clean(docs, labels, learned).columns == docs.columns
    assert toxicity.keep_clean(none, labels, learned).collect() == []
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []


def small_model(**changes):
    s = toxicity.Settings(block=64, epochs=2, least_steps=20, buckets=1 << 10, least=1, **changes)
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 1000, rng.integers(0, 200)).astype(np.int32) for _ in range(40)]
    return texts, toxicity.train(texts, np.arange(40) % 2.0, s)


def plain_score(model, text):
    """Each filter at each window of the text and its padding, one by one."""
    s = model.settings
    x = [int(model.slots[i]) for i in text] + [0] * max(s.widths)
    h, column = [], 0
    for j, w in enumerate(s.widths):
        for f in range(s.filters):
            best = max(sum(float(model.table[x[at + o], column + o * s.filters + f]) for o in range(w)) for at in range(len(x) - w + 1))
            h.append(max(0.0, best + float(model.bias[j * s.filters + f])))
        column += w * s.filters
    return 1 / (1 + np.exp(-(np.dot(h, model.out) + model.out_bias)))


def test_scores_against_a_plain_convolution():
    texts, model = small_model()
    texts += [np.empty(0, np.int32), np.arange(64, dtype=np.int32), np.arange(1, 66, dtype=np.int32), np.arange(1, 129, dtype=np.int32)]
    got = model.scores([model.slots[t] for t in texts])
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    emb = rng.normal(0, 1, (30, 4))
    filters = [rng.normal(0, 1, (w, 4, 3)) for w in (1, 2, 3)]
    bias, out, out_bias = rng.normal(0, 0.1, 9), rng.normal(0, 1, 9), rng.normal(0, 1, 1)
    x, y = [rng.integers(0, 30, n) for n in (7, 0, 12, 1)], np.array([1.0, 0.0, 0.0, 1.0])
    params = [*filters, bias, out, out_bias]
    loss = lambda: toxicity.gradients(x, y, emb, filters, bias, out, out_bias)[0]
    _, grads, (rows, row_grads) = toxicity.gradients(x, y, emb, filters, bias, out, out_bias)
    by_emb = np.zeros_like(emb)
    np.add.at(by_emb, rows, row_grads)
    for p, g in zip([*params, emb], [*grads, by_emb]):
        for at in np.ndindex(*p.shape):
            was, step = p[at], 1e-6
            p[at] = was + step
            up = loss()
            p[at] = was - step
            down = loss()
            p[at] = was
            assert abs((up - down) / (2 * step) - g[at]) < 1e-3, at


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secret_scan", "mix_sources", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).cache()
        assert docs.columns == before.columns and docs.count() > 0.7 * n, name
        if name in ("toxicity", "near_dedup"):
            assert docs.join(before, before.columns, "left_semi").count() == docs.count() <= before.count()
        if name == "secret_scan":
            assert docs.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("sequence_id", "offset").distinct().count() == packed.count()
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_bears_awkward_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = docs.select(*corpus_pipeline.COLUMNS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    table.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0

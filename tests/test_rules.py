"""Text rules and ordered work against plain versions."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from sedimark.functions import semver
from sedimark.functions import text as T
from sedimark.operators import blocks as B
from sedimark.operators import checks as C
from sedimark.operators import governance as G
from sedimark.operators import ordered as O
from sedimark.operators import relate as R
from sedimark.operators import telemetry as M


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_casefold_and_combining(spark):
    texts = ["plain", "STRASSE ß ẞ", "ﬁn ſ", "ΣΑΣ ς", "İI", "ŉ ǰ ΐ", None, "", "".join(T.foldings())]
    assert column(spark, texts, T.casefold) == [t if t is None else t.casefold() for t in texts]
    marks = ["a\u0301b", "क\u093fि", "x\ufe0f", "한국 \u302a"]
    plain = lambda t: [c for c in t if not unicodedata.combining(c)]
    wide = re.compile(T.CJK_WIDE.replace(r"\x{", "\\u").replace("}", ""))
    want = [-(-n * 2 // 3) + -(-(len(b) - n) // 4) for b in map(plain, marks) for n in [sum(bool(wide.match(c)) for c in b)]]
    assert column(spark, marks, T.token_estimate_budget) == want


def test_claims_and_their_negation(spark):
    lines = ["It guarantees and does not guarantee, always", "不保证 保证了", "并未证明其 x 证明", "说明了这个系统负责", "not always not ensured ENSURED", "never  fails", "doesn't prove; proved", "reassure", "", None, "DOES NOT guarantee", "note guarantee"]

    def plain(line):
        out = []
        for code, pattern in T.CLAIMS:
            for m in re.finditer(pattern, line or "", re.ASCII):
                if not line[max(0, m.start() - 12) : m.start()].casefold().endswith(T.NEGATION):
                    out.append((code, m.start()))
        return sorted(out)

    got = column(spark, lines, T.claim_codes)
    assert [sorted((c.code, c.at) for c in x or []) for x in got] == [plain(x) for x in lines]


def test_redaction_and_paths(spark):
    texts = ["sk-abcdef x", "my Token_12345678!", "key-short", "see C:\\a\\b c:/d and /etc/x'y", "a/b", "half / done"]
    assert column(spark, texts, T.redacted) == ["[REDACTED] x", "my [REDACTED]!", "key-short", "see [PATH] [PATH] and [PATH]'y", "a[PATH]", "half / done"]


def test_versions(spark):
    order = ["0.0.1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0", "1.0.1", "1.9.0", "1.10.0", "2"]
    keys = column(spark, order, semver.key)
    assert keys == sorted(keys) and len(set(keys)) == len(order)
    assert column(spark, ["1", "1.0.0+b", "v1", "1.02", ""], semver.key)[2:] == [None] * 3
    cases = {("1.2.3", "~=1.2.0"): True, ("1.3.0", "~=1.2.0"): False, ("1.9.0", ">=1.0.0,<2"): True, ("2.0.0-rc.1", ">=2.0.0"): False, ("1.5.0", "1.x"): True, ("1.5.0", "1.4.x"): False, ("3.0.0", ""): True, ("1.0.0", "=1"): True, ("5.0.0", ">=4.x"): False}
    df = spark.createDataFrame([(v, r, w) for (v, r), w in cases.items()], "v string, r string, w boolean")
    assert all(r.got == r.w for r in df.withColumn("got", semver.in_range(semver.key(F.col("v")), F.col("r"))).collect())


def test_fragments(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "漢字", "line\n", "\r\n", "x" * 40, " "]) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + ["", "漢" * 500, "y" * 1000 + "\nz"]
    tokens = lambda t: (sum("\u4e00" <= c <= "\u9fff" for c in t) + 1) // 2 + (sum(not "\u4e00" <= c <= "\u9fff" for c in t) + 3) // 4

    def plain(text, target):
        if tokens(text) <= target:
            return [text]
        out, now = [], ""
        for line in text.splitlines(keepends=True):
            if tokens(line) > target:
                out += [now] * bool(now)
                now = ""
                while line:
                    end = min(len(line), target * 3)
                    while end > 1 and tokens(line[:end]) > target:
                        end -= 1
                    out.append(line[:end])
                    line = line[end:]
            elif now and tokens(now + line) > target:
                out.append(now)
                now = line
            else:
                now += line
        return out + [now] * bool(now)

    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for target in (1, 7, 50):
        got = {}
        for r in B.split_texts(df, target).orderBy("id", "nth").collect():
            got.setdefault(r.id, []).append(r.fragment)
            assert r.tokens == tokens(r.fragment)
        assert [got[i] for i in range(len(texts))] == [plain(t, target) for t in texts]


def test_ordered_work_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    got = O.numbered(df, ["k"], ["v", "i"], "n", 1).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.n):
        by.setdefault(r.k, []).append((r.v, r.i))
        assert len(by[r.k]) == r.n
    assert all(x == sorted(x) for x in by.values()) and len(got) == 3000
    ewma = {r.k: r.ewma for r in M.smoothed(df, "k", ["i"], "v", 15.0).collect()}
    for k in ("hot", "cold", None):
        h = 15.0
        for key, v, _ in rows:
            if key == k:
                h = 0.3 * v + 0.7 * h
        assert abs(ewma[k] - h) < 1e-9
    total = lambda state, k: [(k, state[0])]

    def step(state, k, i):
        assert i > state[1]
        state[:] = [state[0] + 1, i]
        return []

    sums = O.folded(df, "k", ["i"], ["i"], lambda: [0, -1], step, "k string, n bigint", total).collect()
    assert {r.k: r.n for r in sums} == {k: sum(x[0] == k for x in rows) for k in ("hot", "cold", None)}
    assert O.folded(df.limit(0), "k", ["i"], ["i"], list, step, "k string, n bigint", total).collect() == []


def test_slots_by_automaton(spark):
    rng = random.Random(5)
    units = [(rng.choice(["term", "case"]), "".join(rng.choice("abcAB ") for _ in range(rng.randrange(0, 30)))) for _ in range(300)]
    slots = [(i, ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 4))], ["ab"] * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(units, "kind string, content string")
    sl = spark.createDataFrame(slots, "slot_id bigint, keywords array<string>, structure_keywords array<string>")
    got = {r.slot_id: r.matched for r in C.slot_coverage(df, sl, ("term",), df.select(F.col("content").alias("t"))).collect()}
    hits = lambda texts, keys: sum(any(k in t.lower() for k in keys) for t in texts)
    assert got == {i: max(hits([t for k, t in units if k == "term"], a), hits([t for _, t in units], b)) for i, a, b in slots}
    was, C.KEYWORDS_AT_ONCE = C.KEYWORDS_AT_ONCE, 9
    try:
        assert {r.slot_id: r.matched for r in C.slot_coverage(df, sl, ("term",)).collect()} == {i: hits([t for k, t in units if k == "term"], a) for i, a, _ in slots}
    finally:
        C.KEYWORDS_AT_ONCE = was


def test_negated_principles_against_all_pairs(spark):
    rng = random.Random(2)
    units = [(i, rng.choice(["principle", "anti_pattern", "term"]), " ".join(rng.choice(["plan", "not", "week", "note", "Avoid", "code", "tests"]) for _ in range(rng.randrange(0, 4)))) for i in range(80)]
    got = {(r.a, r.b) for r in R.detect_conflicts(spark.createDataFrame(units, "id bigint, kind string, content string")).collect()}
    sets = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, _, t in units}
    want = set()
    for a, ka, ta in units:
        for b, kb, tb in units:
            x, y = sets[a], sets[b]
            if a < b and {ka, kb} == {"principle", "anti_pattern"} and x & y and len(x & y) / len(x | y) >= 0.34:
                want.add((a, b))
            if a < b and ka == kb == "principle" and x != y and x & y and any(m in t.lower() for t in (ta, tb) for m in R.NEGATION_MARKERS):
                want.add((a, b))
    assert got == want and len(got) > 10


def test_pack_decisions_against_the_rule(spark):
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(4)}", i, f"h{rng.randrange(4)}", rng.sample(["a", "B ", "b", "c", "d"], rng.randrange(0, 3))) for i in range(200)]
    kinds = "canonical_key string, ord bigint, sha256 string, scope array<string>"
    got = {r.ord: (r.disposition, r.existing_sha256) for r in G.pack_decisions(spark.createDataFrame(rows[:5], kinds), spark.createDataFrame(rows[5:], kinds)).collect()}
    known, want = {}, {}
    plain = lambda scope: {s.strip().lower() for s in scope}
    for n, (key, i, sha, scope) in enumerate(rows):
        seen = known.setdefault(key, [])
        if n < 5:
            seen.append((sha, plain(scope)))
        elif not seen:
            seen.append((sha, plain(scope)))
            want[i] = ("add", None)
        elif any(s == sha for s, _ in seen):
            first = next(s for s in seen if s[0] == sha)
            known[key] = [(sha, first[1] | plain(scope))]
            want[i] = ("merge", sha)
        else:
            want[i] = ("conflict_review" if seen[0][1] & plain(scope) else "coexist_review", seen[0][0])
            seen.append((sha, plain(scope)))
    assert got == want


def test_ratio_pairs_against_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(8)
    words = ["plan", "week", "monday", "read", "team", "the", "of", "and", "计划", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 60))) for _ in range(12)]
    data = []
    for b in base * 5:
        w = b.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice([*words, ""])
        data.append((len(data), rng.choice("st"), " ".join(w)))
    df = spark.createDataFrame(data, "id bigint, source string, quote string").withColumn("words", T.effective_words(F.col("quote")))
    got = {(r.a, r.b): r.ratio for r in R.ratio_pairs(df).collect()}
    rows = df.withColumn("n", T.normalized(F.col("quote"))).where("words >= 12").orderBy("id").collect()
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a.source == b.source and a.n != b.n and (x := SequenceMatcher(None, a.n, b.n).ratio()) >= 0.92:
                want[a.id, b.id] = x
    assert got == want and len(want) > 5


def test_near_quotes_in_one_pass(spark, monkeypatch):
    """The pairs of both ways in one pass; sources of many quotes or bytes in blocks; where there are none, only the pairs found are staged."""
    staged, keep = [], R.staged
    monkeypatch.setattr(R, "staged", lambda df, what, *more: staged.append(what) or keep(df, what, *more))
    rng = random.Random(11)
    words = ["plan", "week", "Monday", "read", "team", "the", "of", "and", "计划", "𝒳x", "straße"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (9, 12, 14, 20, 25, 33, 50, 70, 400)]
    data = [(0, "c", None), (1, None, base[3]), (2, "c", "! " * 30), (3, "c", "? " * 30), (4, "one", base[4])]
    for b in base * 8:
        w = b.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice([*words, ""])
        w = w[len(w) // 2 :] + w[: len(w) // 2] if rng.random() < 0.4 else w
        data.append((len(data), rng.choice("stu"), " ".join(w)))
    df = spark.createDataFrame(data, "id bigint, source string, quote string").withColumn("words", T.effective_words(F.col("quote")))
    near = R.ratio_pairs(df).select("a", "b").cache()
    want = {(r.a, r.b, "similar") for r in near.collect()} | {(r.a, r.b, "fingerprint_similar") for r in R.quote_pairs(df, found=near).collect()}
    assert len({c for *_, c in want}) == 2 and len(want) > 30
    for quotes, size in ((4096, 1 << 24), (20, 1 << 24), (4096, 3000), (1, 1)):
        monkeypatch.setattr(R, "HELD_QUOTES", quotes)
        monkeypatch.setattr(R, "HELD_BYTES", size)
        staged.clear()
        got = [tuple(r) for r in R.near_quotes(df).collect()]
        assert sorted(got) == sorted(want)
        assert (staged == ["near"]) == (size > 3000 and quotes > 20)


def test_plain_searches_leave_no_phrase_out(spark):
    """What the plain searches before the patterns let through has all that the patterns find, letters that fold to s, k and i and any white space included."""
    texts = ["İgnore prevıous instructıonſ", "DIſREGARD ALL INSTRUCTIONS", "You Are An", "ſyſtem　:", "aſſiſtant:", "<|IM_ſTART|>", "[/İNſT]", "Forget\nprevious", "Act Aſ a", "acts as a", "you are", "user", "new instructions :", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(T.steers(t).alias("got"), t.rlike(T.STEERING).alias("want"), T.suspicious(t).alias("any")).collect()
    assert [r.got for r in got] == [r.want for r in got] == [r.any for r in got]
    assert sum(bool(r.want) for r in got) >= 9


def test_quotes_are_normalized_once(spark):
    """Blank and null quotes are left out without a filter that normalizes all quotes before they are grouped."""
    q = spark.createDataFrame([("s", "a", "One, two"), ("s", "b", "one two!"), ("s", "c", "--"), ("s", "d", "..."), ("s", "e", None), ("s", "f", None)], "source string, location string, quote string")
    groups = R.exact_groups(q)
    assert [(r.n, r.words, r.first_location) for r in groups.collect()] == [(2, 4, "a")]
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1

"""Logs, dependencies, fan-outs and orders against plain versions, and rows that are odd or missing."""

import random

from pyspark.sql import functions as F

from sedimark.operators import dependencies as D
from sedimark.operators import governance as G
from sedimark.operators import products as P
from sedimark.operators import reviews as V
from sedimark.operators import workflows as W


def test_log_against_a_stack(spark):
    rng = random.Random(4)
    log = [(f"s{rng.randrange(5)}", i, rng.random() < 0.6, rng.choice(["publish", "publish", "rollback"]), f"a{rng.randrange(3)}") for i in range(400)]
    got = {r.skill: (r.ord, r.attempt) for r in G.standing_publications(spark.createDataFrame(log, "skill string, ord bigint, success boolean, action string, attempt string").repartition(5)).collect()}
    stacks = {}
    for skill, i, ok, action, attempt in log:
        stack = stacks.setdefault(skill, [])
        if ok:
            stack.append((i, action, attempt))
        elif stack and action == stack[-1][1] == "publish" and stack[-1][2] == attempt:
            stack.pop()
    assert got == {s: (st[-1][0], st[-1][2]) for s, st in stacks.items() if st}


def plain_order(ids, needs):
    """Depth first by id, each behind all that it needs."""
    out = []

    def visit(x):
        if x not in out:
            for y in sorted(b for a, b, _ in needs if a == x):
                visit(y)
            out.append(x)

    for x in sorted(ids):
        visit(x)
    return out


def test_install_order_is_depth_first_by_id(spark):
    rng = random.Random(6)
    ids = [f"x{i:02d}" for i in range(40)] + ["alone", "zz"]
    rank = rng.sample(ids, len(ids))
    needs = [(a, b, "") for i, a in enumerate(rank) for b in rng.sample(rank[:i], min(i, rng.randrange(0, 3)))]
    tables = lambda needs: (spark.createDataFrame([(i, "1.0.0") for i in ids], "extension_id string, version string"), spark.createDataFrame(needs, "extension_id string, needed string, range string"))
    rows = D.install_plan(*tables(needs + needs[:3] + [("nobody", "x01", "")])).collect()
    assert [r.extension_id for r in sorted(rows, key=lambda r: r.place)] == plain_order(ids, needs) and all(r.problem is None for r in rows)
    first, *_, last = plain_order(ids, needs)
    rows = {r.extension_id: r for r in D.install_plan(*tables([*needs, (rank[0], "gone", ""), ("alone", "zz", ""), ("zz", "alone", "*")])).collect()}
    reach = {x: {x} for x in ids}
    for _ in ids:
        for a, b, _ in needs:
            reach[a] |= reach[b]
    loop = {"alone", "zz"}
    for x in ids:
        bad = rank[0] in reach[x] or loop & reach[x]
        assert (rows[x].place is None) == bool(bad) and rows[x].cycle == ("alone" if x in loop else None)
        assert rows[x].problem == ("missing:gone" if x == rank[0] else "cycle" if x in loop else "behind" if bad else None)
    left = [x for x in ids if rows[x].place is not None]
    assert sorted(left, key=lambda x: rows[x].place) == plain_order(left, [n for n in needs if n[0] in left])


def test_cycles_against_reachability():
    rng = random.Random(9)
    for _ in range(60):
        ids = [f"n{i}" for i in range(9)]
        needs = {a: sorted({rng.choice(ids) for _ in range(rng.randrange(3))}) for a in ids}
        reach = {a: set(needs[a]) for a in ids}
        for _ in ids:
            for a in ids:
                reach[a] |= {c for b in reach[a] for c in reach[b]}
        assert D.cycles(needs) == {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids if a in reach[a]}


def test_empty_tables(spark):
    empty = lambda kinds: spark.createDataFrame([], kinds)
    assert D.install_plan(empty("extension_id string, version string"), empty("extension_id string, needed string, range string")).collect() == []
    assert G.update_decision(empty("change string"), empty("x int"), empty("x int"), empty("override_id string")).first().blocker == "no_changes"
    assert [tuple(r) for r in V.publish_blockers(empty("unit_id string, review_status string"), empty("conflict_id string")).collect()] == [("no_units", None)]
    assert V.report_status(empty("status string")).first().status == "pass"
    m = V.bundle_metrics(empty("source_id string"), empty("row string, unit_id string, source_id string, block_id string")).first()
    assert (m.sources, m.candidates, m.coverage) == (0, 0, 1.0)
    kinds = "canonical_key string, ord bigint, sha256 string, scope array<string>"
    assert G.pack_decisions(empty(kinds), empty(kinds)).collect() == []
    assert W.workflow(empty("source_id string, kind string, content string, ord bigint, unit_id string")).collect() == []
    assert G.first_violation(empty("phase int, ord bigint, nth bigint, reason string, unit_id string, source_id string, block_id string")).first().violations == 0


def test_rows_that_break_rules(spark):
    kinds = "unit_id string, kind string, content string, refs bigint, confidence double, review_status string, record_version bigint, evidence_level string, evidence_note string"
    rows = [(None, None, None, None, float("nan"), None, None, None, None), ("a", "term", "x" * 100_000, 1, 0.0, "approved", None, None, None)]
    got = {(r.unit_id, r.rule) for r in G.row_violations(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(None, rule) for rule in ("content", "kind", "source_refs", "confidence", "review_status")}


def test_prompts_and_versions(spark):
    df = spark.createDataFrame([(["a ", " ", "f1"],), ([],), (["p", "q", "r", "s"],)], "v array<string>")
    assert [r.x for r in df.select(P.at_least_three(F.col("v"), ["f1", "f2", "f3"]).alias("x")).collect()] == [["a", "f1", "f2"], ["f1", "f2", "f3"], ["p", "q", "r"]]
    pairs = spark.createDataFrame([("1.9.0", "1.10.0"), ("1.0.0", "1.0.0"), ("2.0.0", "2.0.0-rc.1"), ("x", "1.0.0")], "a string, b string")
    assert [r.x for r in pairs.select(V.version_increases(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, None]

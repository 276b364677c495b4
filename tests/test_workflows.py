"""Compiled workflows and progress against plain versions."""

import random

from pyspark.sql import functions as F

from sedimark.operators import workflows as W

KINDS = ["framework", "principle", "technique", "case", "term", "anti_pattern", "checklist", "decision_rule"]


def plain_workflow(units):
    out = []
    for source in {u[0] for u in units}:
        mine = sorted((u for u in units if u[0] == source), key=lambda u: (u[4], u[1]))
        files = ",".join(f for k, f in W.REFERENCES if any(u[2] == k for u in mine))
        steps = []
        for kind in W.STEP_KINDS:
            for u in mine:
                if u[2] == kind:
                    lines = (u[3] or "").strip().splitlines()
                    first = lines[0] if lines else ""
                    first = first[:77] + "..." if len(first) > 80 else first
                    title = kind.replace("_", " ").title()
                    text = " ".join(x.strip() for x in (u[3] or "").splitlines() if x.strip())
                    steps.append((f"{title}: {first}" if first else title, text[:237].rstrip() + "..." if len(text) > 240 else text, u[1]))
        steps.append((*(W.ROUTING if steps else W.ALONE), files))
        out += [(source, i + 1, *s) for i, s in enumerate(steps)]
    return sorted(out)


def test_workflow(spark):
    rng = random.Random(7)
    bits = ["word", "two words", "\n", "\r\n", " ", "　", " \t", "x" * 79, "y" * 120, "é𝒳", "\x0b", "\x1c", ""]
    units = [(f"s{rng.randrange(6)}", f"u{i}", rng.choice(KINDS[: rng.choice([4, 8])]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))]), rng.randrange(20)) for i in range(300)]
    units += [("only", "t1", "term", "a", 1), ("other", "o1", "unknown", "a", 1)]
    got = W.workflow(spark.createDataFrame(units, "source_id string, unit_id string, kind string, content string, ord bigint").repartition(4)).collect()
    assert sorted(map(tuple, got)) == plain_workflow(units)


def test_contract_items_are_distinct_in_order(spark):
    rows = [("s", "b", [" x ", "y", None, "", "x"], 2), ("s", "a", ["z", "y"], 1), ("s", "c", None, 0), ("t", "d", ["　x"], 5)]
    got = W.contract_items(spark.createDataFrame(rows, "source_id string, unit_id string, conditions array<string>, ord bigint"), "conditions")
    assert sorted(map(tuple, got.collect())) == [("s", 1, "z"), ("s", 2, "y"), ("s", 3, "x"), ("t", 1, "x")]


def test_progress_of_skipped_stages(spark):
    rng = random.Random(8)
    stages = {"a": 0.05, "b": 0.45, "c": 0.05, "d": 0.3}
    events = [(f"k{rng.randrange(12)}", i, rng.choice("abcdx"), rng.choice([-1.0, 0.0, 0.2, 0.7, 1.5])) for i in range(60)] + [("late", 100, "d", 0.5), ("late", 101, "a", 0.1)]
    want, seen, done = {}, {}, {}
    for k, _, stage, f in events:
        if stage not in stages:
            continue
        names = list(stages)
        mine, fractions = seen.setdefault(k, set()), done.setdefault(k, dict.fromkeys(stages, 0.0))
        for prior in names[: names.index(stage)]:
            if prior not in mine:
                fractions[prior] = 1.0
        mine.add(stage)
        fractions[stage] = max(fractions[stage], min(1.0, max(0.0, f)))
        want[k] = round(100 * sum(stages[n] * fractions[n] for n in names) / sum(stages.values()), 6)
    df = spark.createDataFrame(events, "k string, i bigint, stage string, f double").repartition(3)
    got = {r.k: r.percent for r in W.furthest_progress(df, "k", ["i"], "stage", F.col("f"), stages).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_units_are_made_once_for_all_parts(spark, monkeypatch):
    """What a wiki's parts and a workflow's steps read is staged, so that the units behind them are not made anew for each."""
    names, keep = [], W.staged
    monkeypatch.setattr(W, "staged", lambda df, what, *more: names.append(what) or keep(df, what, *more))
    units = spark.createDataFrame([("s", "u1", "principle", "　a\r\nb \x85", 1), ("s", "u2", "framework", "  ", 2)], "source_id string, unit_id string, kind string, content string, ord bigint")
    assert [r.text for r in W.wiki_parts(units).where("file like '%patterns.md'").orderBy("place").collect()] == ["# Patterns & Anti-Patterns\n", "## Patterns\n", "- a", ""]
    assert [(r.step, r.description) for r in W.workflow(units).where("refs like 'u%'").orderBy("place").collect()] == [("Framework", ""), ("Principle: a", "a b")]
    assert names == ["units", "named", "units"]

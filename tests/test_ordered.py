"""Scans over ranges: right for hot keys, and dealt over tasks."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sedimark.operators import ordered, telemetry


def hot_rows(n=6000):
    """A third of all rows have one key."""
    rng = random.Random(11)
    return [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}", rng.randrange(10**6), i, round(rng.uniform(-5, 50), 2)) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


def test_running_sums_and_the_row_before(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, at bigint, i bigint, v double").repartition(5)
    odd = F.when(F.col("i") % 7 == 0, None).otherwise(F.col("v"))
    got = {r.i: (round(r.s, 6), r.n, r.was) for r in ordered.carried(df, ["k"], ["at", "i"], {"s": F.col("v"), "n": F.lit(1)}, {"was": odd}).collect()}
    want = {}
    for mine in by_key(rows).values():
        total, was = 0.0, None
        for n, (_, _, i, v) in enumerate(mine, 1):
            total += v
            want[i] = (round(total, 6), n, was)
            was = None if i % 7 == 0 else v
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-4 and got[i][1:] == want[i][1:] for i in want)


def test_sums_over_a_span(spark):
    rows = hot_rows(1500) + [("tie", 5, 10**6 + i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, at bigint, i bigint, v double").repartition(3)
    got = {r.i: r.load for r in ordered.over_span(df, ["k"], "at", 20_000, F.col("v"), "load").collect()}
    for mine in by_key(rows).values():
        for _, at, i, _ in mine:
            assert abs(got[i] - sum(v for _, b, _, v in mine if at - 20_000 <= b <= at)) < 1e-6


def test_a_hot_key_spans_many_tasks(spark, monkeypatch):
    """Of a key with a third of all rows no range, and so no task of the local scans, has more than about twice the median."""
    seen = []
    keep = ordered.staged
    monkeypatch.setattr(ordered, "staged", lambda df, what: seen.append(keep(df, what)) or seen[-1])
    rows = hot_rows(30_000)
    df = spark.createDataFrame(rows, "k string, at bigint, i bigint, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered.carried(df, ["k"], ["at", "i"], {"s": F.col("v")}).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(Counter(r[0] for r in seen[0].select("__cell").collect()).values())
    cells = {r[0] for r in seen[0].where("k = 'hot'").select("__cell").distinct().collect()}
    assert len(cells) >= 3 and sizes[-1] <= 2.2 * sizes[len(sizes) // 2]


def test_failure_runs_of_a_hot_user(spark):
    rows = hot_rows(3000)
    df = spark.createDataFrame(rows, "k string, at bigint, i bigint, v double").repartition(4)
    want = set()
    for k, mine in by_key(rows).items():
        ok, run = 0, []
        for _, _, i, v in [*mine, (0, 0, 0, -9.0)]:
            if v > 20:
                run.append(i)
                continue
            if len(run) >= 2:
                want.add((k, ok, len(run), min(run)))
            ok, run = ok + 1, []
    got = telemetry.failure_runs(df, "k", ["at", "i"], F.col("v") > 20, 2).collect()
    assert {tuple(r) for r in got} == want

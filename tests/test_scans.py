"""Prefix folds over arrays and places of matches: right, and not quadratic in the number of matches."""

import random
import re
import time

from pyspark.sql import functions as F

from sedimark.functions import text as T


def test_prefix_folds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 63, 64, 65, 128, 1000))]
    df = spark.createDataFrame(rows, "i int, v array<bigint>")
    most = T.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-100))
    for r in df.select("v", T.running_sum(F.col("v")).alias("s"), most.alias("m")).collect():
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))] and r.m == [max(r.v[: k + 1]) for k in range(len(r.v))]


def test_places_of_matches(spark):
    texts = ["", "none", "ab12cd345", "7" * 5, "é1𝒳22 x3", " ".join(f"w{i}" for i in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(m.start, m.end, m.match) for m in r.m] for r in df.select(T.matches(F.col("t"), "[0-9]+").alias("m")).collect()]
    assert got == [[(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t)] for t in texts]


def test_many_matches_cost_in_proportion(spark):
    def took(n):
        df = spark.range(1).select(F.repeat(F.lit("ab 12 "), F.lit(n)).alias("t")).select(F.aggregate(T.matches(F.col("t"), "[0-9]+"), F.lit(0).cast("bigint"), lambda a, m: a + m.start).alias("s"))
        best = 1e9
        for _ in range(2):
            t = time.time()
            assert df.first().s == sum(6 * i + 3 for i in range(n))
            best = min(best, time.time() - t)
        return best

    took(10)
    assert took(64_000) < 8 * max(took(16_000), 0.15)

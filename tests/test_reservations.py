"""Reservations: against a plain list, and the stream against the batch, with a restart between."""

import random

from pyspark.sql import functions as F

from sedimark.operators import reservations as S


def plain(rows, quota):
    """Every reservation is kept in a list, and the sum over the window is taken anew each time."""
    out, states = {}, {}
    for k, event, now, tokens in sorted(rows, key=lambda r: (r[2], r[1])):
        next_start, kept = states.get(k, (0, []))
        if tokens < 0 or quota.tokens is not None and tokens > quota.tokens:
            out[event] = (None, None, "negative" if tokens < 0 else "over_quota")
            continue
        start, released = max(now, next_start), [x for x in kept if x[0] + quota.window <= now]
        left = [x for x in kept if x not in released]
        while quota.tokens is not None and sum(t for *_, t in left) + tokens > quota.tokens:
            start = max(start, left[0][0] + quota.window)
            left = [x for x in left if x[0] + quota.window > start]
        left = [*left, (start, event, tokens)]
        out[event] = (start, sum(t for *_, t in left) if quota.tokens is not None else None, None)
        states[k] = (start + quota.window // quota.per_window, left)
    return out


def requests(n, seed):
    rng, at, rows = random.Random(seed), 10**12, []
    for i in range(n):
        at += rng.choice([0, 0, 5, 200, 3000, 90_000])
        rows.append((None if i % 97 == 5 else rng.choice("aaab"), i, at, rng.choice([0, 1, 7, 40, 99, 100, 101, -1])))
    return rows


def test_reservations_against_a_list(spark):
    for seed, quota in enumerate([S.Quota(15, 100), S.Quota(2, 100), S.Quota(600, 150, 10_000), S.Quota(15, None)]):
        rows = requests(400, seed)
        got = S.reservations(spark.createDataFrame(rows, "k string, event_id bigint, now bigint, tokens bigint").repartition(4), "k", quota).collect()
        want = plain(rows, quota)
        assert {r.event_id: (r.start, r.reserved, r.code) for r in got} == want and len(got) == len(rows)
        assert all(r.delay == (None if r.start is None else r.start - r.now) for r in got)


def test_the_stream_gives_the_batchs_rows_also_after_a_restart(spark, tmp_path):
    quota, rows = S.Quota(15, 100), [r for r in requests(300, 9) if r[0]]
    schema = "k string, event_id bigint, now bigint, tokens bigint"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):  # each run is a new query that goes on from the checkpoint
            spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("now"))
            S.reserved_stream(stream, "k", quota).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in S.reservations(spark.createDataFrame(rows, schema), "k", quota).collect()}
    assert got == want

"""Telemetry of invocations: the stream's rows are the batch's, with unmatched and late chunks."""

import datetime as dt

from pyspark.sql import functions as F

from sedimark.operators import invocations as I

T0 = dt.datetime(2024, 1, 1)
REQUESTS, CHUNKS = "channel string, request_id bigint, started timestamp", "request_id bigint, at timestamp, tokens bigint, usage bigint"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def tables():
    requests = [("a", 1, at(0)), ("a", 2, at(5)), ("b", 3, at(6)), ("a", 4, at(200)), ("b", 5, at(201)), (None, 6, at(202))]
    chunks = [(1, at(1), 0, None), (1, at(2), 5, None), (1, at(4), 7, 40), (1, at(4), 1, 30), (2, at(20), 9, None), (2, at(4), 9, None), (3, at(6), 3, None), (5, at(203), 0, None), (9, at(203), 1, 1), (6, at(204), 2, -1)]
    return requests, chunks


def test_invocations(spark):
    requests, chunks = tables()
    got = {r.request_id: r for r in I.invocations(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(chunks, CHUNKS), "10 MINUTES").collect()}
    assert (got[1].latency, got[1].output_tokens, got[1].fallback) == (120.0, 40, False) and abs(got[1].per_second - 40 / 120) < 1e-9
    assert (got[2].latency, got[2].output_tokens, got[2].per_second, got[2].fallback) == (None, 0, None, True)
    assert (got[3].latency, got[3].output_tokens) == (0.0, 3) and got[3].per_second == 3 / I.LEAST
    assert got[4].fallback and not got[5].fallback and got[5].latency is None and got[5].per_second is None and got[6].output_tokens == 2
    by = I.sessions(I.invocations(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(chunks, CHUNKS), "10 MINUTES"), "1 hour").collect()
    assert {(r.channel, r.n, r.fallbacks) for r in by} == {("a", 2, 1), ("b", 1, 0), ("a", 1, 1), ("b", 1, 0), (None, 1, 0)}


def test_the_streams_rows_are_the_batchs(spark, tmp_path):
    requests, chunks = tables()
    requests = [r for r in requests if r[0]]
    flush = 10_000  # later rows move the watermark past all sessions
    parts = [(requests[:3], chunks[:7]), (requests[3:], chunks[7:]), ([("z", 98, at(flush))], [(98, at(flush), 1, None)]), ([("z", 99, at(2 * flush))], [(99, at(2 * flush), 1, None)])]
    read = lambda name, schema, ts: spark.readStream.schema(schema).parquet(str(tmp_path / name)).withWatermark(ts, "1 minute")
    frames = {"requests": (REQUESTS, "started"), "chunks": (CHUNKS, "at")}
    for k, rows in enumerate(parts):
        for (name, (schema, _)), mine in zip(frames.items(), rows):
            spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        both = [read(name, schema, ts) for name, (schema, ts) in frames.items()]
        stream = I.sessions(I.invocations(*both, "10 MINUTES"), "1 hour")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    late = spark.createDataFrame([(4, at(203), 50, 50)], CHUNKS)  # behind the watermark: not counted
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("channel <> 'z'").collect()}
    whole = I.sessions(I.invocations(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(chunks, CHUNKS), "10 MINUTES"), "1 hour")
    assert got == {tuple(r) for r in whole.collect()}
    assert whole.select(F.sum("n")).first()[0] == len(requests)

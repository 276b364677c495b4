"""Telemetry of streamed invocations: first-token latency, tokens a second and fallbacks, by invocation and by session of a channel.

The functions take tables or streams. On streams the join keeps requests and chunks for the interval between them, requests without a chunk come out
once the watermark has passed the interval, and sessions when it has passed their gap; rows later than the watermark are dropped, as the contract of streams says.

requests: (channel, request_id, started); chunks: (request_id, at, tokens, usage), of which tokens (0: no content) estimates the content of a chunk and usage, if any,
is what the provider says. Chunks before the start or more than `within` behind it are not the request's. A request without content has no latency; one without chunks
is a fallback. The last usage by time counts (the highest of equal times), else the sum of the estimates. A repeated request id is one request for each channel and start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least seconds that count as time spent.
LEAST = 1e-9


def invocations(requests: DataFrame, chunks: DataFrame, within: str) -> DataFrame:
    """channel, request_id, started, latency, output_tokens, per_second and fallback of each request."""
    c = chunks.select(F.col("request_id").alias("of"), "at", "tokens", "usage")
    near = (F.col("request_id") == F.col("of")) & (F.col("at") >= F.col("started")) & (F.col("at") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    met = requests.select("channel", "request_id", "started").join(c, near, "left_outer")
    by = met.groupBy("channel", "request_id", "started").agg(
        F.min(F.when(F.col("tokens") > 0, F.col("at"))).alias("first"),
        F.max("at").alias("last"),
        F.max(F.when(F.col("usage") >= 0, F.struct("at", "usage"))).alias("said"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("guess"),
    )
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    latency = seconds(F.col("started"), F.col("first"))
    output = F.coalesce("said.usage", "guess")
    spent = F.greatest(F.greatest(seconds(F.col("started"), F.col("last")), F.lit(LEAST)) - F.coalesce(latency, F.lit(0.0)), F.lit(LEAST))
    return by.select("channel", "request_id", "started", latency.alias("latency"), output.alias("output_tokens"), F.when((output > 0) & F.col("last").isNotNull(), output / spent).alias("per_second"), F.col("last").isNull().alias("fallback"))


def sessions(invoked: DataFrame, gap: str) -> DataFrame:
    """channel, begun, n, fallbacks, share of fallbacks, mean latency and tokens of the sessions of a channel: requests that start within gap of the one before."""
    by = invoked.groupBy("channel", F.session_window("started", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fallback").alias("fallbacks"), F.avg("latency").alias("latency"), F.sum("output_tokens").alias("tokens"))
    return by.select("channel", F.col("w.start").alias("begun"), "n", "fallbacks", (F.col("fallbacks") / F.col("n")).alias("share"), "latency", "tokens")


def of_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every fifth event as a request of its user's channel, and the four behind it as its chunks: views have no content, and purchases say the usage."""
    e, c = events.withColumn("ts", F.col("ts").cast("timestamp")), F.col
    requests = e.where("event_id % 5 = 0").select(c("user_id").alias("channel"), c("event_id").alias("request_id"), c("ts").alias("started"))
    tokens = F.when(c("event_type") == "view", 0).otherwise(F.floor("value") + 1).cast("bigint")
    chunks = e.where("event_id % 5 > 0").select((c("event_id") - c("event_id") % 5).alias("request_id"), c("ts").alias("at"), tokens.alias("tokens"), F.when(c("event_type") == "purchase", F.floor("value").cast("bigint")).alias("usage"))
    return requests, chunks

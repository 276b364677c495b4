"""Runs over time: rates, smoothed latency, failure runs, budgets and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.ordered import carried, combined, numbered, over_span

# Which state of a transaction may follow which.
TRANSITIONS = {
    "prepared": ("prepared", "publishing", "rollback_required"),
    "publishing": ("publishing", "skill_published", "committed", "rollback_required"),
    "skill_published": ("skill_published", "schema_committed", "committed", "rollback_required"),
    "schema_committed": ("schema_committed", "committed", "rollback_required"),
    "committed": ("committed",),
    "rollback_required": ("rollback_required",),
}


def rate_summary(samples: DataFrame, key: str, rate: Column) -> DataFrame:
    """key, n, median, lower and upper quartile (nearest rank) of a rate; a single sample spans half to one and a half.

    Ranks are dealt by ranges of the rate, so a key with most samples is ranked by many tasks.
    """
    rows = numbered(samples.select(F.col(key), rate.alias("r")).where("r is not null"), [key], ["r"], "i")
    n = samples.where(rate.isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(n, F.col(key).eqNullSafe(F.col("__key")))
    at = lambda i: F.min(F.when(F.col("i") == i, F.col("r")))
    out = rows.groupBy(key, "n").agg(at(F.expr("(n - 1) div 4")).alias("low"), at(F.expr("(n - 1) * 3 div 4")).alias("high"), at(F.expr("(n - 1) div 2")).alias("m1"), at(F.expr("n div 2")).alias("m2"))
    median = (F.col("m1") + F.col("m2")) / 2
    return out.select(key, "n", median.alias("median"), F.when(F.col("n") == 1, median * 0.5).otherwise(F.col("low")).alias("lower"), F.when(F.col("n") == 1, median * 1.5).otherwise(F.col("high")).alias("upper"))


def smoothed(events: DataFrame, key: str, order: list[str], value: str, seed: float, alpha: float = 0.3) -> DataFrame:
    """key and the exponentially weighted mean of value after all its events in order, from sums over ranges of events."""
    sums = combined(events, key, order, value, 1 - alpha)
    return sums.select(key, (F.lit(alpha) * F.col("total") + F.lit(float(seed)) * F.pow(F.lit(1 - alpha), F.col("n"))).alias("ewma"))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """key, run, length and first event of runs of at least `least` failures."""
    rows = carried(events.select(key, *order, failed.alias("failed")), [key], order, {"ok": F.when(F.col("failed"), 0).otherwise(1)})
    runs = rows.where("failed").groupBy(key, "ok").agg(F.count(F.lit(1)).alias("length"), F.min(order[-1]).alias("first_event"))
    return runs.where(F.col("length") >= least).select(key, F.col("ok").cast("long").alias("run"), "length", "first_event")


def window_load(events: DataFrame, key: str, seconds: int, amount: str, limit: float) -> DataFrame:
    """event_id, load (sum of amount over the last seconds of its key) and whether it passes limit."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = over_span(events.select("event_id", key, at.alias("at"), F.col(amount).alias("amount")), [key], "at", seconds * 1_000_000, F.col("amount"), "load")
    return rows.select("event_id", F.round("load", 6).alias("load")).withColumn("over_limit", F.col("load") > limit)


def makespan(jobs: DataFrame, key: str, duration: str, lanes: int) -> DataFrame:
    """key and the least time in which its jobs can end on so many lanes: the longest job or the even share."""
    return jobs.groupBy(key).agg(F.max(duration).alias("longest"), F.sum(duration).alias("total"), F.count(F.lit(1)).alias("n")).select(key, F.greatest("longest", F.col("total") / F.least(F.lit(lanes), F.col("n"))).alias("makespan"))


def transitions(journal: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """key, from_state, to_state, legal and n of consecutive states."""
    rows = carried(journal.select(key, *order, F.col(state).alias("to_state")), [key], order, before={"from_state": F.col("to_state")}).where("from_state is not null")
    legal = F.lit(False)
    for a, bs in TRANSITIONS.items():
        legal = legal | ((F.col("from_state") == a) & F.col("to_state").isin(*bs))
    return rows.withColumn("legal", legal).groupBy("from_state", "to_state", "legal").agg(F.count(F.lit(1)).alias("n"))

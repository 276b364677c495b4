"""Queries of runs over time: reservations of slots and the telemetry of invocations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimark.operators import invocations as I
from sedimark.operators import reservations as S
from sedimark.sources.commits import CommittedTable
from sedimark.sources.scratch import fresh_path, remove_on_exit

from . import catalogue as K

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Four requests and 2000 tokens of a user in a day.
QUOTA = S.Quota(4, 2000, 86_400_000)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, (epoch_us(ts) // 1000)::BIGINT AS now, (floor(value * 10) + 1)::BIGINT AS tok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS now, NULL::BIGINT AS start, NULL::BIGINT AS reserved, []::STRUCT(a BIGINT, t BIGINT)[] AS q, 0::BIGINT AS nxt FROM e
  UNION ALL SELECT user_id, n, event_id, now, CASE WHEN fits THEN start END, CASE WHEN fits THEN list_sum(list_transform(q3, x -> x.t))::BIGINT END, CASE WHEN fits THEN q3 ELSE q END, CASE WHEN fits THEN start + {QUOTA.interval} ELSE nxt END FROM (
   SELECT *, list_append(CASE WHEN k > 0 THEN list_filter(q1, x -> x.a + {QUOTA.window} > start) ELSE q1 END, struct_pack(a := start, t := tok)) AS q3 FROM (
    SELECT *, greatest(now, nxt, CASE WHEN k > 0 THEN q1[k].a + {QUOTA.window} ELSE 0 END) AS start FROM (
     SELECT *, len(list_filter(range(0, len(q1)), i -> coalesce(list_sum(list_transform(q1[i::INT + 1:], x -> x.t)), 0) > {QUOTA.tokens} - tok))::INT AS k FROM (
      SELECT e.user_id, e.n, e.event_id, e.now, e.tok, e.tok <= {QUOTA.tokens} AS fits, r.q, r.nxt, list_filter(r.q, x -> x.a + {QUOTA.window} > e.now) AS q1 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))))
 SELECT user_id, event_id, now, start, start - now AS delay, reserved, CASE WHEN start IS NULL THEN 'over_quota' END AS code FROM r WHERE n > 0""".replace("x -> ", "lambda x: ").replace("i -> ", "lambda i: "))
def slot_reservations(spark, d):
    """When each request may start by its user's pace and tokens, and what is reserved then."""
    return S.reservations(S.requests_of(K.table(spark, d, "events")), "user_id", QUOTA)


_INVOKED = """req AS (SELECT user_id AS channel, event_id AS request_id, ts AS started FROM events WHERE event_id % 5 = 0),
 chk AS (SELECT event_id - event_id % 5 AS request_id, ts AS moment, (CASE WHEN event_type = 'view' THEN 0 ELSE floor(value) + 1 END)::BIGINT AS tokens, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS usage FROM events WHERE event_id % 5 > 0),
 met AS (SELECT r.*, moment, tokens, usage FROM req r LEFT JOIN chk c ON c.request_id = r.request_id AND moment >= started AND moment <= started + INTERVAL 10 MINUTES),
 agg AS (SELECT channel, request_id, started, min(moment) FILTER (WHERE tokens > 0) AS f, max(moment) AS l, arg_max(usage, struct_pack(a := moment, u := usage)) FILTER (WHERE usage >= 0) AS said, coalesce(sum(tokens), 0)::BIGINT AS guess FROM met GROUP BY ALL),
 inv AS (SELECT channel, request_id, started, (epoch_us(f) - epoch_us(started)) / 1e6 AS latency, coalesce(said, guess) AS output_tokens, l IS NULL AS fallback,
  CASE WHEN coalesce(said, guess) > 0 AND l IS NOT NULL THEN coalesce(said, guess) / greatest(greatest((epoch_us(l) - epoch_us(started)) / 1e6, 1e-9) - coalesce((epoch_us(f) - epoch_us(started)) / 1e6, 0), 1e-9) END AS per_second FROM agg)"""


def _invoked(spark, d):
    return I.invocations(*I.of_events(K.table(spark, d, "events")), "10 MINUTES")


@query(f"WITH {_INVOKED} SELECT channel, request_id, round(latency, 6)::DOUBLE AS latency, output_tokens, round(per_second, 3)::DOUBLE AS per_second, fallback FROM inv")
def invocation_telemetry(spark, d):
    """The latency of the first token, the tokens and their rate of each request."""
    return _invoked(spark, d).select("channel", "request_id", F.round("latency", 6).alias("latency"), "output_tokens", F.round("per_second", 3).alias("per_second"), "fallback")


@query(f"""WITH {_INVOKED}, b AS (SELECT *, CASE WHEN started < lag(started) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM inv WINDOW w AS (PARTITION BY channel ORDER BY started, request_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY started, request_id ROWS UNBOUNDED PRECEDING) AS nth FROM b)
 SELECT channel, epoch_us(min(started)) AS begun, count(*) AS n, count(*) FILTER (WHERE fallback) AS fallbacks, count(*) FILTER (WHERE fallback) / count(*) AS share, round(avg(latency), 3)::DOUBLE AS latency, sum(output_tokens)::BIGINT AS tokens FROM s GROUP BY channel, nth""")
def session_telemetry(spark, d):
    """The same by session of each channel."""
    return I.sessions(_invoked(spark, d), "12 hours").withColumn("begun", F.unix_micros("begun")).withColumn("latency", F.round("latency", 3))


@query("""WITH g AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 WHEN doc_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 3 END::BIGINT AS "commit" FROM documents)
 SELECT doc_id, "commit", row_number() OVER (ORDER BY "commit", doc_id) - 1 AS record_no FROM g WHERE "commit" < 3""")
def committed_snapshot(spark, d):
    """Documents committed in three steps, by their labels, as they are at the second version: record numbers go on from commit to commit."""
    docs, labels = K.table(spark, d, "documents").select("doc_id", F.length("text").alias("chars")), K.table(spark, d, "labels")
    good = labels.where("quality = 1").select("doc_id").distinct()
    path = fresh_path(spark, "committed")
    remove_on_exit(spark, path)
    store, known = CommittedTable(spark, path), labels.select("doc_id").distinct()
    for rows in (docs.join(good, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_semi").join(good, "doc_id", "left_anti"), docs.join(known, "doc_id", "left_anti")):
        store.append(rows, ["doc_id"])
    return store.read(2).select("doc_id", "commit", "record_no")

"""Slots for requests: a paced start and a sliding window of reserved tokens for each channel, in batch and as a stream.

A request starts no earlier than an interval behind the one before, and only when the tokens reserved in the window behind its start leave room for its own.
Each start depends on the one before, so a channel's requests are one sequence: in batch a stream through sorted rows with the state of one channel, as a
stream the same step over state that survives restarts. The state is the queue of reservations in the window, which the limit on tokens bounds
(a request has one token at least), and the time of the next start.

Times are whole milliseconds. A request with more tokens than the window holds gets the code over_quota, no start, and leaves the state alone; one with a
negative number gets the code negative. Equal times go by event. Without a limit on tokens only the pace counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.ordered import folded


@dataclass(frozen=True)
class Quota:
    """per_window requests and tokens (None: any) in a window of so many milliseconds."""

    per_window: int
    tokens: int | None
    window: int = 60_000

    @property
    def interval(self) -> int:
        return self.window // self.per_window


class Slots:
    """The state of a channel: when the next request may start, and the reservations (start, tokens) that are still in the window, oldest first."""

    def __init__(self, next_start: int = 0, queue: Iterator[tuple[int, int]] = ()):
        self.next_start, self.queue = next_start, deque(queue)
        self.held = sum(t for _, t in self.queue)

    def _release(self, until: int) -> None:
        while self.queue and self.queue[0][0] <= until:
            self.held -= self.queue.popleft()[1]

    def reserve(self, now: int, tokens: int, quota: Quota) -> tuple[int | None, int | None, str | None]:
        """start, tokens reserved in its window with its own, and code."""
        if tokens < 0:
            return None, None, "negative"
        start = max(now, self.next_start)
        if quota.tokens is not None:
            if tokens > quota.tokens:
                return None, None, "over_quota"
            self._release(now - quota.window)
            while self.held + tokens > quota.tokens:
                start = max(start, self.queue[0][0] + quota.window)
                self._release(start - quota.window)
            self.queue.append((start, tokens))
            self.held += tokens
        self.next_start = start + quota.interval
        return start, self.held if quota.tokens is not None else None, None


def reservations(requests: DataFrame, key: str, quota: Quota) -> DataFrame:
    """key, event_id, now, start, delay, reserved and code of requests (key, event_id, now, tokens)."""

    def step(state: Slots, k, event, now, tokens):
        start, held, code = state.reserve(now, tokens, quota)
        return [(k, event, now, start, None if start is None else start - now, held, code)]

    kind = requests.schema[key].dataType.simpleString()
    return folded(requests, key, ["now", "event_id"], ["event_id", "now", "tokens"], Slots, step, f"{key} {kind}, event_id bigint, now bigint, start bigint, delay bigint, reserved bigint, code string")


def reserved_stream(requests: DataFrame, key: str, quota: Quota, late: str = "1 minute") -> DataFrame:
    """The same rows from a stream of requests (key, event_id, ts, now, tokens). Rows later than the watermark are dropped.

    The queue is list state and the next start value state. When the watermark passes the last reservation's window and the next start, a timer clears both: no
    later request can meet them. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    kind = requests.schema[key].dataType.simpleString()

    class Reserving(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "at bigint, clears bigint")
            self.queue = handle.getListState("queue", "at bigint, tokens bigint")

        def handleInputRows(self, key_, rows, timerValues):
            begun = self.next.exists()
            kept = self.next.get() if begun else None
            state = Slots(kept[0], [tuple(x) for x in self.queue.get()] if self.queue.exists() else []) if begun else Slots()
            taken = sorted((int(n), int(e), int(t)) for frame in rows for n, e, t in zip(frame["now"], frame["event_id"], frame["tokens"]))
            out = []
            for now, event, tokens in taken:
                start, held, code = state.reserve(now, tokens, quota)
                out.append((key_[0], event, now, start, None if start is None else start - now, held, code))
            clears = max([state.next_start, *[at + quota.window for at, _ in state.queue]]) + 1
            if kept is not None and kept[1] != clears:
                self.handle.deleteTimer(kept[1])
            self.handle.registerTimer(clears)
            self.next.update((state.next_start, clears))
            if state.queue:
                self.queue.put(list(state.queue))
            elif self.queue.exists():
                self.queue.clear()
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("start", "delay", "reserved")})

        def handleExpiredTimer(self, key_, timerValues, expiredTimerInfo):
            self.next.clear()
            self.queue.clear()
            return iter([])

        def close(self) -> None:
            pass

    columns = [key, "event_id", "now", "start", "delay", "reserved", "code"]
    rows = requests.withWatermark("ts", late).select(key, "event_id", "ts", "now", "tokens")
    schema = f"{key} {kind}, event_id bigint, now bigint, start bigint, delay bigint, reserved bigint, code string"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Reserving(), outputStructType=schema, outputMode="Append", timeMode="eventTime")


def requests_of(events: DataFrame) -> DataFrame:
    """user_id, event_id, ts, now and tokens of events, each a request of ten tokens for a unit of its value and one more."""
    at = F.col("ts").cast("timestamp")
    return events.select("user_id", "event_id", at.alias("ts"), F.unix_millis(at).alias("now"), (F.floor(F.col("value") * 10) + 1).cast("bigint").alias("tokens"))

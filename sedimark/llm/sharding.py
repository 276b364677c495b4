"""Sharding by longest processing time: groups of rows that stay together, in order of size, to the least-loaded shard.

Groups of one size are interchangeable, so the heap runs over the exact histogram of sizes (size, groups), largest first, and deals out
all groups of a size in one step, as many to each shard as taking them one by one would. A histogram of groups with T bytes in all has at most sqrt(2 T)
sizes, and only it goes to the driver. Spark numbers the groups of each size with a distributed rank and looks up the shard of each number. No group
is ever divided. A group larger than a shard's fair share gets a shard that holds it and nothing that another shard could take, the least that any way of
keeping it whole can reach.

Cases: a null text has no bytes and makes a group of its own apart from empty texts; ties of size go by key and shard
number; repeated rows stay together; a null size counts as 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, staged


def _level(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n items of a size each shard gets if each goes to the least load (then shard number): all places below a level, then those at it in order of shard."""
    below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
    low, high = min(loads), max(loads) + size * n + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    took = below(low)
    rest = n - sum(took)
    for s, x in enumerate(loads):
        if rest and x <= low and (low - x) % size == 0:
            took[s] += 1
            rest -= 1
    return took


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, [(shard, groups), ...]) for a histogram (size, groups) from the largest size down: longest processing time."""
    heap = [(0, s) for s in range(shards)]
    for size, n in histogram:
        took: dict[int, int] = {}
        if n <= 2 * shards:
            for _ in range(n):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                took[shard] = took.get(shard, 0) + 1
        elif not size:
            took[heap[0][1]] = n
        else:
            loads = [x for _, x in sorted((s, x) for x, s in heap)]
            took = {s: k for s, k in enumerate(_level(loads, size, n)) if k}
            heap = [(x + size * took.get(s, 0), s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
        yield size, sorted(took.items())


def shard_rows(df: DataFrame, shards: int, group: list[str], size: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to df, which must be deterministic (a table or staged).

    group: columns that name a group; size: column with a row's bytes. Shuffles (group, bytes) sums and narrow keys; the rows meet
    their groups' shards in a join that Spark splits where a group is hot.
    """
    spark = df.sparkSession
    cols = df.columns
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in group]).cast("binary"))
    df = df.withColumn("__group", key)
    groups = staged(df.groupBy(F.col("__group").alias("__g")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("__bytes"), F.count(F.lit(1)).alias("__rows")), "groups")
    histogram = [(int(r[0]), int(r[1]), int(r[2])) for r in groups.groupBy("__bytes").agg(F.count(F.lit(1)), F.sum("__rows")).collect()]
    rows = sum(r[2] for r in histogram)
    table = []
    for bytes_, runs in schedule(sorted(((b, n) for b, n, _ in histogram), reverse=True), shards):
        first, begun = 0, []
        for shard, n in runs:
            begun.append((first, shard))
            first += n
        table.append((bytes_, begun))
    places = spark.createDataFrame(table, "__b bigint, __runs array<struct<first:bigint,shard:int>>")
    numbered = ranked(groups, ["__bytes"], [F.col("__g")], F.col("__g"), "__nth", sum(r[1] for r in histogram))
    run = F.element_at(F.filter("__runs", lambda r: r.first <= F.col("__nth")), -1)
    shard = numbered.join(places, F.col("__bytes") == F.col("__b")).select("__g", run["shard"].alias("shard"))
    placed = staged(df.join(shard, F.col("__group") == F.col("__g")).select(*cols, "shard"), "placed")
    return ranked(placed, ["shard"], [F.col(c) for c in order or cols], F.struct(*cols), "slot", rows)


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards near equal in bytes; equal texts share a shard. The narrow table of sizes is staged, so texts are read once."""
    text = F.col(text_col)
    data = F.coalesce(text, F.lit("")).cast("binary")
    narrow = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(text.isNotNull(), F.sha2(data, 256)).alias("text_sha256"),
    )
    return shard_rows(staged(narrow, "sizes"), shards, ["text_sha256"], "size", order=("id", "text_sha256"))

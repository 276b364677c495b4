"""Work that depends on the order of a key's rows, without gathering a key in memory or sending a hot key to one task where the work can be divided.

- numbered(): ranks from ranges. Rows are dealt by ranges of (keys, order), so a hot key spans many tasks; each range is numbered on its own and starts where the ones before end.
- folded(): for work that is sequential by nature. Each task streams through its sorted rows with the small state of one key at a time.
- carried(): running sums and the row before. Each range is summed up where it lies, the sums are scanned, and each range goes on from what the ones before hand over.
- over_span(): sums over the time behind each row, as running sums of what comes in and what runs out.
- combined(): for work whose steps combine (a monoid): each range is reduced where it lies, and only one row for each key and range is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.sources.scratch import staged


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """Add name: the rows of each key (of all, without keys) numbered from first in order; equal rows are numbered in any order."""
    cell = "__cell"
    placed = staged(df.repartitionByRange(*keys, *order).withColumn(cell, F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as there are keys and ranges that meet
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(cell) == F.col("__c"))
    out = placed.withColumn("__nth", nth).join(starts, on)
    return out.select(*df.columns, (F.col("__start") + F.col("__nth") - 1 + first).cast("long").alias(name))


def carried(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """Add the running sum of each expression in sums, own row included, and the value that each expression in before had in the row before (null for a key's first), by each key's rows in order.

    The order must be total. A hot key spans many tasks: of each range only its sums and its last row's values are gathered, and the scan over them has a row for each key and range that meet.
    """
    sums, before, cell = sums or {}, before or {}, "__cell"
    held = {f"__s{i}": x for i, x in enumerate(sums.values())} | {f"__b{i}": F.struct(x.alias("v")) for i, x in enumerate(before.values())}
    placed = staged(df.withColumns(held).repartitionByRange(*keys, *order).withColumn(cell, F.spark_partition_id()), "ranges")
    at = F.struct(*order)
    parts = placed.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(len(sums))], *[F.max_by(f"__b{i}", at).alias(f"__b{i}") for i in range(len(before))])
    scan = Window.partitionBy(*keys).orderBy(cell)
    earlier = scan.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(cell).alias("__c"), *[F.sum(f"__s{i}").over(earlier).alias(f"__p{i}") for i in range(len(sums))], *[F.lag(f"__b{i}").over(scan).alias(f"__l{i}") for i in range(len(before))])
    own = Window.partitionBy(*keys, cell).orderBy(*order)
    rows = placed.withColumns({f"__r{i}": F.sum(f"__s{i}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for i in range(len(sums))} | {f"__m{i}": F.lag(f"__b{i}").over(own) for i in range(len(before))})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(cell) == F.col("__c"))
    run = [(F.coalesce(f"__r{i}", F.lit(0)) + F.coalesce(f"__p{i}", F.lit(0))).alias(name) for i, name in enumerate(sums)]
    last = [F.coalesce(f"__m{i}", f"__l{i}")["v"].alias(name) for i, name in enumerate(before)]
    return rows.join(carry, on).select(*df.columns, *run, *last)


def over_span(df: DataFrame, keys: list[str], at: str, span: int, amount: Column, name: str) -> DataFrame:
    """Add name: the sum of amount over the rows of a key whose at lies from span before to the row's own, its equals included. at is a whole number.

    What comes in at a time runs out right behind span later, so the sum is a running one over both, exact in decimals; a hot key spans many tasks.
    """
    exact = F.sum(amount.cast("decimal(28,9)"))
    known = [F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]
    by = df.groupBy(*known, F.col(at).alias("__at")).agg(exact.alias("__v"))
    gone = by.withColumn("__at", F.col("__at") + span + 1).withColumn("__v", -F.col("__v"))
    names = [f"__g{i}" for i in range(len(keys))]
    steps = by.withColumn("__in", F.lit(1)).unionByName(gone.withColumn("__in", F.lit(0))).groupBy(*names, "__at").agg(F.sum("__v").alias("__v"), F.max("__in").alias("__in"))
    sums_ = carried(steps, names, ["__at"], {"__sum": F.col("__v")}).where("__in = 1").select(*names, "__at", "__sum")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)], F.col(at) == F.col("__at"))
    return df.join(sums_, on, "left").select(*df.columns, F.col("__sum").cast("double").alias(name))


def folded(df: DataFrame, key: str, order: list[Column | str], columns: list[str], start: Callable[[], object], step: Callable, schema: str, close: Callable | None = None) -> DataFrame:
    """Rows that step(state, key, *columns) yields for each row of each key in order, and close(state, key) behind a key's last row.

    start makes the state of a key, which step changes; order has names, or expressions over columns. Memory holds one state and one batch of rows.
    """
    more = [c for c in order if isinstance(c, str) and c not in (key, *columns)]
    rows = df.select(key, *columns, *more).repartition(key).sortWithinPartitions(key, *order)
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        now, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            data = [batch[c].to_pylist() for c in [key, *columns]]
            for k, *values in zip(*data):
                if not begun or k != now:
                    if begun and close:
                        out += close(state, now)
                    now, state, begun = k, start(), True
                out += step(state, k, *values)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], names)
        if begun and close:
            out = list(close(state, now))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], names)

    return rows.mapInArrow(run, schema)


def combined(df: DataFrame, key: str, order: list[str], value: str, ratio: float) -> DataFrame:
    """key, n and total of the weighted sums of value over each key's rows, of which the last weighs 1, the one before ratio, and so on.

    A range of m rows with total b behind one with total a gives a * ratio**m + b, so ranges are reduced first and few rows are left of each key.
    """
    placed = staged(df.select(key, *order, value).repartitionByRange(key, *order).withColumn("__cell", F.spark_partition_id()), "ranges")
    last = F.row_number().over(Window.partitionBy(key, "__cell").orderBy(*[F.col(c).desc() for c in order])) - 1
    parts = placed.withColumn("__w", F.pow(F.lit(ratio), last)).groupBy(key, "__cell").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("__w") * F.col(value)).alias("b"))
    runs = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__cell", "m", "b"))).alias("runs"), F.sum("m").alias("n"))
    total = F.aggregate("runs", F.lit(0.0), lambda a, r: a * F.pow(F.lit(ratio), r.m) + r.b)
    return runs.select(key, "n", total.alias("total"))

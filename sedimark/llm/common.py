"""Helpers that the corpus operators share: let-bindings, hashes and distributed ranks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.sources.scratch import fresh_path, remove_on_exit, staged, unstage

__all__ = ["SPACE", "WORD", "bucketed", "hex_hash", "let", "ranked", "same", "staged", "unstage", "word_count"]

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row (Catalyst may inline a plain alias into a lambda)."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0. One pass of the regex engine and no array."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[\\x20\\x09-\\x0D]*{WORD}[\\x20\\x09-\\x0D]*", "x")).cast("long") - F.when(
        F.coalesce(text, F.lit("")).rlike(f"^{SPACE}\\z"), F.length(text)
    ).otherwise(0).cast("long")


def hex_hash(*parts: Column) -> Column:
    """A hash in hex digits that other engines can recompute: md5 of the parts joined by '|', nulls as '~'."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str, rows: int | None = None) -> DataFrame:
    """Add name: the rows of each key numbered from 0 without gaps, however many rows a key has.

    A plain window sends a key's rows to one task. Here the rows of a key are dealt over about sqrt(rows) cells by a hash
    of spread; each cell is numbered on its own and starts where the cells before it end. df must be deterministic
    (a table or a staged one), as it is read twice.
    """
    n = df.count() if rows is None else rows
    cells = max(1, round(n**0.5))
    cell = "__cell"
    df = df.withColumn(cell, F.pmod(F.xxhash64(spread), F.lit(cells)).cast("int"))
    sums = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    numbered = df.withColumn("__rn", F.row_number().over(w).cast("long") - 1)
    on = reduce(lambda a, b: a & b, [same(F.col(k), F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(cell) == F.col("__c"))
    return numbered.join(starts, on).withColumn(name, F.col("__rn") + F.col("__start")).select(*[c for c in df.columns if c != cell], name)


def bucketed(df: DataFrame, key: str, what: str, compression: str = "none") -> DataFrame:
    """Write df to the shared folder in as many buckets of key as shuffles have partitions, and read it back: what needs the rows of a key together then finds them so, without a shuffle.

    The table's name leaves the catalog at once; the files are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path, name = fresh_path(spark, what), f"sedimark_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", compression).format("parquet").saveAsTable(name)
    remove_on_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay
    return out

"""Importance resampling towards a target distribution of hashed word n-grams.

Separator newlines cut texts into lines. Each distinct line's features are counted once, wherever it stands, and multiplied by
its occurrences; n-grams that span lines are added separately, from the lines' first and last words alone. A bucket's gain is the logarithm of how much likelier
the target is to have it; a document's weight is the mean gain of its features, and documents are drawn without replacement by weight plus
Gumbel noise from a hash of their ids.

Documents meet their lines' sums by hashes of 128 bits. Lines that make up a thousandth of all lines or more, a thousand at most, are broadcast; the others
join in a shuffle, where none is hot. The gains are a table of `buckets` numbers.

Cases: a null text has no words; documents without features weigh 0; fewer than `least` words are not drawn; ties of scores go to the smaller id, nulls
first; rows that repeat are documents of their own, with equal scores; a null id hashes as ''; empty lines have no features; texts and lines of any
length count whole; an empty table gives an empty result, and an empty target has 0 in all buckets; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.ordered import numbered

from .blocks import starts, sums
from .common import staged

#: Lower-cases A-Z and turns what no word holds into spaces; words are runs of the bytes of ASCII digits and letters and of all other characters.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Features whose bucket a worker remembers at most.
REMEMBERED = 1_000_000
#: A line that makes up 1 / HEAVY of all is joined by broadcast; there are at most HEAVY of them.
HEAVY = 1000


@dataclass(frozen=True)
class Resample:
    """Features are all runs of low to high consecutive words; of the documents with at least `least` words, percent are drawn."""

    low: int = 1
    high: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    least: int = 20
    percent: int = 10


class Buckets(dict):
    """Bucket of a feature: its CRC-32 modulo the number of buckets."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def line_features(words: list[bytes], plan: Resample) -> list[bytes]:
    out: list[bytes] = []
    for n in range(plan.low, plan.high + 1):
        out += words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def cross_features(lines: list[bytes], plan: Resample) -> list[bytes]:
    """The n-grams of a text that span lines. Of a long line only the first and the last high - 1 words can be in one."""
    edge = plan.high - 1
    words: list[tuple[bytes | None, int]] = []
    for k, line in enumerate(lines):
        own = line.translate(WORDS).split()
        if len(own) > 2 * edge:
            words += [*[(w, k) for w in own[:edge]], (None, k), *[(w, k) for w in own[-edge:]]]
        else:
            words += [(w, k) for w in own]
    out = []
    for n in range(max(2, plan.low), plan.high + 1):
        for i in range(len(words) - n + 1):
            run = words[i : i + n]
            if run[0][1] != run[-1][1] and all(w is not None for w, _ in run):
                out.append(b" ".join(w for w, _ in run))
    return out


def _coded(features: list[list[int]]) -> pa.Array:
    return pa.array([np.array(f, "<u4").tobytes() for f in features], pa.binary())


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and the bounds of each row."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in column), np.int64, len(column)) // 4
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), "<u4"), starts(sizes)


def _marks(line) -> list:
    """128 bits of hash of a line."""
    return [F.xxhash64(line), F.xxhash64(F.lit("2"), line)]


def distinct_lines(df: DataFrame, text_col: str, plan: Resample) -> DataFrame:
    """h1, h2, times, n (features), words and codes of each distinct line. Equal lines are counted before they are shuffled."""
    lines = df.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(plan.buckets)
        for batch in batches:
            words = [line.as_buffer().to_pybytes().translate(WORDS).split() for line in batch["line"]]
            found = [[bucket[f] for f in line_features(w, plan)] for w in words]
            sizes = [pa.array([len(x) for x in column], pa.int64()) for column in (found, words)]
            yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], batch["times"], *sizes, _coded(found)], ["h1", "h2", "times", "n", "words", "codes"])

    h1, h2 = _marks(F.col("line"))
    return lines.select(h1.alias("h1"), h2.alias("h2"), "line", "times").mapInArrow(run, "h1 bigint, h2 bigint, times bigint, n bigint, words bigint, codes binary")


def placed_documents(df: DataFrame, id_col: str, text_col: str, plan: Resample) -> DataFrame:
    """row, id, the marks of its lines and the codes of its n-grams that span lines."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    if plan.high < 2:
        rows = rows.withColumn("codes", F.lit(None).cast("binary"))
    else:
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket = Buckets(plan.buckets)
            for batch in batches:
                found = [[bucket[f] for f in cross_features(t.as_buffer().to_pybytes().split(b"\n"), plan)] for t in batch["text"]]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], batch["row"], _coded(found)], ["id", "text", "row", "codes"])

        rows = rows.mapInArrow(run, f"id {kind}, text string, row bigint, codes binary")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return rows.select("row", "id", F.transform(lines, lambda x: F.struct(*[h.alias(n) for n, h in zip(("h1", "h2"), _marks(x))])).alias("marks"), "codes")


def totals(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket and n over rows of times and codes: each task's sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            codes, bounds = _codes(batch["codes"])
            total += np.bincount(codes, np.repeat(batch["times"].to_numpy(), np.diff(bounds)), buckets).astype(np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], ["bucket", "n"])

    return rows.select("times", "codes").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _summed(rows: DataFrame, keep: list[str], gains: np.ndarray) -> DataFrame:
    """The columns of keep and gain, the sum of the gains of a row's codes."""
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = _codes(batch["codes"])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(sums(gains[codes], bounds), pa.int64())], [*keep, "gain"])

    return rows.select(*keep, "codes").mapInArrow(run, ", ".join([*kinds, "gain bigint"]))


def gains_of(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the logarithm of the target's smoothed share of each bucket against that of the documents, floored."""
    s, t = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((raw.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, plan: Resample = Resample(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_features, words and weight of each document. target: a table with texts of the target distribution in target_col."""
    lines = staged(distinct_lines(docs, text_col, plan), "lines", "zstd")
    placed = staged(placed_documents(docs, id_col, text_col, plan), "placed")
    once = F.lit(1).cast("bigint").alias("times")

    def counted(lines: DataFrame, crossing: DataFrame | None) -> dict[int, int]:
        rows = lines.select("times", "codes")
        if plan.high > 1:
            rows = rows.unionByName(crossing.select(once, "codes"))
        return {r.bucket: r.n for r in totals(rows, plan.buckets).collect()}  # at most as many rows as buckets

    of_target = counted(distinct_lines(target, target_col, plan), placed_documents(target, target_col, target_col, plan) if plan.high > 1 else None)
    gains = gains_of(counted(lines, placed), of_target, plan.buckets)
    known = _summed(lines, ["h1", "h2", "times", "n", "words"], gains)
    heavy_at = max(1, lines.agg(F.sum("times")).first()[0] or 0) / HEAVY
    marks = placed.select("row", "id", F.explode("marks").alias("m")).select("row", "id", "m.*")
    values = ["n", "words", "gain"]
    light = known.filter(F.col("times") < heavy_at).select("h1", "h2", *values)
    heavy = known.filter(F.col("times") >= heavy_at).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), *values)
    met = marks.join(F.broadcast(heavy), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")  # at most HEAVY lines
    of_heavy = met.filter("k1 IS NOT NULL").select("row", "id", *values)
    of_light = met.filter("k1 IS NULL").select("row", "id", "h1", "h2").join(light, ["h1", "h2"]).select("row", "id", *values)
    size = F.coalesce(F.octet_length("codes"), F.lit(0)) / 4
    crossing = _summed(placed.withColumn("n", size.cast("bigint")).withColumn("words", F.lit(0).cast("bigint")), ["row", "id", "n", "words"], gains)
    sums_ = of_heavy.unionByName(of_light).unionByName(crossing).groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in values])
    return sums_.select("id", F.col("n").alias("n_features"), "words", F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(0).cast("bigint").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, plan: Resample = Resample(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank of each document; rank numbers the drawn from 1 and is null for the others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = staged(weigh(docs, target, plan, id_col, text_col, target_col).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("words") >= plan.least
    drawn = scored.filter(fit).count() * plan.percent // 100
    ranks = numbered(scored.filter(fit), [], [F.col("score").desc(), F.col("id").asc_nulls_first()], "rank", 1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank")
    columns = ["id", "n_features", "weight", "score"]
    return ranks.select(*columns, rank).unionByName(scored.filter(~fit).select(*columns, F.lit(None).cast("bigint").alias("rank")))

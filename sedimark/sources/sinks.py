"""Stores that are only added to: ingested sources, overrides, content-addressed tables, caches and reports; and the bundles, packages and ledgers that are read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import blocks as B
from sedimark.operators import checks as C
from sedimark.operators import versions as V
from sedimark.sources.scratch import staged, unstage

# Members of a package at most, bytes of one and of all.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_PACKAGE_BYTES = 4096, 64 << 20, 256 << 20
# Fields that an override may set, and the states of a review.
OVERRIDE_FIELDS = ("kind", "content", "conditions", "exceptions", "confidence", "review_status", "source_refs")
STATUSES = ("candidate", "reviewed", "approved", "rejected", "superseded")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class SourceStore:
    """Sources by id and version under a path: manifests (source_id, version, content_sha256, ...) and blocks (source_id, version, block_ord, ...). A version is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ingest(self, manifests: DataFrame, blocks: DataFrame) -> int:
        """Add the versions that are not there and return how many they are. A version that is there with the same hash is left alone; with another hash the whole call is refused.

        Blocks are written before the manifests that make them visible, so a lost job leaves no half a source.
        """
        key = ["source_id", "version"]
        fresh = manifests
        if _exists(self.spark, f"{self.path}/manifests"):
            there = self.manifests().select(*key, F.col("content_sha256").alias("__old"))
            both = manifests.join(there, key)
            if both.where("content_sha256 <> __old").limit(1).count():
                raise ValueError("a version of a source is there with other content")
            fresh = manifests.join(there, key, "left_anti")
        fresh = staged(fresh, "manifests")
        n = fresh.count()
        if n:
            blocks.join(fresh.select(*key), key, "left_semi").write.mode("append").parquet(f"{self.path}/blocks")
            fresh.write.mode("append").parquet(f"{self.path}/manifests")
        unstage(fresh)
        return n

    def manifests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifests")

    def blocks(self) -> DataFrame:
        """The blocks of ingested versions, once each: those that a lost job has left without a manifest, or a repeated one has written again, do not count."""
        rows = self.spark.read.parquet(f"{self.path}/blocks")
        return rows.join(self.manifests().select("source_id", "version"), ["source_id", "version"], "left_semi").dropDuplicates(["source_id", "version", "block_ord"])

    def versions(self, source_id: str) -> DataFrame:
        return self.manifests().where(F.col("source_id") == source_id).select("version").distinct().orderBy("version")


def override_violations(overrides: DataFrame) -> DataFrame:
    """(override_id, rule) of overrides (override_id, field, value: JSON) whose field is unknown or whose value is not of the field's kind."""
    v = F.col("value")
    number = v.try_cast("double")
    text, items = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.from_json(v, "array<string>")
    rule = F.when(~F.col("field").isin(*OVERRIDE_FIELDS), "field")
    rule = rule.when((F.col("field") == "confidence") & (v != "null") & ~F.coalesce(number.between(0, 1), F.lit(False)), "confidence")
    rule = rule.when((F.col("field") == "review_status") & ~F.coalesce(text[0].isin(*STATUSES), F.lit(False)), "review_status")
    rule = rule.when(F.col("field").isin("kind", "content") & (~v.rlike('^".+"$')), "text").when(F.col("field").isin("conditions", "exceptions", "source_refs") & (items.isNull() | ~v.startswith("[")), "list")
    return overrides.select("override_id", rule.alias("rule")).where("rule is not null")


class OverrideLog:
    """A log of overrides (override_id, unit_id, field, value, created_at, superseded)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Add overrides; any that breaks its field's rule refuses them all."""
        if override_violations(rows).limit(1).count():
            raise ValueError("an override breaks its field's rule")
        rows.write.mode("append").parquet(self.path)

    def supersede(self, override_id: str) -> None:
        """Add a copy that is marked as superseded, at the time of the original."""
        rows = self.read().where(F.col("override_id") == override_id).orderBy("created_at").limit(1).withColumn("superseded", F.lit(True))
        rows = staged(rows, "superseded")
        rows.write.mode("append").parquet(self.path)
        unstage(rows)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def active(self) -> DataFrame:
        return V.standing_overrides(self.read())


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows as a multiset: their canonical JSON is hashed, the hashes in order are hashed in 256 groups by their first digits, and those groups' digests once more."""
    rows = df.select(F.sha2(B.canonical_json(df), 256).alias("h")).withColumn("g", F.left("h", F.lit(2)))
    groups = B.joined_digests(rows, "g", "h", "\n").select(F.lit("all").alias("k"), F.concat("g", F.lit(":"), "digest").alias("d"))
    found = B.joined_digests(groups, "k", "d", "\n").first()
    return found["digest"] if found else "0" * 64


def write_addressed(df: DataFrame, path: str) -> str:
    """Write df under the name of its content's digest, unless it is there, and return the name."""
    df = staged(df, "addressed")
    name = table_digest(df)
    if not _exists(df.sparkSession, f"{path}/{name}/_SUCCESS"):
        df.write.mode("overwrite").parquet(f"{path}/{name}")  # whatever is there without a mark of success is half a table
    unstage(df)
    return name


def read_addressed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table of that name; raises ValueError if its content has another digest."""
    df = spark.read.parquet(f"{path}/{name}")
    if table_digest(df) != name:
        raise ValueError("the content does not have the digest it is named after")
    return df


def cached(requests: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests (identity columns) with result: from the cache at path where the digest of a request's canonical JSON is there, else from compute (which adds result to requests), whose rows the cache then keeps."""
    spark = requests.sparkSession
    keyed = staged(requests.withColumn("cache_key", F.sha2(B.canonical_json(requests), 256)), "requests")
    if _exists(spark, path):
        known = spark.read.parquet(path).select("cache_key", "result").dropDuplicates(["cache_key"])
        missing = keyed.join(known, "cache_key", "left_anti")
    else:
        missing = keyed
    missing.dropDuplicates(["cache_key"]).transform(compute).select("cache_key", "result").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["cache_key"]), "cache_key").drop("cache_key")


def write_report(checks: DataFrame, path: str) -> None:
    """The checks (check_id, status, ...) of a report as JSON lines and, beside them, as a Markdown table: a row for each check, so one small file each."""
    rows = checks.orderBy("check_id").coalesce(1)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in checks.columns]), F.lit(" |"))
    head = checks.sparkSession.createDataFrame([(0, f"| {' | '.join(checks.columns)} |"), (1, "|" + "---|" * len(checks.columns))], "n int, value string")
    body = rows.select(F.lit(2).alias("n"), line.alias("value"))
    head.unionByName(body).orderBy("n", "value").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/md")


def read_bundle(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """The candidate units of bundles (JSON files with an array candidate_units of structs with the fields of unit), in order (ord); none at all is an error."""
    rows = spark.read.schema(f"collection_id string, candidate_units array<struct<{unit}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    units = rows.select("collection_id", F.posexplode("candidate_units").alias("ord", "u")).select("collection_id", F.col("ord").cast("long").alias("ord"), "u.*")
    if not units.limit(1).count():
        raise ValueError("no candidate units")
    return units


def package_members(packages: DataFrame) -> DataFrame:
    """path, member, size, sha256 and error of the members of zip packages (path, content).

    Errors: unsafe (see checks.safe_member), link, too_large; and, for all of a package, damaged, too_many and package_too_large, which come without a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                out: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        files = [i for i in z.infolist() if not i.is_dir()]
                        whole = "too_many" if len(files) > MAX_MEMBERS else "package_too_large" if sum(i.file_size for i in files) > MAX_PACKAGE_BYTES else None
                        for i in files:
                            error = whole or ("link" if i.external_attr >> 28 == 0xA else "too_large" if i.file_size > MAX_MEMBER_BYTES else None)
                            out.append((i.filename, i.file_size, None if error else hashlib.sha256(z.read(i)).hexdigest(), error))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
                    out = [(None, None, None, "damaged")]
                columns = [pa.array([path] * len(out), pa.string()), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]]
                yield pa.RecordBatch.from_arrays(columns, ["path", "member", "size", "sha256", "error"])

    rows = packages.select("path", "content").mapInArrow(run, "path string, member string, size bigint, sha256 string, error string")
    unsafe = F.when(F.col("member").isNotNull() & ~C.safe_member(F.col("member")), "unsafe")
    return rows.withColumn("error", F.coalesce("error", unsafe))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """path, source_id and sha256 of ledgers: lists whose items have a line source_id and, before the next item, perhaps a line content_sha256. A file is read as a whole, as its lines belong together."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    items = F.filter(F.split("value", r"(?m)^\s*-\s+(?=source_id\s*:)"), lambda x: x.rlike(r"^source_id\s*:"))
    field = lambda x, name: F.nullif(F.regexp_extract(x, rf"(?m)^\s*{name}\s*:\s*[\"']?([^\s\"'#]+)", 1), F.lit(""))
    return text.select("path", F.explode(items).alias("x")).select("path", field(F.col("x"), "source_id").alias("source_id"), field(F.col("x"), "content_sha256").alias("sha256"))

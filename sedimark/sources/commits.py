"""A numbered commit log in a shared folder, and tables whose rows become visible by it.

Every commit is one small file named by its number. It is written beside the log and then put under its number by an operation that fails if the number is taken
(a hard link on a local disk, a rename on stores that never replace by one, such as HDFS), so of two writers one gets the number and the other sees the new tail, checks
its base again, and takes the next number or refuses. Nothing is locked and nothing is overwritten.

Rows are written in full before their commit. A job that is killed in between leaves files that no commit names and no reader sees; vacuum() removes them by age.
Stores on which a rename replaces (plain object stores) need a committer of their own and are refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators.ordered import numbered

ENTRY = "seq bigint, action string, skill string, name string, id string, first bigint, rows bigint, base bigint"
#: Schemes whose rename to a name that is taken fails.
RENAMES = ("hdfs", "viewfs", "abfs", "abfss")


class Conflict(ValueError):
    """The base that a commit rests on is no longer the newest."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/log")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def latest(self) -> int:
        """The number of the newest commit, 0 without any."""
        names = self._names()
        return int(names[-1].split(".")[0]) if names else 0

    def entries(self, version: int | None = None) -> DataFrame:
        """The commits up to a version, one row each."""
        upto = self.latest() if version is None else version
        paths = [f"{self.path}/log/{n}" for n in self._names() if int(n.split(".")[0]) <= upto]
        return self.spark.read.schema(ENTRY).json(paths) if paths else self.spark.createDataFrame([], ENTRY)

    def tail(self) -> dict:
        """The newest commit itself, read on the driver; {} without any."""
        names = self._names()
        if not names:
            return {}
        fs, p = self._fs(f"{self.path}/log/{names[-1]}")
        stream = fs.open(p)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(data)

    def _create(self, seq: int, entry: dict) -> bool:
        """Whether the commit got its number."""
        fs, folder = self._fs(f"{self.path}/log")
        fs.mkdirs(folder)
        _, ready = self._fs(f"{self.path}/log/_{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/log/{seq:020d}.json")
        out = fs.create(ready, False)
        try:
            out.write(bytearray((json.dumps(entry) + "\n").encode()))
        finally:
            out.close()
        scheme = fs.getUri().getScheme()
        try:
            if scheme == "file":
                jvm = self.spark.sparkContext._jvm
                place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    jvm.java.nio.file.Files.createLink(place(final), place(ready))
                    return True
                except Exception as e:  # py4j wraps the exception of the JVM
                    if "FileAlreadyExistsException" in str(e):
                        return False
                    raise
            if scheme not in RENAMES:
                raise ValueError(f"{scheme}: a rename may replace what is there")
            return bool(fs.rename(ready, final))
        finally:
            fs.delete(ready, False)

    def commit(self, entry: dict, base: int | None = None) -> int:
        """Append entry and return its number. Its `first` is where its rows start, behind those of all commits before.

        base: the newest commit of the entry's skill that the writer knows of (0: none). If there is a newer one, also one that has come while this commit was
        tried, Conflict is raised; commits of other skills do not matter.
        """
        while True:
            seq = self.latest()
            tail = self.tail() if seq else {}
            if tail and tail["seq"] != seq:
                continue  # another commit has come in between
            if base is not None and (newest := self.newest(entry.get("skill"), seq)) != base:
                raise Conflict(f"{entry.get('skill')}: base {base}, but the newest commit is {newest}")
            first = tail.get("first", 0) + tail.get("rows", 0)
            if self._create(seq + 1, {"rows": 0, **entry, "seq": seq + 1, "first": first, "base": base}):
                return seq + 1

    def newest(self, skill: str | None, version: int | None = None) -> int:
        """The number of the newest publication or rollback of a skill up to a version, 0 without any."""
        found = self.entries(version).where(F.col("action").isin("publish", "rollback") & F.col("skill").eqNullSafe(F.lit(skill)))
        return found.agg(F.max("seq")).first()[0] or 0

    def index(self, version: int | None = None) -> DataFrame:
        """skill, name and seq of what each skill points to: the log's newest publication or rollback of each."""
        moves = self.entries(version).where(F.col("action").isin("publish", "rollback"))
        return moves.groupBy("skill").agg(F.max(F.struct("seq", "name")).alias("m")).select("skill", "m.name", "m.seq")


class CommittedTable:
    """Rows appended by commits: each has a record number without gaps over all commits, and any version can be read again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def append(self, rows: DataFrame, order: list[str], skill: str | None = None, base: int | None = None) -> int:
        """Write rows, numbered in order, and commit them; return the version."""
        return self.log.commit(self.write(rows, order) | {"skill": skill}, base)

    def write(self, rows: DataFrame, order: list[str]) -> dict:
        """Write rows in full without a commit; return the entry that makes them visible."""
        id_ = uuid.uuid4().hex
        path = f"{self.path}/data/{id_}"
        numbered(rows, [], order, "__nth").withColumn("__id", F.lit(id_)).write.parquet(path)
        return {"action": "append", "id": id_, "rows": self.spark.read.parquet(path).count()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest without one) with commit, the version they came with, and record_no."""
        entries = self.log.entries(version).where("action = 'append'").select(F.col("id").alias("__of"), F.col("seq").alias("commit"), "first")
        ids = [r[0] for r in entries.select("__of").collect()]  # one for each commit
        if not ids:
            raise ValueError(f"{self.path}: no rows at version {version}")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/data/{i}" for i in ids])
        plain = [c for c in rows.columns if not c.startswith("__")]
        return rows.join(entries, F.col("__id") == F.col("__of")).select(*plain, "commit", (F.col("first") + F.col("__nth")).alias("record_no"))

    def vacuum(self, seconds: int) -> int:
        """Remove files of at least that age that no commit names; return how many folders went."""
        fs, p = self.log._fs(f"{self.path}/data")
        known = {r[0] for r in self.log.entries().select("id").collect()}
        now, gone = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in known and now - s.getModificationTime() >= seconds * 1000:
                gone += bool(fs.delete(s.getPath(), True))
        return gone

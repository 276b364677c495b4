"""Sinks: an append-only versioned unit store with immutable releases and a pointer.

A store is a folder: units/ holds Parquet files that are only appended to, releases/<name>/ holds frozen views, and pointer/ holds a commit log with one entry per
publication, of which the newest counts. Publishing writes a new release in full before the log grows; rolling back adds an entry too. Of two writers at once each gets a number of its own.
Nothing is rewritten in place, so a job that is lost halfway leaves no reader with half a release.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import versions as V
from sedimark.sources.commits import CommitLog
from sedimark.sources.scratch import staged, unstage


class UnitStore:
    """Versions of units (unit_id, record_version, ord, ...) under a path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, f"{path.rstrip('/')}/pointer")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/units")

    def append_if_new(self, rows: DataFrame) -> int:
        """Append those rows of which the store has no equal one, in all columns, each once, and return how many they were."""
        print_ = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        fresh = rows.withColumn("__print", print_(rows)).dropDuplicates(["__print"])
        if self._exists("units"):
            known = self.versions()
            fresh = fresh.join(known.select(print_(known).alias("__print")), "__print", "left_anti")
        fresh = staged(fresh.drop("__print"), "fresh")
        n = fresh.count()
        if n:
            self.append(fresh)
        unstage(fresh)
        return n

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/units")

    def current(self) -> DataFrame:
        return V.current_view(self.versions())

    def publish(self, name: str, skill: str | None = None, base: int | None = None) -> int:
        """Freeze the active view as a release, point to it, and return the publication's number. A release is never overwritten: publishing the same rows again only points, other rows under its name are an error.

        base: the skill's newest publication that the release rests on; Conflict is raised if there is a newer one.
        """
        view = V.active_view(self.versions())
        if self._exists(f"releases/{name}"):
            there = self.spark.read.parquet(f"{self.path}/releases/{name}")
            view = view.select(*there.columns)
            if view.exceptAll(there).limit(1).count() or there.exceptAll(view).limit(1).count():
                raise ValueError(f"release {name} has other rows")
        else:
            view.write.mode("error").parquet(f"{self.path}/releases/{name}")
        return self.log.commit({"action": "publish", "name": name, "skill": skill}, base)

    def rollback(self, name: str, skill: str | None = None, base: int | None = None) -> int:
        """Point to a release that is there already."""
        self.spark.read.parquet(f"{self.path}/releases/{name}").limit(1).count()
        return self.log.commit({"action": "rollback", "name": name, "skill": skill}, base)

    def history(self) -> DataFrame:
        return self.log.entries().select("seq", "name", "action", "skill")

    def released(self, skill: str | None = None) -> DataFrame:
        """The release that the newest publication or rollback names, of a skill if one is given."""
        moves = self.history().where(F.lit(True) if skill is None else F.col("skill") == skill)
        name = moves.orderBy(F.col("seq").desc()).first()["name"]
        return self.spark.read.parquet(f"{self.path}/releases/{name}")

    def index(self) -> DataFrame:
        """skill, name and seq of the release of each skill, derived from the log."""
        return self.log.index()

    def _exists(self, part: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_references(units: DataFrame, path: str) -> None:
    """A text file part per kind with one line per unit: the unit's id, its source and block, and its content."""
    line = F.concat(F.lit("- "), "source_id", F.lit(" / "), "block_id", F.lit(' — "'), "content", F.lit('"'))
    units.select("kind", line.alias("value")).write.partitionBy("kind").text(path)

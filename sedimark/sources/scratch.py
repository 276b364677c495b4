"""Tables in the folder that all executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, an own folder of a local session (tests); on a cluster executors would not share one, so it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark.sparkContext, "_sedimark_scratch", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="sedimark-")
            spark.sparkContext._sedimark_scratch = path
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/sedimark/{what}-{uuid.uuid4().hex}"


def remove_on_exit(spark: SparkSession, path: str) -> None:
    """Let what has been written to path be removed when the driver's JVM ends."""
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def staged(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back.

    The table is removed when the driver's JVM ends, or earlier by unstage().
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    remove_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sedimark_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_sedimark_path", None):
            fs, p = _fs(t.sparkSession, path)
            fs.delete(p, True)

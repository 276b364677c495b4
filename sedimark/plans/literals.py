"""Small fixed tables that queries and their SQL share, for cases that the driver's tables lack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return repr(v)


@dataclass(frozen=True)
class Rows:
    """schema: Spark's column list; rows: tuples."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        """A SELECT of the rows in SQL."""
        columns = [part.split(" ", 1) for part in self.schema.split(", ")]
        names = ", ".join(c for c, _ in columns)
        values = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in self.rows)
        return f"SELECT {', '.join(f'{c}::{KINDS[k]} AS {c}' for c, k in columns)} FROM (VALUES {values}) AS v({names})"

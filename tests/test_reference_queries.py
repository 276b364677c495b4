"""Every query with SQL against DuckDB, at the smallest scale."""

import importlib.util
import math

import duckdb
import pytest

from __spark_entry__ import PLANS

QUERIES, ORACLES = ({k: v for plan in PLANS for k, v in getattr(plan, name).items()} for name in ("QUERIES", "ORACLES"))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    kinds = {c[0]: str(c[1]) for c in got.description}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert plain(df.select(*cols).collect()) == plain([[r[names.index(c)] for c in cols] for r in got.fetchall()])


def test_entry_names(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names and set(entry.oracle_sql()) <= names
    assert ("pipeline" in names) == bool(importlib.util.find_spec("sedimark.llm") and importlib.util.find_spec("sedimark.llm.queries"))
    assert entry.entry(spark).count() > 0

"""Stores that are only added to, and what is read back from them."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimark.sources import sinks


def test_sources_are_written_once(spark, tmp_path):
    store = sinks.SourceStore(spark, f"file://{tmp_path}/sources")
    manifests = lambda *rows: spark.createDataFrame(rows, "source_id string, version bigint, content_sha256 string")
    blocks = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 1, 1, "z"), ("c", 1, 1, "w")], "source_id string, version bigint, block_ord bigint, text string")
    assert store.ingest(manifests(("a", 1, "h1"), ("b", 1, "h2")), blocks) == 2
    assert store.ingest(manifests(("a", 1, "h1"), ("a", 2, "h3")), blocks) == 1
    assert store.ingest(manifests(("a", 1, "h1")), blocks) == 0
    with pytest.raises(ValueError):
        store.ingest(manifests(("c", 1, "h"), ("b", 1, "other")), blocks)
    assert {(r.source_id, r.version, r.text) for r in store.blocks().collect()} == {("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")}
    assert [r.version for r in store.versions("a").collect()] == [1, 2]


def test_override_log(spark, tmp_path):
    log = sinks.OverrideLog(spark, f"file://{tmp_path}/log")
    rows = lambda *r: spark.createDataFrame(r, "override_id string, unit_id string, field string, value string, created_at bigint, superseded boolean")
    log.append(rows(("o1", "u", "kind", '"term"', 1, False), ("o2", "u", "kind", '"case"', 2, False), ("o3", "u", "conditions", '["x"]', 1, False), ("o4", "u", "confidence", "0.4", 1, False)))
    assert {r.override_id for r in log.active().collect()} == {"o2", "o3", "o4"}
    log.supersede("o2")
    assert {r.override_id for r in log.active().collect()} == {"o1", "o3", "o4"}
    assert log.read().where("superseded").first().created_at == 2
    bad = rows(("b1", "u", "colour", '"red"', 1, False), ("b2", "u", "confidence", "1.5", 1, False), ("b3", "u", "review_status", '"new"', 1, False), ("b4", "u", "kind", "3", 1, False), ("b5", "u", "exceptions", '"x"', 1, False), ("ok", "u", "confidence", "null", 1, False))
    assert {(r.override_id, r.rule) for r in sinks.override_violations(bad).collect()} == {("b1", "field"), ("b2", "confidence"), ("b3", "review_status"), ("b4", "text"), ("b5", "list")}
    with pytest.raises(ValueError):
        log.append(bad)


def test_addressed_tables(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    name = sinks.write_addressed(df, f"file://{tmp_path}/t")
    assert sinks.write_addressed(df.repartition(5), f"file://{tmp_path}/t") == name != sinks.table_digest(df.where("id > 0"))
    assert sinks.read_addressed(spark, f"file://{tmp_path}/t", name).count() == 1000
    df.limit(3).write.mode("append").parquet(f"file://{tmp_path}/t/{name}")
    with pytest.raises(ValueError):
        sinks.read_addressed(spark, f"file://{tmp_path}/t", name)
    assert sinks.table_digest(df.limit(0)) == "0" * 64


def test_cache_computes_what_is_missing(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(sorted(r.q for r in df.collect()))
        return df.withColumn("result", F.upper("q"))

    ask = lambda *qs: {r.q: r.result for r in sinks.cached(spark.createDataFrame([(q,) for q in qs], "q string"), f"file://{tmp_path}/cache", compute).collect()}
    assert ask("a", "b", "a") == {"a": "A", "b": "B"} and ask("b", "c") == {"b": "B", "c": "C"}
    assert asked == [["a", "b"], ["c"]]


def test_report_twins(spark, tmp_path):
    checks = spark.createDataFrame([("budget", "warn", None), ("a", "pass", 1)], "check_id string, status string, n bigint")
    sinks.write_report(checks, f"file://{tmp_path}/r")
    assert {(r.check_id, r.n) for r in spark.read.json(f"{tmp_path}/r/json").collect()} == {("budget", None), ("a", 1)}
    assert [r.value for r in spark.read.text(f"{tmp_path}/r/md").collect()] == ["| check_id | status | n |", "|---|---|---|", "| a | pass | 1 |", "| budget | warn |  |"]


def test_bundles_packages_and_ledgers(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"collection_id": "c", "candidate_units": [{"unit_id": "u1", "kind": "term"}, {"unit_id": "u2", "kind": None}]}, indent=1))
    assert [(r.ord, r.unit_id, r.kind) for r in sinks.read_bundle(spark, f"{tmp_path}/b.json", "unit_id: string, kind: string").orderBy("ord").collect()] == [(0, "u1", "term"), (1, "u2", None)]
    (tmp_path / "e.json").write_text('{"collection_id": "c", "candidate_units": []}')
    with pytest.raises(ValueError):
        sinks.read_bundle(spark, f"{tmp_path}/e.json", "unit_id: string")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ok/a.txt", "text")
        z.writestr("../up.txt", "x")
        link = zipfile.ZipInfo("ln")
        link.external_attr = 0xA1FF << 16
        z.writestr(link, "target")
    got = sinks.package_members(spark.createDataFrame([("p", bytearray(out.getvalue())), ("q", bytearray(b"no zip"))], "path string, content binary")).collect()
    assert {(r.path, r.member, r.error) for r in got} == {("p", "ok/a.txt", None), ("p", "../up.txt", "unsafe"), ("p", "ln", "link"), ("q", None, "damaged")}
    (tmp_path / "provenance.yml").write_text("version: 1\nsources:\n  - source_id: 'abc'\n    content_sha256: \"ff00\"\n  - source_id: def\n    note: x\n")
    assert {(r.source_id, r.sha256) for r in sinks.read_ledger(spark, f"{tmp_path}/provenance.yml").collect()} == {("abc", "ff00"), ("def", None)}

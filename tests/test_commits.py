"""Commits by several writers: no number twice, no publication lost, nothing visible before its commit."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from sedimark.sources.commits import CommitLog, CommittedTable, Conflict
from sedimark.sources.store import UnitStore


def test_racing_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    work = lambda who: [CommitLog(spark, path).commit({"action": "publish", "skill": who, "name": f"{who}{k}", "rows": 2}) for k in range(6)]
    with ThreadPoolExecutor(4) as pool:
        taken = [n for part in pool.map(work, "abcd") for n in part]
    log = CommitLog(spark, path)
    rows = log.entries().collect()
    assert sorted(taken) == list(range(1, 25)) == sorted(r.seq for r in rows) and {(r.skill, r.name) for r in rows} == {(w, f"{w}{k}") for w in "abcd" for k in range(6)}
    assert sorted(r.first for r in rows) == list(range(0, 48, 2)) and {(r.skill, r.name) for r in log.index().collect()} == {(w, f"{w}5") for w in "abcd"}


def test_of_two_with_one_base_one_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    CommitLog(spark, path).commit({"action": "publish", "skill": "s", "name": "r1"}, base=0)
    CommitLog(spark, path).commit({"action": "publish", "skill": "other", "name": "x"}, base=0)

    def attempt(name):
        try:
            return CommitLog(spark, path).commit({"action": "publish", "skill": "s", "name": name}, base=1)
        except Conflict:
            return None

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(attempt, ["r2", "r3", "r4"]))
    assert sum(n is not None for n in got) == 1 and CommitLog(spark, path).latest() == 3
    with pytest.raises(Conflict):
        CommitLog(spark, path).commit({"action": "rollback", "skill": "s", "name": "r1"}, base=2)


def test_versions_and_a_writer_that_is_killed(spark, tmp_path):
    table = CommittedTable(spark, f"file://{tmp_path}/t")
    frame = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "i bigint, v string")
    with pytest.raises(ValueError):
        table.read()
    assert table.append(frame(3, 1, 2), ["i"]) == 1
    lost = table.write(frame(90, 91), ["i"])  # killed before its commit
    assert table.append(frame(7, 5).selectExpr("i", "v", "i * 2 AS more"), ["i"]) == 2
    rows = {(r.i, r.more, r.commit, r.record_no) for r in table.read().collect()}
    assert rows == {(1, None, 1, 0), (2, None, 1, 1), (3, None, 1, 2), (5, 10, 2, 3), (7, 14, 2, 4)}
    assert {r.i for r in table.read(1).collect()} == {1, 2, 3}
    assert table.vacuum(3600) == 0 and table.vacuum(0) == 1 and table.read().count() == 5
    table.log.commit(lost | {"id": "gone", "action": "other"})  # entries that are no appends have no rows
    assert table.read().count() == 5 and table.append(frame(), ["i"]) == 4 and table.read().count() == 5


def test_store_points_by_commits(spark, tmp_path):
    store = UnitStore(spark, f"file://{tmp_path}/s")
    unit = "unit_id string, record_version bigint, ord bigint, review_status string"
    store.append(spark.createDataFrame([("a", 1, 1, "approved")], unit))
    assert store.publish("r1", "x", base=0) == 1
    store.append(spark.createDataFrame([("b", 1, 2, "approved")], unit))
    assert store.publish("r2", "x", base=1) == 2 and store.publish("r2", "y", base=0) == 3
    with pytest.raises(Conflict):
        store.publish("r2", "x", base=1)
    assert store.rollback("r1", "x", base=2) == 4
    assert {(r.skill, r.name) for r in store.index().collect()} == {("x", "r1"), ("y", "r2")} and store.released("x").count() == 1 and store.released("y").count() == 2

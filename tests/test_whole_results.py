"""Queries that return the whole result of their operator, on small inputs with known results."""

from sedimark.operators import versions as V
from sedimark.plans import catalogue


def tables(spark, folder, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ordered_words_are_not_capped(spark, tmp_path):
    words = [f"w{i}" for i in range(50)]
    d = tables(spark, tmp_path, documents=([(1, " ".join(words + words[::-1]) + "\nLast"), (2, "")], "doc_id bigint, text string"))
    got = {r.doc_id: (r.n, r.words) for r in catalogue.ordered_words(spark, d).collect()}
    assert got == {1: (51, " ".join([*words, "last"])), 2: (0, "")}


UNIT = "unit_id string, kind string, content string, conditions array<string>, exceptions array<string>, confidence double, review_status string, source_refs array<struct<source_id:string>>, record_version bigint"


def unit(unit_id, content="x", conditions=(), exceptions=(), confidence=0.5, refs=()):
    return unit_id, "k", content, list(conditions), list(exceptions), confidence, "s", [(r,) for r in refs], 1


def test_diff_compares_all_fields(spark):
    old = spark.createDataFrame([unit("a"), unit("b"), unit("c"), unit("d"), unit("e")], UNIT)
    new = spark.createDataFrame([unit("a", conditions=["p"]), unit("b", exceptions=["p"]), unit("c", refs=["s"]), unit("d"), unit("e", confidence=None)], UNIT)
    got = {r.unit_id: (r.change, r.changed_fields) for r in V.diff(old, new).collect()}
    changed = {"a": "conditions", "b": "exceptions", "c": "source_refs", "e": "confidence"}
    assert got == {u: ("modified", f) for u, f in changed.items()} | {"d": ("unchanged", "")}
    assert {r.unit_id: r.record_version for r in V.supersede(old, new).collect()} == dict.fromkeys(changed, 2)


def test_merge_of_added_and_removed_units_and_sets(spark):
    base = spark.createDataFrame([unit("gone"), unit("both", conditions=["p", "q"])], UNIT)
    new = spark.createDataFrame([unit("add", "y"), unit("both", conditions=["r"], confidence=0.9)], UNIT)
    over = [("gone", "content", "z"), ("add", "content", "z"), ("both", "conditions", '["q","p"]'), ("both", "confidence", "0.50"), ("neither", "content", "z")]
    over = spark.createDataFrame(over, "unit_id string, field string, value string")

    def merged(**how):
        return {(r.unit_id, r.field, r.outcome): r.value for r in V.merge(base, new, over, **how).collect()}

    got = merged()
    assert len(got) == 7 + 7 + 2
    assert got["both", "conditions", "new"] == '["r"]' and got["both", "confidence", "new"] == "0.9"
    assert got["add", "content", "added"] == "y"
    assert {k[0]: v for k, v in got.items() if k[2] == "preserved"} == {"gone": "z", "add": "z"}
    got = merged(allow_removals=False)
    assert len(got) == 7 + 7 + 7 + 1
    assert got["gone", "content", "ours"] == "z" and got["gone", "kind", "kept"] == "k"


def test_conflicts_over_the_union(spark):
    words = "one two three four five six seven eight"
    old = spark.createDataFrame([("a", "principle", words), ("c", "principle", "other")], "unit_id string, kind string, content string")
    new = spark.createDataFrame([("b", "anti_pattern", words), ("a", "principle", "changed")], "unit_id string, kind string, content string")
    assert [{r.a, r.b} for r in V.diff_conflicts(old, new).collect()] == [{"a", "b"}]


def test_merged_units_have_all_fields(spark, tmp_path):
    d = tables(
        spark,
        tmp_path,
        documents=([(1, "one"), (2, "two"), (3, "three")], "doc_id bigint, text string"),
        labels=([(1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int"),
        pages=([(7, "<p>")], "page_id bigint, html string"),
    )
    got = {(r.unit_id, r.field): r.outcome for r in catalogue.three_way_merge(spark, d).collect()}
    want = {("d1", "kind"): "ours", ("d1", "review_status"): "conflict", ("d2", "review_status"): "preserved"}
    assert got == {(u, f): "added" if u == "p7" else "new" for u in ("d1", "d3", "p7") for f in ("kind", "content", "confidence", "review_status")} | want


def test_citations_of_all_units_and_repeated_declarations(spark, tmp_path):
    d = tables(spark, tmp_path, documents=([(1, "Do it", "en"), (2, "Do it", "en"), (3, "", "en"), (4, "Go on", "en")], "doc_id bigint, text string, lang string"), labels=([(1, 1), (2, 1), (3, 1)], "doc_id bigint, quality int"))
    got = sorted((r.code, r.severity) for r in catalogue.citation_coverage(spark, d).collect())
    assert got == [("duplicate", "fail"), ("orphan", "warn"), ("undeclared", "fail")]

"""Stored trees: changes against dictionaries, and how much a comparison reads."""

import hashlib

from sedimark.operators import trees


def test_changes_are_found_by_reading_their_folders_alone(spark, tmp_path):
    files = {f"dir/{i % 7}/f{i}.txt": hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000)}
    other = dict(files)
    other["dir/0/f7.txt"] = "changed"
    del other["dir/1/f8.txt"]
    other["neu/é.txt"] = "x"
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string").repartition(3)
    paths = {n: f"file://{tmp_path}/{n}" for n in ("a", "b", "c", "none")}
    for name, d in (("a", files), ("b", other), ("c", dict(reversed(files.items()))), ("none", {})):
        trees.write_tree(frame(d), paths[name])
    got = {(r.path, r.change) for r in trees.compare_trees(spark, paths["a"], paths["b"]).collect()}
    assert got == {("dir/0/f7.txt", "modified"), ("dir/1/f8.txt", "removed"), ("neu/é.txt", "added")}
    folders = trees.differing(spark, paths["a"], paths["b"])
    assert folders == sorted({hashlib.sha256(p.encode()).hexdigest()[:2] for p, _ in got})
    read = trees.stored_files(spark, paths["a"], "path string, sha256 string", folders)
    assert len(read.inputFiles()) <= len(folders) * 2 or read.count() <= 4000 * len(folders) / 256 * 2
    assert read.count() == sum(hashlib.sha256(p.encode()).hexdigest()[:2] in folders for p in files)
    assert trees.differing(spark, paths["a"], paths["c"]) == [] and trees.compare_trees(spark, paths["a"], paths["c"]).count() == 0
    assert len(trees.differing(spark, paths["a"], paths["none"])) == 256 and trees.compare_trees(spark, paths["none"], paths["none"]).count() == 0
    assert {r.change for r in trees.compare_trees(spark, paths["none"], paths["a"]).collect()} == {"added"}

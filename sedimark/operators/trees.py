"""Trees of files by path: a digest tree that is stored beside the files, and comparisons that read only what differs.

A path belongs to the leaf that the first hex digits of its hash name, the same in every tree, so two trees of any age can be compared. The digest of a leaf
is taken over its files in order of path, that of a node above over its children's digests, so equal trees have equal roots. Files are stored in one
folder for each node of two digits; a comparison walks down from the root through the nodes that differ and reads the folders of these alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators.blocks import joined_digests
from sedimark.operators.ordered import folded

#: Hex digits of the folders that files are stored in.
FOLDER = 2
DIGESTS = "prefix string, depth int, files bigint, digest string"


def framed(path, sha256):
    """One file of a length-prefixed digest: bytes of the path, the path, bytes of the digest in hex, and it."""
    return F.concat(F.octet_length(path).cast("string"), F.lit(":"), path, F.octet_length(sha256).cast("string"), F.lit(":"), sha256)


def framed_digests(files: DataFrame, key: str) -> DataFrame:
    """key, files and the length-prefixed digest of each key's files (path, sha256) in order of path. Streamed, so no key is gathered."""
    rows = files.select(key, "path", framed(F.col("path"), F.col("sha256")).alias("entry"))
    return joined_digests(rows, key, "entry", "", order=["path"]).select(key, F.col("entries").alias("files"), "digest")


# What of a product its consumers see.
CONSUMED = ("SKILL.md", "references", "assets", "scripts")


def consumer_digests(files: DataFrame, key: str) -> DataFrame:
    """key, files and digest of what consumers see of each key's files (path, content: binary), in order of their paths part by part: of each file the path's bytes behind their number in four bytes, and the content behind its number in eight. Streamed."""
    rows = files.where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*CONSUMED)).select(key, "path", F.split("path", "/").alias("parts"), "content")

    def step(state, _, path, content):
        name = path.encode()
        for part in (len(name).to_bytes(4, "big"), name, len(content).to_bytes(8, "big"), content):
            state[0].update(part)
        state[1] += 1
        return []

    kind = rows.schema[key].dataType.simpleString()
    return folded(rows, key, ["parts"], ["path", "content"], lambda: [hashlib.sha256(), 0], step, f"{key} {kind}, files bigint, digest string", lambda state, k: [(k, state[1], state[0].hexdigest())])


def digest_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """prefix, depth, files and digest of all nodes of a tree of files (path, sha256), paths distinct: leaves of `depth` hex digits, of which more suit more files, up to the root ''. An empty tree has its root alone."""
    leaves = framed_digests(files.select(F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"), "path", "sha256"), "prefix").select("prefix", F.lit(depth).alias("depth"), "files", "digest")
    out = level = leaves
    for d in range(depth - 1, -1, -1):
        # at most 16 children of each node
        child = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        above = level.groupBy(F.left("prefix", F.lit(d)).alias("prefix")) if d else level.groupBy(F.lit("").alias("prefix"))
        level = above.agg(F.sum("files").alias("files"), child.alias("c")).select("prefix", F.lit(d).alias("depth"), "files", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x.prefix, F.lit("="), x.digest)), ";"), 256).alias("digest"))
        out = out.unionByName(level)
    empty = level.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("files"), F.sha2(F.lit(""), 256).alias("digest"))
    return out.unionByName(empty)


def write_tree(files: DataFrame, path: str, depth: int = 3) -> None:
    """Store files (path, sha256, ...) by folder, and the tree of their digests beside them."""
    files.withColumn("folder", F.left(F.sha2("path", 256), F.lit(FOLDER))).repartition("folder").write.partitionBy("folder").parquet(f"{path}/files")
    stored = files.sparkSession.read.schema(files.schema.add("folder", "string")).parquet(f"{path}/files")
    digest_tree(stored.select("path", "sha256"), depth).repartition(1, "depth").write.partitionBy("depth").parquet(f"{path}/digests")


def _nodes(spark: SparkSession, path: str, depth: int) -> DataFrame:
    return spark.read.schema("prefix string, files bigint, digest string, depth int").parquet(f"{path}/digests").where(F.col("depth") == depth).select("prefix", "digest")


def differing(spark: SparkSession, old: str, new: str, depth: int = FOLDER) -> list[str]:
    """The prefixes of `depth` digits under which two stored trees differ: at most 16 ** depth. Equal trees are told from their roots."""
    prefixes = [""]
    for d in range(depth + 1):
        near = F.left("prefix", F.lit(max(0, d - 1))).isin(prefixes) if d else F.lit(True)
        a, b = (_nodes(spark, p, d).where(near) for p in (old, new))
        both = a.join(b.withColumnRenamed("digest", "other"), "prefix", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))
        prefixes = sorted(r[0] for r in both.select("prefix").collect())
        if not prefixes:
            break
    return prefixes


def stored_files(spark: SparkSession, path: str, schema: str, folders: list[str]) -> DataFrame:
    """The files of some folders of a stored tree; no others are read."""
    return spark.read.schema(f"{schema}, folder string").parquet(f"{path}/files").where(F.col("folder").isin(folders)).drop("folder")


def compare_trees(spark: SparkSession, old: str, new: str) -> DataFrame:
    """path and change (added, removed, modified) between two stored trees."""
    folders = differing(spark, old, new)
    side = lambda p, name: stored_files(spark, p, "path string, sha256 string", folders).withColumnRenamed("sha256", name)
    both = side(old, "a").join(side(new, "b"), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))

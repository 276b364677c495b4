"""Near-duplicate detection with circulant MinHash, banding and exact verification.

Texts become sets of hashed word shingles. One permutation scatters the hashes over 32 bits, a second one, circularly shifted by
k, gives coordinate k of the signature, so two permutations make all coordinates. Equal sets are one class. Bands of the
signature put classes into buckets, and candidate pairs are confirmed on the full sets.

Buckets of any size are handled without all pairs:
- Every bucket links its members to a leader (a star), so a group of copies costs as many pairs as it has members.
- Small buckets then compare those pairs that are not connected yet.
- Large buckets that hold several components get a second leader, and at last those outside the largest component are compared with all
  members exactly, in pairs of bounded blocks of which only links come out. A bucket of copies is one component by then, and texts that
  share no more than a passage are told apart by their signatures before their sets are built.
Pairs that are connected already are not compared, as they cannot change a component.

With 32 bands of 4 rows a pair at similarity 0.8 misses all buckets with probability 5e-8. Signatures drop candidates that lie 5
standard deviations below the threshold.

Cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than a shingle has
one shingle, its whole sequence; repeated rows are in one class; a null id takes part but is never a component's id
unless there is no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, same, staged, unstage


@dataclass(frozen=True)
class NearDup:
    """words: of a shingle; percent: least Jaccard similarity; bands * rows coordinates; small: members of a bucket whose pairs are all compared."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    small: int = 24
    slack: float = 0.18


#: Hashes that a step of the signature loop takes at once, so that they stay in cache.
BLOCK = 1 << 14
#: Members outside the main component and members in all that a pair of blocks holds, about; columns of a matrix of sets.
OTHERS, ALL, COLUMNS = 256, 512, 1 << 13


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text; A-Z count as a-z."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), 1 + n)], np.uint64)
    m = n - words + 1
    out = h[:m].copy()
    for k in range(1, words):
        out = _mix64(out) + h[k : k + m]
    return np.unique(_mix64(out))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash signatures (uint32) of sets that are not empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)  # the first permutation has scattered the hashes
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), coordinates), np.uint32)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.subtract(x, np.uint32(k), out=y)  # the shift, modulo 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(y, np.uint32(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(factor), out=y)
        np.right_shift(y, np.uint32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def features(df: DataFrame, rule: NearDup, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, digest (of the set), bands (bucket keys) and low (a byte of each coordinate). Narrow, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digests, bands, low = [0] * n, [None] * n, [None] * n, [None] * n
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def flush() -> None:
                sig = signatures([s for _, s in held], rule.bands * rule.rows)
                cut = np.ascontiguousarray(sig.reshape(len(held), rule.bands, rule.rows))
                for j, (i, s) in enumerate(held):
                    digests[i] = hashlib.sha1(s.tobytes()).digest()[:16]
                    bands[i] = np.array([xxhash.xxh3_64_intdigest(cut[j, b].tobytes(), b) for b in range(rule.bands)], np.uint64).view(np.int64)
                    low[i] = (sig[j] & np.uint32(255)).astype(np.uint8).tobytes()
                held.clear()

            for i, text in enumerate(batch["text"]):
                s = shingle_set(text.as_buffer().to_pybytes(), rule.words)
                counts[i] = len(s)
                if len(s):
                    held.append((i, s))
                    size += len(s)
                if size >= BLOCK:
                    flush()
                    size = 0
            if held:
                flush()
            columns = [batch["id"], batch["text_key"], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "n_shingles", "digest", "bands", "low"])

    return rows.mapInArrow(run, f"id {kind}, text_key string, n_shingles bigint, digest binary, bands array<bigint>, low binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of links (a, b) reaches. In a round a label takes the least of the neighbours' labels and of its label's label; a round without changes is the last."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "n"), F.col("b") == F.col("n")).groupBy("a").agg(F.min("comp").alias("least"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("far"))
        step = labels.join(near, F.col("node") == F.col("a")).join(jump, F.col("comp") == F.col("j"))
        after = staged(step.select("node", F.col("comp").alias("was"), F.least("comp", "least", "far").alias("comp")), "labels")
        changed = after.where("was != comp").limit(1).count()
        unstage(labels)
        labels = after.select("node", "comp")
        labels._sedimark_path = after._sedimark_path
        if not changed:
            unstage(both)
            return labels


def _confirm(pairs: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough; texts: (node, text)."""
    left = texts.select(F.col("node").alias("a0"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b0"), F.col("text").alias("tb"))
    rows = pairs.join(left, F.col("a") == F.col("a0")).join(right, F.col("b") == F.col("b0")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out_a, out_b = [], []
            for a, b, ta, tb in zip(*[batch[c] for c in ("a", "b", "ta", "tb")]):
                key = a.as_py()
                if key not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[key] = shingle_set(ta.as_buffer().to_pybytes(), rule.words)
                x, y = known[key], shingle_set(tb.as_buffer().to_pybytes(), rule.words)
                if 100 * min(len(x), len(y)) < rule.percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    out_a.append(key)
                    out_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _plausible(pairs: DataFrame, classes: DataFrame, rule: NearDup) -> DataFrame:
    """Distinct pairs without those whose sizes or signatures rule them out."""
    side = lambda x: classes.select(F.col("node").alias(f"{x}0"), F.col("low").alias(f"{x}_low"), F.col("n_shingles").alias(f"{x}_n"))
    rows = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    rows = rows.join(side("a"), F.col("a") == F.col("a0")).join(side("b"), F.col("b") == F.col("b0"))
    rows = rows.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * rule.percent).select("a", "b", "a_low", "b_low")
    least = (rule.percent / 100 - rule.slack) * rule.bands * rule.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = rule.bands * rule.rows
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, width) for c in ("a_low", "b_low"))
            near = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets in x with those in y, as a product of 0/1 matrices over the hashes that both sides have."""
    left, right = np.unique(np.concatenate(x)), np.unique(np.concatenate(y))
    shared = np.intersect1d(left, right, assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]

        def dense(sets: list[np.ndarray]) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                k = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[i, k[part[k] == s]] = 1
            return m

        out += dense(x) @ dense(y).T
    return out


def _compare_blocks(members: DataFrame, df: DataFrame, classes: DataFrame, rule: NearDup, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) between members (node, comp, bucket) of a bucket that are in different components, found exactly.

    Most of a bucket's members are in its main component. The others are dealt over blocks of OTHERS, all members over blocks of ALL, and
    each pair of blocks is a group. First only the signatures meet, as a matrix, which leaves the rows that have a plausible partner in another component; then
    the texts of these rows meet, whose full sets are compared as a matrix. Only links leave a group, one for each node and component at most. The staged tables
    that the links read come with them.
    """
    sizes = members.groupBy(F.col("bucket").alias("k"), F.col("comp").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("k").agg(F.max(F.struct("n", -F.col("c"))).alias("m"), F.sum("n").alias("all"))
    rows = members.join(main, F.col("bucket") == F.col("k")).withColumn("other", F.col("comp") != -F.col("m.col2"))
    rows = rows.join(classes.select(F.col("node").alias("cn"), "low"), F.col("node") == F.col("cn"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    rows = rows.withColumn("n_i", blocks(F.col("all") - F.col("m.n"), OTHERS)).withColumn("n_j", blocks(F.col("all"), ALL))
    deal = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    keep = ["node", "comp", "bucket", "i", "j", "left", "low"]
    left = rows.where("other").withColumn("i", deal("n_i")).withColumn("j", F.explode(upto("n_j"))).withColumn("left", F.lit(True)).select(keep)
    right = rows.withColumn("j", deal("n_j")).withColumn("i", F.explode(upto("n_i"))).withColumn("left", F.lit(False)).select(keep)
    width = rule.bands * rule.rows
    least = (rule.percent / 100 - rule.slack) * width

    def plausible(t: pa.Table) -> pa.Table:
        comp, on_left = t["comp"].to_numpy(), t["left"].to_numpy()
        low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(-1, width)
        x, y = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        found = np.zeros(len(comp), bool)
        for i in x:
            near = y[((low[y] == low[i]).sum(1) >= least) & (comp[y] != comp[i])]
            found[i] = len(near) > 0
            found[near] = True
        return t.select(keep[:-1]).filter(pa.array(found))

    kinds = "node bigint, comp bigint, bucket bigint, i int, j int, left boolean"
    near = staged(left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(plausible, kinds), "near")
    texts = _texts(df, classes, near, id_col, text_col)
    both = near.join(texts.select(F.col("node").alias("tn"), "text"), F.col("node") == F.col("tn"))

    def compare(t: pa.Table) -> pa.Table:
        node, comp, on_left = (t[c].to_numpy() for c in ("node", "comp", "left"))
        x, y = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        out_a, out_b = [], []
        if len(x) and len(y):
            sets = [shingle_set(v.as_buffer().to_pybytes(), rule.words) for v in t["text"]]
            xs, ys = [sets[i] for i in x.tolist()], [sets[i] for i in y.tolist()]
            inter = _overlaps(xs, ys).astype(np.int64)
            union = np.array([len(v) for v in xs])[:, None] + np.array([len(v) for v in ys])[None, :] - inter
            linked = (100 * inter >= rule.percent * union) & (comp[x][:, None] != comp[y][None, :])
            for k, i in enumerate(x):
                hits = y[linked[k]]
                _, first = np.unique(comp[hits], return_index=True)
                out_a += [int(node[i])] * len(first)
                out_b += node[hits[first]].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return both.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint"), near, texts


def _texts(df: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of one document of each class in nodes, staged."""
    wanted = classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "rep")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    found = rows.join(wanted, same(F.col("id"), F.col("rep.id")) & (F.col("text_key") == F.col("rep.text_key"))).select("node", "text")
    return staged(found.dropDuplicates(["node"]), "texts", "zstd")


def groups(df: DataFrame, rule: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, n_shingles and first (the least id and text key of the row's group; null for empty sets) of each row."""
    held: list[DataFrame] = []  # tables that nothing reads once the components are named

    def stage(table: DataFrame, what: str) -> DataFrame:
        held.append(staged(table, what))
        return held[-1]

    rows = staged(features(df, rule, id_col, text_col), "features")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("low").alias("low")
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy(F.col("bucket").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last")).where("size > 1")
    buckets = stage(buckets, "buckets")
    members = stage(members.join(buckets.where("size > 2").select("k", "size"), F.col("bucket") == F.col("k")).select("bucket", "node", "size"), "members")
    # whoever meets most others is likely to be the text that the others are copies of, and leads its buckets
    weight = members.groupBy(F.col("node").alias("w")).agg(F.sum("size").alias("weight"))
    members = stage(members.join(weight, F.col("node") == F.col("w")).select("bucket", "node", "size", "weight"), "members")
    leaders = members.groupBy(F.col("bucket").alias("k")).agg(F.max(F.struct("weight", "node")).alias("leader"))
    stars = members.join(leaders, F.col("bucket") == F.col("k")).where("node != leader.node").select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
    stars = stars.unionByName(buckets.where("size = 2").select(F.col("first").alias("a"), F.col("last").alias("b")))
    small = members.where(F.col("size") <= rule.small).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("m"))
    small = small.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    stars = stage(_plausible(stars, classes, rule), "stars")
    small = stage(_plausible(small, classes, rule).join(stars, ["a", "b"], "left_anti"), "pairs")
    large = stage(members.where(F.col("size") > rule.small), "large")
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b"))
    texts = _texts(df, classes, nodes, id_col, text_col)
    links = stage(_confirm(stars, texts, rule), "links")
    unstage(texts)
    comps = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not connected yet."""
        label = lambda x: comps.select(F.col("node").alias(f"{x}n"), F.col("comp").alias(f"{x}c"))
        rows = pairs.join(label("a"), F.col("a") == F.col("an"), "left").join(label("b"), F.col("b") == F.col("bn"), "left")
        return rows.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")

    def unresolved() -> DataFrame:
        """Members (node, comp, bucket, weight) of large buckets that hold several components."""
        label = comps.select(F.col("node").alias("n"), "comp")
        rows = large.join(label, F.col("node") == F.col("n"), "left").select("node", F.coalesce("comp", "node").alias("comp"), "bucket", "weight")
        open_ = rows.groupBy(F.col("bucket").alias("k")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("k")
        return rows.join(open_, F.col("bucket") == F.col("k"), "left_semi")

    def add(more: DataFrame) -> None:
        nonlocal links, comps
        more = stage(more, "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            unstage(comps)
            comps = components(links)

    # the members of a large bucket outside its largest component get a leader of their own; its pairs are confirmed along with those of small buckets
    left = stage(unresolved(), "unresolved")
    sizes = left.groupBy(F.col("bucket").alias("k"), F.col("comp").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("weight", "node")).alias("leader"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc(), "c"))
    second_leaders = sizes.withColumn("place", place).where("place = 2").select("k", "leader")
    more = left.join(second_leaders, F.col("bucket") == F.col("k")).where("node != leader.node").select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
    more = _plausible(apart(more), classes, rule) if left.limit(1).count() else more
    second = stage(apart(small).unionByName(more), "pairs")
    if second.limit(1).count():
        nodes = second.select(F.col("a").alias("node")).union(second.select("b"))
        texts = _texts(df, classes, nodes, id_col, text_col)
        add(_confirm(second, texts, rule))
        unstage(texts)
    if left.limit(1).count():
        left = stage(unresolved(), "unresolved")
        if left.limit(1).count():
            links_left, *read = _compare_blocks(left, df, classes, rule, id_col, text_col)
            add(links_left)
            held.extend(read)
    own = classes.join(comps.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("digest", F.coalesce("comp", "node").alias("comp"), "rep")
    ids = own.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("first"))
    named = staged(own.join(ids, F.col("comp") == F.col("c")).select(F.col("digest").alias("d"), "first"), "components")
    unstage(comps, *held)
    return rows.select("id", "text_key", "n_shingles", "digest").join(named, F.col("digest") == F.col("d"), "left").select("id", "text_key", "n_shingles", "first")


def near_duplicates(df: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of each row."""
    component = F.when(F.col("n_shingles") > 0, F.col("first.id")).otherwise(F.col("id"))
    return groups(df, rule, id_col, text_col).select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group, that of the least id (then text hash), once if it is repeated. Rows without words all stay."""
    firsts = groups(df, rule, id_col, text_col).where("n_shingles > 0").select("first").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the id is split into value and null mark, so that join and window share one shuffle of the texts
    parts = lambda id_, key: {"__id": F.coalesce(id_.cast("string"), F.lit("")), "__none": id_.isNull(), "__key": key}
    keys = list(parts(F.lit(0), F.lit("")))
    firsts = firsts.withColumns(parts(F.col("first.id"), F.col("first.text_key"))).select(*keys, F.lit(True).alias("__first"))
    found = df.withColumns(parts(F.col(id_col), F.md5(text.cast("binary")))).join(firsts, keys, "left")
    blank = ~text.rlike(WORD)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__id"))
    return found.withColumn("__nth", nth).where((F.col("__first") & (F.col("__nth") == 1)) | blank).select(*df.columns)

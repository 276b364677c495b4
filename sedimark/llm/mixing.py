"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a hash into cells, and consecutive cells form blocks of about equal words. A source's
quota is the number of its blocks, in a permuted order and epoch after epoch, that reach its target. The tree halves the
set of output shards again and again; at each node a multivariate hypergeometric draw says how many blocks of each source
go to the left half, so the shards' parts are distributed as if all blocks had been shuffled and dealt out, yet add up
to the quotas exactly. Each shard then takes its count of the next blocks in each source's permuted order, and its rows are
shuffled among themselves: in the order of a hash of row and epoch. mix_plan says which shard takes each row in each epoch, place_draws adds the
gapless positions, and mix_rows gives the rows themselves. Cells, blocks and the tree are tables whose size depends on the parameters, the number of
sources and shards alone; rows meet them by (source, cell), which spreads a hot source over all its cells.

Only DataFrame functions are used. The draw inverts the distribution function by walking from its mode, up to 12 standard
deviations to either side, beyond which the probability is below the resolution of a double.

Cases: a null text has no words; a null source is a source, the last in order; ids may be null or repeated, as rows are
ordered by a hash of id and text, and equal rows are interchangeable; texts without words follow the rows of their cell and are drawn with 0 words, but a
source without any word is left out; with cut, the row at the edge of a quota is taken up to a word so that targets are met exactly, without it as a
whole or not at all, whichever comes nearer; an
empty table gives an empty result; columns other than id, text and source are ignored by mix_plan and kept by mix_rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hex_hash, ranked, same, staged, word_count


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code point order, repeating; share: of all words; most: times a source may be used; cells: at most, by source; blocks: of all sources together, about; cut: whether the row at the edge of a quota may be taken in part."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    shards: int = 64
    cells: int = 4096
    blocks: int = 4096
    rows_a_cell: int = 64
    seed: int = 1
    cut: bool = True


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hypergeometric(x: str) -> str:
    """SQL for a draw of how many of n blocks taken from `total` are of the g good ones, by inversion at u; x names a struct (g, total, n, u)."""

    def go(steps: str, start: str, ratio: str, target: str) -> str:
        weight = f"s.p * ({ratio})"
        return f"aggregate({steps}, {start}, (s, k) -> named_struct('p', {weight}, 'sum', s.sum + {weight}, 'pick', if(s.pick < 0 and s.sum + {weight} > {target}, k, s.pick)), s -> named_struct('p', 1d, 'sum', s.sum, 'pick', s.pick))"

    def walk(target: str) -> str:
        """Weights relative to the mode's, from the mode up and then from it down; pick is where their sum first exceeds target."""
        none = "cast(array() as array<bigint>)"
        up, down = f"if(b.hi > b.mode, sequence(b.mode + 1, b.hi), {none})", f"if(b.lo < b.mode, sequence(b.mode - 1, b.lo, -1L), {none})"
        start = f"named_struct('p', 1d, 'sum', 1d, 'pick', if(1d > {target}, b.mode, -1L))"
        above = go(up, start, "(x.g - k + 1) * (x.n - k + 1) / (k * (x.total - x.g - x.n + k))", target)
        return go(down, above, "(k + 1) * (x.total - x.g - x.n + k + 1) / ((x.g - k) * (x.n - k))", target)

    lo, hi = "greatest(0L, x.n - x.total + x.g)", "least(x.n, x.g)"
    mode = f"least({hi}, greatest({lo}, cast(floor((x.n + 1) * (x.g + 1) / (x.total + 2)) as bigint)))"
    reach = "cast(ceil(12 * sqrt(x.n * (x.g / x.total) * (1 - x.g / x.total)) + 20) as bigint)"
    pick = _let(f"{walk('double(\'infinity\')')}.sum", "t", f"{walk('x.u * t')}.pick")
    bounds = _let(f"named_struct('mode', {mode}, 'reach', {reach})", "m", f"named_struct('lo', greatest({lo}, m.mode - m.reach), 'hi', least({hi}, m.mode + m.reach), 'mode', m.mode)")
    drawn = _let(bounds, "b", _let(pick, "y", "if(y < 0, b.mode, y)"))
    return _let(x, "x", f"case when x.n <= 0 or x.g <= 0 then 0L when x.n >= x.total then x.g else {drawn} end")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(i, shard, n): how many of the q blocks of source number i each shard gets. quotas: rows (i, q)."""
    kind = "struct<total:bigint,n:bigint,out:array<bigint>>"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x.q)
    nodes = quotas.agg(ordered.alias("q")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    u = f"(xxhash64({seed}, lo, hi, i) & {(1 << 53) - 1}L) / {float(1 << 53)}d"
    draw = _hypergeometric(f"named_struct('g', q[int(i)], 'total', a.total, 'n', a.n, 'u', {u})")
    # one source after the other, from what the sources before it have left of the population and of the sample
    step = _let(draw, "d", f"cast(named_struct('total', a.total - q[int(i)], 'n', a.n - d, 'out', concat(a.out, array(d))) as {kind})")
    start = f"cast(named_struct('total', total, 'n', total * (mid - lo) div (hi - lo), 'out', array()) as {kind})"
    halves = f"if(hi - lo > 1 and size(q) > 0, aggregate(sequence(0L, size(q) - 1L), {start}, (a, i) -> {step}).out, null)"
    while True:
        nodes = nodes.selectExpr("*", "lo + (hi - lo + 1) div 2 as mid", "aggregate(q, 0L, (a, y) -> a + y) as total").selectExpr("*", f"{halves} as left_q")
        children = "if(left_q is null, array(named_struct('q', q, 'lo', lo, 'hi', hi)), array(named_struct('q', left_q, 'lo', lo, 'hi', mid), named_struct('q', zip_with(q, left_q, (y, z) -> y - z), 'lo', mid, 'hi', hi)))"
        nodes = nodes.selectExpr(f"explode({children}) as c").select("c.*")
        if shards <= 2:
            break
        shards = -(-shards // 2)
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("i", "n")).select(F.col("i").cast("bigint"), "shard", "n")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Add i (order), weight and target to sources (source, words). The level at which weights fill targets up to their limits is found from sums over the sources in order of limit / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    s = sources.withColumn("i", F.row_number().over(order).cast("bigint") - 1)
    s = s.withColumn("weight", cycle[F.pmod("i", F.lit(len(mix.weights))).cast("int")]).withColumn("limit", F.col("words") * mix.most)
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "i")
    done = F.coalesce(F.sum("limit").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("words").over(Window.partitionBy()) * F.lit(mix.share)
    s = s.withColumn("level", (budget - done) / open_).withColumn("fits", F.col("limit") / F.col("weight") >= F.col("level"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "i", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "words", "i", "weight", "target")


def mix_plan(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """key, id, source, size, source_size, target, taken and draws (epoch, shard, words) of each row. Texts are read once, for a staged narrow table."""
    text_hash = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    narrow = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        hex_hash(F.lit(mix.seed), F.col(id_col), F.col(text_col).isNull(), text_hash, F.col(source_col).isNull(), F.col(source_col)).alias("key"),
    )
    rows = staged(narrow, "sizes")
    cells = max(1, min(mix.cells, rows.count() // mix.rows_a_cell))
    cell = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * cells / float(1 << 32)).cast("int")
    rows = rows.withColumn("cell", cell)
    sums = staged(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    goal = staged(targets(sums.groupBy("source").agg(F.sum("words").alias("words")), mix), "targets")
    all_words = Window.partitionBy()
    sizes = goal.withColumn("blocks", F.greatest(F.lit(1.0), F.ceil(F.col("words") * mix.blocks / F.greatest(F.sum("words").over(all_words), F.lit(1)))).cast("bigint"))
    sizes = sizes.select(F.col("source").alias("s"), "i", "target", F.col("words").alias("source_size"), "blocks")
    parts = sums.join(sizes, same(F.col("source"), F.col("s"))).drop("s")
    parts = parts.withColumn("block", F.floor(F.col("cell") * F.col("blocks") / F.lit(cells)).cast("bigint"))
    # epochs: each cell once for each time a source may be used, blocks in an order of their own each time, cells in order within
    parts = parts.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(mix.most - 1))))
    parts = parts.withColumn("turn", hex_hash(F.lit(mix.seed), F.col("source"), F.col("epoch"), F.col("block")))
    line = Window.partitionBy("i").orderBy("epoch", "turn", "block", "cell")
    before = F.coalesce(F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("take", F.least(F.col("words"), F.greatest(F.lit(0), F.round("target").cast("bigint") - before)))
    # a block counts for the quota if anything of it is taken
    parts = parts.withColumn("block_take", F.sum("take").over(Window.partitionBy("i", "epoch", "block"))).where("block_take > 0")
    parts = staged(parts.withColumn("nth", F.dense_rank().over(Window.partitionBy("i").orderBy("epoch", "turn", "block")).cast("bigint") - 1), "blocks")
    counts = parts.groupBy("i").agg((F.max("nth") + 1).alias("q"))
    quotas = goal.select("i").join(counts, "i", "left").select("i", F.coalesce("q", F.lit(0)).cast("bigint").alias("q"))
    dealt = split_quotas(quotas, mix.shards, mix.seed)
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("shard"))
    dealt = dealt.withColumn("upto", upto).where("n > 0").select(F.col("i").alias("di"), "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("dn"))
    parts = parts.join(dealt, (F.col("i") == F.col("di")) & (F.col("nth") == F.col("dn")))
    # one row for each cell, with what each epoch takes of it and where that goes
    plan = parts.groupBy("i", "source", "cell").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "take", "words"))).alias("takes"))
    plan = plan.select(F.col("source").alias("ps"), F.col("cell").alias("pc"), "takes")
    rows = rows.join(sizes.select("s", "source_size", "target"), same(F.col("source"), F.col("s"))).drop("s")
    rows = rows.join(plan, same(F.col("source"), F.col("ps")) & (F.col("cell") == F.col("pc")), "left")
    in_cell = Window.partitionBy("source", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    left = lambda t: t.take - F.col("before")
    whole = lambda t: F.when(2 * left(t) >= F.col("size"), F.col("size")).otherwise(0)
    words = lambda t: F.least(F.col("size"), F.greatest(F.lit(0), left(t))) if mix.cut else whole(t)
    taken_by = lambda t: (left(t) > 0) | (t.take == t.words)
    takes = F.filter(F.coalesce("takes", F.array().cast("array<struct<epoch:int,shard:int,take:bigint,words:bigint>>")), taken_by)
    draws = F.transform(takes, lambda t: F.struct(t.epoch.alias("epoch"), t.shard.alias("shard"), words(t).cast("bigint").alias("words")))
    draws = F.filter(draws, lambda d: (d.words > 0) | (F.col("size") == 0))
    rows = rows.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, d: a + d.words)
    return rows.select("key", "id", "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def place_draws(plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """plan with each draw's position among the rows of its shard, shuffled, gapless from 0. Only keys, shards and hashes are shuffled."""
    rows = staged(plan.withColumn("__rid", F.monotonically_increasing_id()), "plan")
    draws = rows.select("__rid", "key", F.explode("draws").alias("d")).select("__rid", "key", "d.*", F.xxhash64(F.lit(mix.seed), "d.epoch", "key").alias("mix"))
    n = rows.agg(F.coalesce(F.sum(F.size("draws")), F.lit(0))).first()[0]
    order = [F.col(c) for c in ("mix", "key", "words", "epoch")]
    placed = ranked(draws, ["shard"], order, F.struct("key", "epoch"), "position", n)
    placed = placed.groupBy(F.col("__rid").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "words", "position"))).alias("__placed"))
    none = F.array().cast("array<struct<epoch:int,shard:int,words:bigint,position:bigint>>")
    out = rows.join(placed, F.col("__rid") == F.col("__r"), "left").withColumn("draws", F.coalesce("__placed", none))
    return out.select(*plan.columns)


def mix_rows(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = "shard", position_col: str | None = "position") -> DataFrame:
    """The mix itself: df's rows as often as they are drawn, the one at the edge of a quota as mix.cut says, with the output shard and a shuffled position in it.

    Without a shard_col the rows come in the order of the shards instead: each task has a run of every shard, shuffled within, of the rows that the hash of their keys has dealt to it.
    """
    text_hash = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = hex_hash(F.lit(mix.seed), F.col(id_col), F.col(text_col).isNull(), text_hash, F.col(source_col).isNull(), F.col(source_col))
    plan = staged(mix_plan(df, mix, id_col, text_col, source_col).where(F.size("draws") > 0).select(F.col("key").alias("__k"), F.col("size").alias("__size"), "draws"), "plan")
    plan = plan.hint("merge") if shard_col is None else plan  # its shuffle is what deals the rows out
    left = df.withColumn("__key", key)
    if plan.groupBy("__k").count().where("count > 1").limit(1).count():
        # equal rows share a key and differ only in how much of each is drawn: they are numbered on both sides
        plan = plan.withColumn("__nth", F.row_number().over(Window.partitionBy("__k").orderBy("draws")))
        left = left.withColumn("__nth0", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
        out = left.join(plan, (F.col("__key") == F.col("__k")) & (F.col("__nth0") == F.col("__nth")))
    else:
        out = left.join(plan, F.col("__key") == F.col("__k"))
    out = out.withColumn("__draw", F.explode("draws"))
    if mix.cut:
        out = out.withColumn(text_col, F.when(F.col("__draw.words") < F.col("__size"), first_words(F.col(text_col), F.col("__draw.words"))).otherwise(F.col(text_col)))
    out = out.withColumn("__shard", F.col("__draw.shard")).withColumn("__mix", F.xxhash64(F.lit(mix.seed), "__draw.epoch", "__key")).select(*df.columns, "__shard", "__mix", "__key")
    if shard_col is None:
        # the join has dealt the rows out by the hash of their keys, so no second shuffle of texts is needed
        return out.sortWithinPartitions("__shard", "__mix", "__key").select(*df.columns)
    out = staged(out.withColumnRenamed("__shard", shard_col), "mix")
    return ranked(out, [shard_col], [F.col("__mix"), F.col("__key")], F.col("__key"), position_col).select(*df.columns, shard_col, position_col)

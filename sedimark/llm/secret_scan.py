"""Secret scans by corpus-wide ownership frequency.

Three patterns give the base spans of each text, and a wider pattern for long tokens of mixed characters gives further
candidates. A hash of every candidate's value is counted over the corpus by distinct owners and distinct repositories.
A value that several owners or many repositories hold is a widely copied example; one that few hold and that looks
random is a live credential of its owner. Base spans are always reported; of the wider candidates only live ones are, as kind
`live`; and each row tells how many of its values are live and how many are copied.

Only DataFrame functions are used. Spans are code points from 0 with an exclusive end. Counting pre-aggregates by (value, owner,
repository) before it shuffles, so a value that a third of the rows hold costs one row for each repository; the join that brings the counts
back has plain shuffles on both sides, which Spark splits where a value is hot.

Work grows in proportion to a text and its spans: positions and overlaps come from prefix folds in chunks.

Cases: a null text is empty; a null owner counts as an owner; equal values in a row count once; rows may repeat, each
gets its own result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import matches, running

from .common import let, staged

#: The base patterns in the order in which they are listed; the group whose length counts, and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the base pattern AKIA[A-Z0-9]+ or [0-9a-f]+ is maximal, so the least length can stand in the pattern itself.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live")
WIDE_KIND = 3
#: Code points of the pieces that a text is cut into where many spans are masked.
PIECE = 1024
#: Prefixes of well-known credentials, and the least length of any other long token.
WIDE = r"(?:gh[pousr]_|xox[abprs]-|sk-|AIza|ya29\.|glpat-)[A-Za-z0-9_-]{16,}|[A-Za-z0-9+/_-]{32,}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your[_-]"
SPAN = "struct<start:bigint,end:bigint,kind:int,value:string>"


@dataclass(frozen=True)
class Ownership:
    """A value with at least `owners` distinct owners or `repositories` distinct repositories is copied, not live."""

    owners: int = 3
    repositories: int = 6


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the matches of pattern."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(kind).alias("kind"), m.match.alias("value")).cast(SPAN))


def _outside(wide: Column, base: Column) -> Column:
    """The spans of wide that no span of base overlaps: in order of start, none before reaches into it, and none behind starts before it ends. Work in proportion to both."""
    none_before, none_behind = F.lit(-1), F.lit(1 << 62)
    ends = lambda all_: running(F.transform(all_, lambda s: F.when(s.kind < WIDE_KIND, s.end).otherwise(none_before)), lambda a, b: F.greatest(a, b), none_before)
    starts = lambda all_: F.reverse(running(F.transform(F.reverse(all_), lambda s: F.when(s.kind < WIDE_KIND, s.start).otherwise(none_behind)), lambda a, b: F.least(a, b), none_behind))
    marked = lambda all_: let(F.struct(ends(all_).alias("ends"), starts(all_).alias("starts")), lambda x: F.transform(all_, lambda s, i: F.struct(s.alias("s"), (x.ends[i] > s.start).alias("before"), (x.starts[i] < s.end).alias("behind"))))
    kept = lambda all_: F.transform(F.filter(marked(all_), lambda m: (m.s.kind == WIDE_KIND) & ~m.before & ~m.behind), lambda m: m.s)
    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(let(F.array_sort(F.concat(base, wide)), kept))


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _looks_live(value: Column) -> Column:
    """At least 10 different characters with both a digit and a letter, and no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 10) & ~value.rlike(PLACEHOLDER)


def candidates(df: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """id, key (a hash of id and text), owner, repository, base and wide spans with hashed values. Narrow, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"), row_key(id_col, text_col).alias("key"), owner.alias("owner"), repository.alias("repository"))
    assign = F.filter(F.transform(_spans(F.col("t"), ASSIGN, 0), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), _assigned(s.value).alias("value"))), lambda s: F.length(s.value) >= 6)
    base = F.concat(assign, _spans(F.col("t"), ACCESS, 1), _spans(F.col("t"), HEX, 2))
    wide = _spans(F.col("t"), WIDE, WIDE_KIND)
    clear = let(base, lambda b: F.struct(b.alias("b"), let(wide, lambda w: _outside(w, b)).alias("w")))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), F.sha2(s.value, 256).alias("value"), _looks_live(s.value).alias("random")))
    rows = rows.withColumn("found", clear)
    return rows.select("id", "key", "owner", "repository", F.array_sort(hashed(F.col("found.b"))).alias("base"), F.array_sort(hashed(F.col("found.w"))).alias("wide"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def _named(df: DataFrame, id_col: str, text_col: str, owner: Column | None, repository: Column | None) -> DataFrame:
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("~")), F.coalesce(F.col("lang"), F.lit("~"))) if repository is None else repository
    return candidates(df, id_col, text_col, F.coalesce(owner.cast("string"), F.lit("~")), F.coalesce(repository.cast("string"), F.lit("~")))


def _held(rows: DataFrame) -> DataFrame:
    """value, owner and repository of all candidates, once each."""
    return rows.select(F.explode(F.concat("base", "wide")).alias("s"), "owner", "repository").select(F.col("s.value").alias("value"), "owner", "repository").distinct()


def scan(df: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """id, key, base and live spans, and the counts of live and copied values of each row. Without an owner column the source is the owner and (source, lang) the repository.

    corpus: a table with the same columns whose rows count for ownership beside df's own, such as what df was before copies were folded.
    """
    rows = staged(_named(df, id_col, text_col, owner, repository).withColumn("rid", F.monotonically_increasing_id()), "candidates")
    any_ = rows.where((F.size("base") > 0) | (F.size("wide") > 0)).withColumn("s", F.explode(F.concat("base", "wide")))
    values = _held(rows)
    if corpus is not None:
        values = values.unionByName(_held(_named(corpus, id_col, text_col, owner, repository))).distinct()
    stats = values.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("repositories"))
    stats = staged(stats.select(F.col("value").alias("v"), ((F.col("owners") >= rule.owners) | (F.col("repositories") >= rule.repositories)).alias("copied")), "ownership")
    judged = any_.select("rid", "s", F.col("s.value").alias("value")).join(stats, F.col("value") == F.col("v"))
    live = ~F.col("copied") & F.col("s.random")
    verdicts = judged.groupBy("rid").agg(
        F.collect_list(F.when(live, F.struct("s.start", "s.end", "s.kind"))).alias("live"),
        F.count_distinct(F.when(live, F.col("value"))).alias("n_live"),
        F.count_distinct(F.when(F.col("copied"), F.col("value"))).alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    out = rows.join(verdicts.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    return out.select("id", "key", "base", F.array_sort(F.coalesce("live", none)).alias("live"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def spell(spans: Column) -> Column:
    """kind:start:end of spans by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    return F.array_join(F.transform(plain, lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)), ",")


def redact(df: DataFrame, rule: Ownership = Ownership(), mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """df with each live value's span replaced by mask. Widely copied examples and all other text stay as they are. corpus: as in scan()."""
    found = scan(df, rule, id_col, text_col, corpus=corpus).where("n_live > 0").groupBy("key").agg(F.first("live").alias("__live")).withColumnRenamed("key", "__k")
    out = df.withColumn("__key", row_key(id_col, text_col)).join(found, F.col("__key") == F.col("__k"), "left")
    text = F.col(text_col)

    def between(pieces: Column, start: Column, end: Column) -> Column:
        """Code points start to end of the text that pieces make up; only those pieces are joined that hold some."""
        first = F.floor(start / PIECE).cast("int")
        long = F.floor((end - 1) / PIECE).cast("int") - first + 1
        return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, long), ""), F.pmod(start, F.lit(PIECE)).cast("int") + 1, (end - start).cast("int"))).otherwise("")

    def cut(live: Column) -> Column:
        """What lies between the spans, which may overlap: a part starts where the spans so far end."""
        ends = F.concat(F.array(F.lit(0).cast("bigint")), running(F.transform(live, lambda s: s.end), lambda a, b: F.greatest(a, b), F.lit(0)))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        parts = lambda x: F.transform(live, lambda s, i: F.when(s.start >= x.ends[i], F.concat(between(x.pieces, x.ends[i], s.start), F.lit(mask))).otherwise(""))
        rest = lambda x: between(x.pieces, F.element_at(x.ends, -1), F.length(text).cast("bigint"))
        return let(F.struct(ends.alias("ends"), pieces.alias("pieces")), lambda x: F.concat(F.array_join(parts(x), ""), rest(x)))

    return out.withColumn(text_col, F.when(F.col("__live").isNotNull(), cut(F.col("__live"))).otherwise(text)).select(*df.columns)

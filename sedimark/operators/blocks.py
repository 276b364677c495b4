"""From texts to sources, blocks, candidates, chunks and evidence selections."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators.ordered import folded, numbered


def sources(docs: DataFrame) -> DataFrame:
    """One row for each distinct text: source_id, content_sha256, ord (its first doc_id), lang of that document, copies."""
    d = docs.select("doc_id", "text", "lang", F.sha2("text", 256).alias("content_sha256"))
    # texts stay behind: only hashes and ids are shuffled here
    return d.groupBy("content_sha256").agg(F.min("doc_id").alias("ord"), F.min_by("lang", "doc_id").alias("lang"), F.count(F.lit(1)).alias("copies")).withColumn("source_id", F.substring("content_sha256", 1, 12))


def blocks(docs: DataFrame) -> DataFrame:
    """source_id, lang, ord, block_ord (from 1), block_id and text of the lines, blank ones left out, of each distinct text."""
    first = sources(docs).select(F.col("ord").alias("doc_id"), "source_id", F.col("lang").alias("first_lang"))
    lines = F.filter(F.split("text", "\n+"), lambda x: x.rlike(r"\S"))
    rows = docs.join(first, "doc_id").select("source_id", F.col("first_lang").alias("lang"), F.col("doc_id").alias("ord"), F.posexplode(lines).alias("i", "line"))
    return rows.select("source_id", "lang", "ord", (F.col("i") + 1).cast("long").alias("block_ord"), F.concat_ws("-b", "source_id", F.col("i") + 1).alias("block_id"), T.trimmed(F.col("line")).alias("text"))


def candidates(docs: DataFrame) -> DataFrame:
    """A candidate unit for each block, with kind, confidence and heading level."""
    t = F.col("text")
    return blocks(docs).select(F.concat(F.lit("cu-"), "block_id", F.lit("-1")).alias("unit_id"), "source_id", "block_id", "lang", "ord", "block_ord", t.alias("content"), T.kind(t).alias("kind"), T.confidence(t).alias("confidence"), T.heading_level(t).alias("heading_level"))


def review_flags(units: DataFrame) -> DataFrame:
    """item_id, reason and severity: a unit may have none, one or two."""
    low = F.when(F.col("confidence") < 0.5, F.struct(F.lit("low_confidence").alias("reason"), F.lit("warning").alias("severity")))
    thin = F.when(F.length("content") < 20, F.struct(F.lit("thin_content").alias("reason"), F.lit("info").alias("severity")))
    return units.select(F.col("unit_id").alias("item_id"), F.explode(F.array_compact(F.array(low, thin))).alias("f")).select("item_id", "f.*")


def quality_flags(units: DataFrame) -> DataFrame:
    """unit_id and reason: little confidence, too thin, too long, or the same content as another unit."""
    n = F.length("content")
    own = F.array_compact(F.array(F.when(F.col("confidence") < 0.3, F.lit("low_confidence")), F.when(n < 20, F.lit("thin_content")), F.when(n > 2000, F.lit("oversized"))))
    flags = units.select("unit_id", F.explode(own).alias("reason"))
    return flags.unionByName(conflict_members(units).select("unit_id", F.lit("conflict").alias("reason")))


def conflict_groups(units: DataFrame) -> DataFrame:
    """conflict_no, content_sha256, members and first_id of contents that several units have. Numbers count all distinct contents in order of their first unit, so they have gaps."""
    g = units.select("unit_id", "ord", "block_ord", F.sha2("content", 256).alias("content_sha256")).groupBy("content_sha256")
    g = g.agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("ord", "block_ord", "unit_id")).alias("first"))
    # numbered over all contents, before single ones are left out
    return numbered(g, [], ["first"], "conflict_no").where("members > 1").select("conflict_no", "content_sha256", "members", F.col("first.unit_id").alias("first_id"))


def conflict_members(units: DataFrame) -> DataFrame:
    """unit_id of units whose content another unit has too."""
    h = units.select("unit_id", F.sha2("content", 256).alias("h"))
    return h.join(h.groupBy("h").count().where("count > 1").select("h"), "h", "left_semi").select("unit_id")


def pack_chunks(blocks_: DataFrame, target: int) -> DataFrame:
    """block_id, chunk_no and tokens: blocks of a source fill a chunk until the next one would pass target. A stream over each source's blocks in order."""
    items = blocks_.select("source_id", "block_ord", "block_id", T.token_estimate_chunk(F.col("text")).alias("tokens"))

    def step(state, source, block, tokens):
        full = state[1] > 0 and state[1] + tokens > target
        state[:] = [state[0] + full, tokens if full else state[1] + tokens]
        return [(block, state[0], tokens)]

    return folded(items, "source_id", ["block_ord"], ["block_id", "tokens"], lambda: [1, 0], step, "block_id string, chunk_no bigint, tokens bigint")


def reference_digests(units: DataFrame) -> DataFrame:
    """source_id, kind, units and sha256 of the rendered reference of each source and kind: its units in order, one a line. Rendered piece by piece into a hash."""
    rows = units.select(F.to_json(F.struct("source_id", "kind")).alias("page"), "source_id", "kind", "block_ord", "content")

    def step(state, page, source, kind, content):
        state[0].update((b"\n" if state[1] else b"") + content.encode())
        state[1:] = [state[1] + 1, source, kind]
        return []

    close = lambda state, page: [(state[2], state[3], state[1], state[0].hexdigest())]
    return folded(rows, "page", ["block_ord"], ["source_id", "kind", "content"], lambda: [hashlib.sha256(), 0, None, None], step, "source_id string, kind string, units bigint, sha256 string", close)


def section_top(units: DataFrame, k: int) -> DataFrame:
    """source_id, section, place and unit_id: of every four blocks a section, its distinct contents, best kind first, at most k."""
    order = F.when(F.col("kind") == "principle", 0).when(F.col("kind") == "technique", 1).when(F.col("kind") == "term", 2).otherwise(3)
    rows = units.select("source_id", "unit_id", "content", "block_ord", order.alias("priority"), (F.floor((F.col("block_ord") - 1) / 4) + 1).cast("long").alias("section"))
    same = Window.partitionBy("source_id", "section", F.sha2("content", 256)).orderBy("priority", "block_ord")
    rows = rows.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    best = Window.partitionBy("source_id", "section").orderBy("priority", "block_ord")
    return rows.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k).select("source_id", "section", "place", "unit_id", "priority", "block_ord")


def book_top(units: DataFrame, per_section: int, per_book: int) -> DataFrame:
    """source_id, place and unit_id: the best of what the sections keep."""
    best = Window.partitionBy("source_id").orderBy("priority", "block_ord")
    return section_top(units, per_section).withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= per_book).select("source_id", "place", "unit_id")


def context(turns: DataFrame, budget: int) -> DataFrame:
    """Each turn with the tail of the one before and the head of the one after, of 4 * budget characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = 4 * budget
    return turns.select("conv_id", "turn", F.coalesce(F.right(F.lag("text").over(w), F.lit(n)), F.lit("")).alias("before"), F.coalesce(F.left(F.lead("text").over(w), F.lit(n)), F.lit("")).alias("after"))


def canonical_json(df: DataFrame) -> Column:
    """A row as canonical JSON: its columns in order of name, no spaces, nulls kept, characters as they are."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def joined_digests(members: DataFrame, key: str, member: str, between: str, first: str = "", last: str = "", order: list[str] | None = None) -> DataFrame:
    """key, entries and the SHA-256 digest of first, each key's members in order (by themselves or by order) with between between them, and last. Streamed into a hash, so that no key is gathered."""

    def step(state, _, value):
        state[0].update(((between if state[1] else first) + value).encode())
        state[1] += 1
        return []

    def close(state, k):
        state[0].update(last.encode())
        return [(k, state[1], state[0].hexdigest())]

    kind = members.schema[key].dataType.simpleString()
    return folded(members, key, order or [member], [member], lambda: [hashlib.sha256(), 0], step, f"{key} {kind}, entries bigint, digest string", close)


def map_digests(entries: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, entries and the digest of the canonical JSON of each key's map from name to value, names in order."""
    quoted = F.to_json(F.struct(F.col(name).alias("n"))), F.to_json(F.struct(F.col(value).alias("v")))
    entry = F.concat(F.expr("substr(__n, 6, length(__n) - 6)"), F.lit(":"), F.expr("substr(__v, 6, length(__v) - 6)"))
    rows = entries.withColumn("__n", quoted[0]).withColumn("__v", quoted[1]).select(key, entry.alias("__entry"))
    return joined_digests(rows, key, "__entry", ",", "{", "}")


def split_texts(texts: DataFrame, target: int) -> DataFrame:
    """id, nth (from 1), fragment and tokens of texts (id, text) cut into fragments of at most target tokens (where a character alone does not have more), which together are the text.

    Whole lines are put together while they fit; a longer line is cut into the longest prefixes that fit, of at most three characters a token.
    """
    kind = texts.schema["id"].dataType.simpleString()
    tokens = lambda wide, other: (wide + 1) // 2 + (other + 3) // 4
    ideograph = re.compile(T.CJK_NARROW.replace(r"\x{", r"\u").replace("}", ""))

    def cut(line: str) -> Iterator[str]:
        wide = np.concatenate([[0], np.cumsum([bool(ideograph.match(c)) for c in line])])
        at = 0
        while at < len(line):
            ends = np.arange(at + 1, min(len(line), at + 3 * target) + 1)
            w = wide[ends] - wide[at]
            end = at + max(1, int(np.searchsorted(tokens(w, ends - at - w), target, "right")))
            yield line[at:end]
            at = end

    def fragments(text: str) -> Iterator[tuple[str, int]]:
        held, wide, other = [], 0, 0
        for line in text.splitlines(keepends=True):
            w = len(ideograph.findall(line))
            o = len(line) - w
            if held and tokens(wide + w, other + o) > target:
                yield "".join(held), tokens(wide, other)
                held, wide, other = [], 0, 0
            if tokens(w, o) > target:
                for piece in cut(line):
                    n = len(ideograph.findall(piece))
                    yield piece, tokens(n, len(piece) - n)
            else:
                held.append(line)
                wide, other = wide + w, other + o
        if held or not text:
            yield "".join(held), tokens(wide, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nth, out, sizes = [], [], [], []
            for i, text in enumerate(batch["text"]):
                for k, (piece, n) in enumerate(fragments(text.as_py() or ""), 1):
                    at.append(i)
                    nth.append(k)
                    out.append(piece)
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(nth, pa.int64()), pa.array(out, pa.string()), pa.array(sizes, pa.int64())], ["id", "nth", "fragment", "tokens"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, nth bigint, fragment string, tokens bigint")

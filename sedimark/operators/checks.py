"""Integrity checks, findings and their rollups."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators.ordered import carried

#: Severities in order, and the checks that publication asks for.
RANK = {"pass": 1, "warn": 2, "fail": 3}
REQUIRED = ("frontmatter", "source-coverage", "copyright", "injection", "budget")


def line_codes(line: Column) -> Column:
    """The codes of steering phrases and hidden characters in a line."""
    hidden = lambda pattern, code: F.when(line.rlike(pattern), F.lit(code))
    return F.array_compact(F.array(T.injection_code(line), hidden(T.ZERO_WIDTH, "hidden.zero_width"), hidden(T.DIRECTIONAL, "hidden.directional"), hidden(T.CONTROL, "hidden.control")))


def line_findings(lines: DataFrame) -> DataFrame:
    """id, line_no, code and severity of steering phrases and hidden characters. lines: (id, line_no, line)."""
    return lines.select("id", "line_no", F.explode(line_codes(F.col("line"))).alias("code")).withColumn("severity", F.lit("fail"))


def split_lines(docs: DataFrame) -> DataFrame:
    """id, line_no (from 1) and line of documents (id, text)."""
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def unfenced_lines(docs: DataFrame) -> DataFrame:
    """id, line_no (from 1) and line of documents (id, text), outside code fences: where the fence lines so far are even in number. Within each row, without a shuffle."""
    fence = lambda x: x.startswith("```")
    lines = F.split("text", "\n")
    marked = T.once(lines, lambda ls: T.once(T.running_sum(F.transform(ls, lambda x: fence(x).cast("bigint"))), lambda n: F.transform(ls, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("line"), (n[i] % 2 == 0).alias("out")))))
    return docs.select("id", F.explode(marked).alias("l")).select("id", "l.line_no", "l.line", "l.out").where(F.col("out") & ~fence(F.col("line"))).drop("out")


# Fixed value: a citation line with its quote.
QUOTE_LINE = r'^\s*-\s+([^\s/]+)\s*/\s*(\S+)\s+—\s+"(.+)"\s*$'


def quotes(files: DataFrame) -> DataFrame:
    """path, line_no, source_id, block_id, quote and words of the citation lines of reference files (path, text) that carry a quote."""
    lines = split_lines(files.select(F.col("path").alias("id"), "text")).where(F.col("line").rlike(QUOTE_LINE))
    part = lambda i: F.regexp_extract("line", QUOTE_LINE, i)
    return lines.select(F.col("id").alias("path"), "line_no", part(1).alias("source_id"), part(2).alias("block_id"), part(3).alias("quote"), T.effective_words(part(3)).alias("words"))


def parsed_arrays(rows: DataFrame, raw: str) -> DataFrame:
    """rows with objects, how many objects the array in raw holds for a lenient reader, and fault, what a strict one refuses: no_json, no_array or no_objects (something else among them). Lines with code fences are left out."""
    bare = F.trim(F.col(raw))
    text = F.when(bare.startswith("```"), F.array_join(F.filter(F.split(bare, "\n"), lambda x: ~F.trim(x).startswith("```")), "\n")).otherwise(bare)
    rows = rows.withColumn("__text", text).withColumn("__value", F.try_parse_json("__text"))
    kinds = F.transform(F.try_variant_get("__value", "$", "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    rows = rows.withColumn("__array", F.schema_of_variant("__value").startswith("ARRAY")).withColumn("__objects", F.when(F.col("__array"), kinds))
    objects = F.coalesce(F.size(F.filter("__objects", lambda x: x)), F.lit(0))
    fault = F.when(F.col("__value").isNull(), "no_json").when(~F.col("__array"), "no_array").when(objects < F.size("__objects"), "no_objects")
    return rows.withColumn("objects", F.greatest(objects, F.lit(0)).cast("long")).withColumn("fault", fault).drop("__text", "__value", "__array", "__objects")


def links(pages: DataFrame) -> DataFrame:
    """page_id and target of each link of a page's html."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))


# The head of a page, how a mapping begins, and a field's line (NAME stands for its name) with its value in quotes or plain.
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"
MAPPING = r"^\s*[A-Za-z_][A-Za-z0-9_-]*\s*:(?:\s|$)"
FIELD_LINE = r"""(?m)^NAME:[ \t]*(?:(["'])([^"'\n]*)["'][ \t]*|([^"'\n#][^\n]*))$"""
# Words that tell of a method, and the section that belongs to it, in lower case.
TIME_SIGNALS = ("pomodoro", "番茄钟", "番茄工作法", "estimate feedback", "estimate-versus-actual", "估算反馈", "预估", "实际时长", "偏差", "interruption", "中断", "short break", "long break", "短休息", "长休息", "timebox", "time box", "时间盒")
HABIT_SIGNALS = ("habit", "micro-habit", "microhabit", "习惯", "微习惯", "cue/trigger", "线索", "奖励", "reward")
TIME_HEADING, HABIT_HEADING = "## runtime execution scaffolding", "## habit execution scaffolding"
# Names that a system reserves, as a whole part of a path or before its first dot.
RESERVED = r"/(?:aux|clock\$|com[1-9]|con|lpt[1-9]|nul|prn)(?:\.[^/]*)?/"


def frontmatter(pages: DataFrame) -> DataFrame:
    """id and code of what is wrong with the head of pages (id, text): missing, not_mapping, or what its name (a slug) and description (ten characters at least) lack."""
    head = F.regexp_extract("text", FRONT, 1)
    field = lambda name: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(F.col("head"), FIELD_LINE.replace("NAME", name), i)), F.lit("")) for i in (2, 3)])
    rows = pages.select("id", F.col("text").rlike(FRONT).alias("has"), head.alias("head")).select("id", "has", "head", field("name").alias("name"), field("description").alias("description"))
    name = F.when(F.col("name").isNull(), "name_missing").when(~F.col("name").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "name_pattern")
    description = F.when(F.col("description").isNull(), "description_missing").when(F.length("description") < 10, "description_short")
    mapping = F.col("head").rlike(MAPPING) | (F.trim("head") == "")
    codes = F.when(~F.col("has"), F.array(F.lit("missing"))).when(~mapping, F.array(F.lit("not_mapping"))).otherwise(F.array_compact(F.array(name, description)))
    return rows.select("id", F.explode(codes).alias("code"))


def scaffolding(pages: DataFrame) -> DataFrame:
    """id and code of pages (id, text) that show signals of time boxes or habits without their section."""
    has = lambda words: F.col("t").rlike("|".join(words))
    time = F.when(has(TIME_SIGNALS) & ~F.col("t").contains(TIME_HEADING), "missing_time_scaffolding")
    habit = F.when(has(HABIT_SIGNALS) & ~F.col("t").contains(HABIT_HEADING), "missing_habit_scaffolding")
    return pages.select("id", T.casefold(F.col("text")).alias("t")).select("id", F.explode(F.array_compact(F.array(time, habit))).alias("code"))


def missing_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """id, line_no and target of links to reference files that files (target) lacks."""
    found = F.regexp_extract_all("line", F.lit(r"`(references/[A-Za-z0-9_/-]+\.md)`"), F.lit(1))
    lines = split_lines(pages.where(F.col("text").contains("`references/"))).select("id", "line_no", F.explode(found).alias("target"))
    return lines.join(files.select("target").distinct(), "target", "left_anti").select("id", "line_no", "target")


def inferred_only(units: DataFrame) -> DataFrame:
    """source_id and executable, the number of executable units, of sources that have some but none with evidence of its own. units: (source_id, kind, evidence_level)."""
    from sedimark.operators.governance import DIRECT, EXECUTABLE

    rows = units.where(F.col("kind").isin(*EXECUTABLE)).groupBy("source_id").agg(F.count(F.lit(1)).alias("executable"), F.bool_or(F.col("evidence_level").isin(*DIRECT)).alias("direct"))
    return rows.where("not direct").select("source_id", "executable")


def safe_relative(path: Column) -> Column:
    """Whether a path is a relative one with forward slashes that stays in its folder."""
    return ~(path.contains("\\") | path.startswith("/") | path.rlike("^[A-Za-z]:") | (path == "") | F.concat(F.lit("/"), path, F.lit("/")).rlike(r"/(?:\.|\.\.)/"))


def safe_member(path: Column) -> Column:
    """Whether a path may be a member of a package on any system: no roots, drives, controls, empty or dotted parts, trailing dots or spaces, colons or reserved names."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    framed = F.concat(F.lit("/"), p, F.lit("/"))
    bad = (p == "") | p.startswith("/") | p.contains(":") | p.rlike(r"[\x00-\x1F]") | framed.rlike(r"/(?:|\.|\.\.)/") | framed.rlike(r"[ .]/") | F.lower(framed).rlike(RESERVED)
    return ~bad


def worst_by_check(findings: DataFrame) -> DataFrame:
    """check_id, status (the worst severity), n findings and n_codes. findings: (check_id, severity, code[, n])."""
    rank = F.when(F.col("severity") == "fail", 3).when(F.col("severity") == "warn", 2).otherwise(1)
    worst = F.max(rank)
    return findings.groupBy("check_id").agg(F.when(worst == 3, "fail").when(worst == 2, "warn").otherwise("pass").alias("status"), (F.sum("n") if "n" in findings.columns else F.count(F.lit(1))).alias("n"), F.countDistinct("code").alias("n_codes"))


def gate(checks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """One row: missing required checks, failed checks, and whether a release may be published. checks: (check_id, status)."""
    spark = checks.sparkSession
    asked = spark.createDataFrame([(c,) for c in required], "check_id string")
    missing = asked.join(checks, "check_id", "left_anti").select(F.lit("missing").alias("what"), "check_id")
    failed = checks.where(F.col("status").isin("fail", "not_run")).select(F.lit("failed").alias("what"), "check_id")
    names = lambda what: F.array_join(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.col("check_id")))), ",")
    both = missing.unionByName(failed).agg(names("missing").alias("missing"), names("failed").alias("failed"))
    return both.withColumn("publishable", (F.col("missing") == "") & (F.col("failed") == ""))


def unknown_refs(refs: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """References whose key no source has, with how often each occurs."""
    return refs.join(sources.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def resolution(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: distinct references, how many are known, and their share (1 without references)."""
    r = refs.select(key).distinct()
    hit = known.select(key).distinct().withColumn("hit", F.lit(1))
    return r.join(hit, key, "left").agg(F.count(F.lit(1)).alias("refs"), F.count("hit").alias("known")).withColumn("ratio", F.coalesce(F.col("known") / F.nullif(F.col("refs"), F.lit(0)), F.lit(1.0)))


def islands(quotes: DataFrame, warn: int, fail: int) -> DataFrame:
    """source, first, n, words and code of runs of quotes with consecutive numbers whose words add up to more than warn. quotes: (source, number, words)."""
    rows = carried(quotes.withColumn("tie", F.monotonically_increasing_id()), ["source"], ["number", "tie"], before={"was": F.col("number")})
    rows = carried(rows, ["source"], ["number", "tie"], {"run": F.when(F.col("number") == F.col("was") + 1, 0).otherwise(1)})
    runs = rows.groupBy("source", "run").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).where("n >= 2")
    return runs.where(F.col("words") > warn).select("source", "first", "n", "words", F.when(F.col("words") > fail, "fail").otherwise("warn").alias("code"))


#: Keywords that one automaton holds at most.
KEYWORDS_AT_ONCE = 50_000


def _keyword_hits(texts: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(slot_id, matched): in how many rows of texts (t) any keyword of a slot occurs. One automaton of all keywords (keyword, slot_id) runs over each text; a task sends one count for each slot."""
    if not keys:
        return texts.sparkSession.createDataFrame([], "slot string, matched bigint")
    words = sorted({k for k, _ in keys})
    slots = sorted({s for _, s in keys}, key=str)
    place = {s: i for i, s in enumerate(slots)}
    of: dict[str, list[int]] = {}
    for k, s in keys:
        of.setdefault(k, []).append(place[s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        sets = [np.unique(of[w]) for w in words]
        counts = np.zeros(len(slots), np.int64)
        for batch in batches:
            for t in batch["t"]:
                if found := {i for _, i in automaton.iter(t.as_py())}:
                    counts[np.unique(np.concatenate([sets[i] for i in found]))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "n"])

    hits = texts.select("t").where("t is not null").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("matched"))
    names = texts.sparkSession.createDataFrame(list(enumerate(map(str, slots))), "i bigint, slot string")
    return hits.join(F.broadcast(names), F.col("at") == F.col("i")).select("slot", "matched")  # at most KEYWORDS_AT_ONCE rows


def keyword_counts(texts: DataFrame, slots: DataFrame, keywords: str) -> DataFrame:
    """(slot, matched): rows of texts (t) in which any of a slot's keywords occurs as a substring. slots (slot_id, keywords, ...) is a stated set of queries, taken in blocks of about KEYWORDS_AT_ONCE keywords."""
    n = slots.agg(F.coalesce(F.sum(F.size(keywords)), F.lit(0))).first()[0]
    blocks = max(1, -(-n // KEYWORDS_AT_ONCE))
    out = None
    for b in range(blocks):
        mine = slots.where(F.pmod(F.xxhash64("slot_id"), F.lit(blocks)) == b).select(F.explode(keywords).alias("k"), "slot_id").where("k <> ''")
        hits = _keyword_hits(texts, [(r[0], r[1]) for r in mine.collect()])  # a block of keywords
        out = hits if out is None else out.unionByName(hits)
    return out


def slot_coverage(units: DataFrame, slots: DataFrame, kinds: tuple[str, ...], structure: DataFrame | None = None) -> DataFrame:
    """slot_id and matched: how many units of a wanted kind have any of the slot's keywords as a substring, or how many entries of structure (t) have any of its structure_keywords, whichever is more.

    slots: (slot_id, keywords[, structure_keywords]), lower-cased.
    """
    hits = keyword_counts(units.where(F.col("kind").isin(*kinds)).select(F.lower("content").alias("t")), slots, "keywords")
    if structure is not None:
        hits = hits.unionByName(keyword_counts(structure.select(F.lower("t").alias("t")), slots, "structure_keywords"))
    hits = hits.groupBy("slot").agg(F.max("matched").alias("matched"))
    return slots.select("slot_id").join(hits, F.col("slot_id").cast("string") == F.col("slot"), "left").select("slot_id", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def last_status(checks: DataFrame) -> DataFrame:
    """check_id and the status that was reported last (ord)."""
    w = Window.partitionBy("check_id").orderBy(F.col("ord").desc())
    return checks.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("check_id", "status")

"""The compiled view of a source's units: ordered steps, the references behind them, and the contract they state.

Units are rows (source_id, unit_id, kind, content, ord); rejected and superseded ones are left out by usable() of products.
Steps are numbered by ranges, so a source with a third of all units spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import once
from sedimark.operators.ordered import numbered
from sedimark.sources.scratch import staged

# Kinds whose units are steps of a workflow, in their order; reference files by kind, in theirs.
STEP_KINDS = ("framework", "technique", "decision_rule", "checklist", "principle")
REFERENCES = (
    ("framework", "references/frameworks.md"),
    ("principle", "references/principles.md"),
    ("technique", "references/techniques.md"),
    ("case", "references/cases.md"),
    ("term", "references/terms.md"),
    ("anti_pattern", "references/anti-patterns.md"),
    ("checklist", "references/checklists.md"),
    ("decision_rule", "references/decision-rules.md"),
)
# The step behind all others, and the only one of a source without steps.
ROUTING = ("Consult detailed references", "Load the matching reference file for techniques, terms, cases and checklists before acting.")
ALONE = ("Apply knowledge from references", "No framework/principle units were provided; consult the reference files for actionable detail.")
# How long a label's line and a description may be.
LABEL, DESCRIPTION = 80, 240
#: Characters of white space and of line ends, as classes.
BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANKS = "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}"


def stripped(t: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(t, F.lit(BLANKS))


def first_line(t: Column) -> Column:
    return F.when(t.rlike(f"[{LINE_END}]"), F.regexp_extract(stripped(t), f"^[^{LINE_END}]*", 0)).otherwise(stripped(t))


def one_line(t: Column) -> Column:
    """The lines that are not blank, trimmed and joined by spaces."""
    lines = F.transform(F.split(t, f"[{LINE_END}]"), stripped)
    return F.when(t.rlike(f"[{LINE_END}]"), F.array_join(F.filter(lines, lambda x: x != ""), " ")).otherwise(stripped(t))


def step_label(kind: Column, content: Column) -> Column:
    """The kind as a title, and the first line of the content, which is cut where it is long."""
    title = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    short = once(first_line(content), lambda line: F.when(F.length(line) > LABEL, F.concat(F.left(line, F.lit(LABEL - 3)), F.lit("..."))).otherwise(line))
    return once(short, lambda short: F.when(short == "", title).otherwise(F.concat(title, F.lit(": "), short)))


def step_description(content: Column) -> Column:
    cut = lambda text: F.concat(F.rtrim(F.left(text, F.lit(DESCRIPTION - 3)), F.lit(BLANKS)), F.lit("..."))
    return once(one_line(content), lambda text: F.when(F.length(text) > DESCRIPTION, cut(text)).otherwise(text))


def reference_files(units: DataFrame) -> DataFrame:
    """source_id and files: the reference files of the kinds that a source has, in their order, joined by commas."""
    kinds = units.groupBy("source_id").agg(F.collect_set("kind").alias("kinds"))
    files = F.array_compact(F.array(*[F.when(F.array_contains("kinds", kind), F.lit(name)) for kind, name in REFERENCES]))
    return kinds.select("source_id", F.array_join(files, ",").alias("files"))


def workflow(units: DataFrame) -> DataFrame:
    """source_id, place (from 1), step, description and refs: the units that tell what to do by kind and ord, each with its id as reference, and a last step that names the reference files; a source without such units has one step that names them.

    A null content is empty; kinds outside the fixed ones have no step and no file; ties of ord are in any order of unit_id.
    """
    units = staged(units.select("source_id", "unit_id", "kind", "content", "ord"), "units", "zstd")  # read four times
    rank = F.create_map(*[F.lit(x) for kv in enumerate(STEP_KINDS) for x in kv[::-1]])
    content = F.coalesce("content", F.lit(""))
    own = units.where(F.col("kind").isin(*STEP_KINDS))
    steps = own.select("source_id", rank[F.col("kind")].alias("rank"), "ord", "unit_id", step_label(F.col("kind"), content).alias("step"), step_description(content).alias("description"), F.col("unit_id").alias("refs"))
    with_steps = own.select("source_id").distinct().withColumn("has", F.lit(True))
    ends = reference_files(units).join(with_steps, "source_id", "left")
    said = lambda i: F.when(F.col("has"), ROUTING[i]).otherwise(ALONE[i])
    last = ends.where("has is null or files <> ''").select("source_id", F.lit(len(STEP_KINDS)).alias("rank"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("unit_id"), said(0).alias("step"), said(1).alias("description"), F.col("files").alias("refs"))
    return numbered(steps.unionByName(last), ["source_id"], ["rank", "ord", "unit_id"], "place", 1).select("source_id", "place", "step", "description", "refs")


def contract_items(units: DataFrame, column: str) -> DataFrame:
    """source_id, place (from 1) and item: the statements in an array column of a source's units, trimmed, once each in the order in which they are first seen; blank ones and nulls are left out."""
    items = units.select("source_id", "ord", "unit_id", F.posexplode(column).alias("pos", "item")).withColumn("item", stripped(F.col("item"))).where("item <> ''")
    once = items.groupBy("source_id", "item").agg(F.min(F.struct("ord", "unit_id", "pos")).alias("first"))
    return numbered(once, ["source_id"], ["first"], "place", 1).select("source_id", "place", "item")


def examples(units: DataFrame) -> DataFrame:
    """source_id, place (from 1), unit_id and scenario of the cases among a source's units."""
    return numbered(units.where("kind = 'case'").select("source_id", "unit_id", F.col("content").alias("scenario"), "ord"), ["source_id"], ["ord", "unit_id"], "place", 1).select("source_id", "place", "unit_id", "scenario")


def furthest_progress(events: DataFrame, key: str, order: list[str], stage: str, fraction: Column, stages: dict[str, float]) -> DataFrame:
    """key and percent: the weighted fractions of all stages after all events of a key.

    A stage counts with the furthest of its own fractions, between 0 and 1, and fully if a later stage had an event before it had its first; stages that are
    not among the given are left out. One row a key is shuffled from each task.
    """
    names, total = list(stages), sum(stages.values())
    kept = events.where(F.col(stage).isin(*names)).withColumn("__f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)))
    mine = lambda n, x: F.when(F.col(stage) == n, x)
    by = kept.groupBy(key).agg(*[F.min(mine(n, F.struct(*order))).alias(f"at{i}") for i, n in enumerate(names)], *[F.max(mine(n, F.col("__f"))).alias(f"f{i}") for i, n in enumerate(names)])
    percent = F.lit(0.0)
    for i, n in enumerate(names):
        later = [F.col(f"at{k}") for k in range(i + 1, len(names))]
        passed = F.lit(False)
        for x in later:
            passed = passed | (x.isNotNull() & (F.col(f"at{i}").isNull() | (x < F.col(f"at{i}"))))
        percent = percent + F.lit(stages[n] / total) * F.when(passed, 1.0).otherwise(F.coalesce(f"f{i}", F.lit(0.0)))
    return by.select(key, F.round(100 * percent, 6).alias("percent"))


# The pages of a wiki and the kinds that each shows.
WIKI = {"wiki/chapters.md": ("framework", "principle"), "wiki/glossary.md": ("term",), "wiki/patterns.md": ("principle", "anti_pattern"), "wiki/cheatsheet.md": ("technique", "checklist", "decision_rule")}


def wiki_parts(units: DataFrame) -> DataFrame:
    """source_id, file, place (from 0) and text: the pages of each source's wiki in parts, which joined by line ends, with one at the end, are the page.

    Chapters have the frameworks, numbered, and behind them one chapter of all principles; the glossary has the terms in order of their lower-cased first lines, equal ones in order of the source; patterns list
    principles and anti-patterns by their first lines; the cheatsheet has the first three lines of what tells what to do. A page without units is left out. A unit without a first line is called by its id.
    """
    units = staged(units.select("source_id", "unit_id", "kind", "content", "ord"), "units", "zstd")
    content = F.coalesce("content", F.lit(""))
    line = stripped(first_line(content))
    named = units.where(F.col("kind").isin(*{k for kinds in WIKI.values() for k in kinds})).select("source_id", "unit_id", "kind", "ord", content.alias("content"), F.when(line == "", F.col("unit_id")).otherwise(line).alias("name"), line.alias("line"))
    named = staged(named, "named", "zstd")  # each of the parts below reads it
    frameworks = numbered(named.where("kind = 'framework'"), ["source_id"], ["ord", "unit_id"], "n", 1)
    text = lambda *lines: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    blank = F.lit("")

    def parts(df: DataFrame, file: str, section: int, order: Column, body: Column) -> DataFrame:
        return df.select("source_id", F.lit(file).alias("file"), F.lit(section).alias("section"), order.alias("o1"), F.col("ord").alias("o2"), F.col("unit_id").alias("o3"), body.alias("text"))

    def heads(df: DataFrame, file: str, section: int, body: Column) -> DataFrame:
        return df.select("source_id", *[c for c in df.columns if c == "n"]).distinct().select("source_id", F.lit(file).alias("file"), F.lit(section).alias("section"), F.lit("").alias("o1"), F.lit(0).cast("bigint").alias("o2"), F.lit("").alias("o3"), body.alias("text"))

    of = lambda *kinds: named.where(F.col("kind").isin(*kinds))
    n = F.col("n").cast("string")
    chapters, glossary, patterns, cheats = WIKI
    last = units.select("source_id").distinct().join(frameworks.groupBy("source_id").agg(F.max("n").alias("n")), "source_id", "left").select("source_id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    title = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    quoted = F.transform(F.slice(F.split(stripped(F.col("content")), f"\r\n|[{LINE_END}]"), 1, 3), lambda x: F.concat(F.lit("> "), x))
    found = [
        heads(of("framework", "principle"), chapters, 0, text(F.concat(F.lit("# Chapters — "), "source_id"), blank)),
        parts(frameworks, chapters, 1, F.lpad(n, 20, "0"), text(F.concat(F.lit("## "), n, F.lit(". "), F.when(F.col("line") == "", F.concat(F.lit("Framework "), n)).otherwise(F.col("line"))), blank, F.col("content"), blank)),
        heads(of("principle").select("source_id").distinct().join(last, "source_id"), chapters, 2, text(F.concat(F.lit("## "), n, F.lit(". Principles")), blank)),
        parts(of("principle"), chapters, 3, blank, text(F.concat(F.lit("### "), "name"), blank, F.col("content"), blank)),
        heads(of("term"), glossary, 0, text("# Glossary", blank)),
        parts(of("term"), glossary, 1, F.lower("line"), text(F.concat(F.lit("**"), "name", F.lit("**")), blank, F.col("content"), blank)),
        heads(of("principle", "anti_pattern"), patterns, 0, text("# Patterns & Anti-Patterns", blank)),
        *[x for k, (kind, head) in enumerate((("principle", "## Patterns"), ("anti_pattern", "## Anti-Patterns"))) for x in (heads(of(kind), patterns, 3 * k + 1, text(head, blank)), parts(of(kind), patterns, 3 * k + 2, blank, F.concat(F.lit("- "), "name")), heads(of(kind), patterns, 3 * k + 3, blank))],
        heads(of("technique", "checklist", "decision_rule"), cheats, 0, text(F.concat(F.lit("# Cheatsheet — "), "source_id"), blank)),
        parts(of("technique", "checklist", "decision_rule"), cheats, 1, blank, F.concat_ws("\n", F.concat(F.lit("## "), title, F.lit(": "), "name"), blank, F.when(F.col("line") != "", F.array_join(quoted, "\n")), blank)),
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return numbered(rows, ["source_id", "file"], ["section", "o1", "o2", "o3"], "place").select("source_id", "file", "place", "text")


def wiki_pages(units: DataFrame) -> DataFrame:
    """source_id, file, parts and the SHA-256 of each page's text, streamed."""
    from sedimark.operators.blocks import joined_digests

    rows = wiki_parts(units).select(F.to_json(F.struct("source_id", "file")).alias("page"), "place", "text")
    pages = joined_digests(rows, "page", "text", "\n", last="\n", order=["place"])
    return pages.select(F.get_json_object("page", "$.source_id").alias("source_id"), F.get_json_object("page", "$.file").alias("file"), F.col("entries").alias("parts"), F.col("digest").alias("sha256"))


# Prompts where a product has fewer than three of its own; {} is its name. The rows of a corpus: id, kind, whose prompt it has (or its own), whether it triggers, and what is asserted.
POSITIVE = ("Use {} to complete its documented workflow.", "Apply {} to a concrete, in-scope task.", "Help me execute the {} method step by step.")
NEGATIVE = ("Reproduce the source document verbatim.", "Answer an unrelated general-knowledge question.", "Act outside the documented usage boundary without confirmation.")
FIXTURES = (
    ("PT-1", "positive_trigger", ("use", 1), True, ("skill_selected", "workflow_started")),
    ("PT-2", "positive_trigger", ("use", 2), True, ("skill_selected", "workflow_started")),
    ("PT-3", "positive_trigger", ("use", 3), True, ("skill_selected", "workflow_started")),
    ("NT-1", "negative_trigger", ("not", 1), False, ("skill_not_selected",)),
    ("NT-2", "negative_trigger", ("not", 2), False, ("skill_not_selected",)),
    ("NT-3", "negative_trigger", ("not", 3), False, ("skill_not_selected",)),
    ("EX-1", "normal_execution", ("use", 1), True, ("required_inputs_checked", "documented_output_returned")),
    ("MI-1", "missing_input", "Run {}, but I have not supplied the required input.", True, ("missing_input_reported", "no_fabrication")),
    ("CF-1", "conflict", "Run {} when two cited methods conflict.", True, ("conflict_preserved", "no_silent_resolution")),
    ("OS-1", "out_of_scope", ("not", 1), False, ("usage_boundary_enforced",)),
    ("OF-1", "output_format", "Run {} and return only its documented output contract.", True, ("output_contract_satisfied",)),
)


def _spelled(pattern: str, name: Column) -> Column:
    head, sep, tail = pattern.partition("{}")
    return F.concat(F.lit(head), name, F.lit(tail)) if sep else F.lit(head)


def fixture_rows(products: DataFrame) -> DataFrame:
    """name, refs and fixtures (an array of 11 structs, fields in order of name) of products (name, use_when, do_not_use_when, refs: arrays); blank prompts and nulls do not count."""
    name = F.col("name")

    def three(column: str, fallbacks: tuple[str, ...]) -> Column:
        own = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), stripped), lambda x: F.coalesce(x != "", F.lit(False)))
        return F.slice(F.concat(own, F.array_except(F.array(*[_spelled(f, name) for f in fallbacks]), own)), 1, 3)

    rows = products.select("name", "refs", three("use_when", POSITIVE).alias("use"), three("do_not_use_when", NEGATIVE).alias("not"))
    fixture = lambda i, kind, prompt, triggers, said: F.struct(F.array(*[F.lit(a) for a in said]).alias("assertions"), F.lit(i).alias("fixture_id"), F.lit(kind).alias("kind"), (_spelled(prompt, name) if isinstance(prompt, str) else F.col(prompt[0])[prompt[1] - 1]).alias("prompt"), F.lit(triggers).alias("should_trigger"))
    return rows.select("name", "refs", F.array(*[fixture(*f) for f in FIXTURES]).alias("fixtures"))


def fixture_corpus(products: DataFrame) -> DataFrame:
    """name, place (from 0), fixture_id, kind, prompt, should_trigger and assertions: the 11 rows of each product."""
    rows = fixture_rows(products).select("name", F.posexplode("fixtures").alias("place", "f"))
    return rows.select("name", F.col("place").cast("long").alias("place"), "f.fixture_id", "f.kind", "f.prompt", "f.should_trigger", F.array_join("f.assertions", ",").alias("assertions"))


def fixture_sets(products: DataFrame) -> DataFrame:
    """name and fixture_set_id, the digest of the canonical JSON of a product's fixtures and its sorted references."""
    refs = F.array_sort(F.coalesce("refs", F.array().cast("array<string>")))
    identity = F.struct("fixtures", refs.alias("ir_knowledge_refs"), F.lit(1).alias("schema_version"), F.col("name").alias("skill_name"))
    return fixture_rows(products).select("name", F.sha2(F.to_json(identity), 256).alias("fixture_set_id"))

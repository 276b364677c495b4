"""Rules that decide over rows of several tables: traces, packs against an evolving map, dependencies, row constraints, updates and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.operators.ordered import folded

# What the fields of a unit may hold.
KINDS = ("framework", "principle", "technique", "case", "term", "anti_pattern", "decision_rule", "checklist")
STATUSES = ("candidate", "reviewed", "approved", "rejected", "superseded")
LEVELS = ("primary", "secondary", "inferred", "user_added")
# Kinds that tell what to do, and evidence that stands on its own.
EXECUTABLE, DIRECT = ("framework", "technique", "decision_rule", "checklist"), ("primary", "secondary")


def trace_violations(declared: DataFrame, refs: DataFrame, manifests: DataFrame, blocks: DataFrame, version: int = 1) -> DataFrame:
    """(phase, ord, nth, reason, unit_id, source_id, block_id): everything that keeps units from being traced to stored sources.

    declared: (source_id, ord); refs: (unit_id, ord, ref_index, source_id, block_id); manifests: (stored_as, stored_version, source_id, version), what a stored source says of itself;
    blocks: (stored_as, nth, source_id, block_id), its extraction map. A check that stops at the first fault meets them by (phase, ord, nth).
    Undeclared and invalid references are not looked up; of a source that is not stored only that is reported.
    """
    none = F.lit(None).cast("string")
    row = lambda df, phase, ord_, nth, reason, unit=none, source=none, block=none: df.select(F.lit(phase).alias("phase"), ord_.cast("long").alias("ord"), nth.cast("long").alias("nth"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), unit.alias("unit_id"), source.alias("source_id"), block.alias("block_id"))
    c = F.col
    zero = F.lit(0)
    repeated = declared.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).where("n > 1")
    parts = [row(repeated, 1, c("ord"), zero, "duplicate_source_ids", source=c("source_id"))]
    once = declared.groupBy(c("source_id").alias("d_source")).agg(F.min("ord").alias("d_ord"))
    checked = refs.join(once, c("source_id") == c("d_source"), "left")
    invalid = c("source_id").isNull() | (c("source_id") == "") | c("block_id").isNull() | (c("block_id") == "")
    bad = checked.where(invalid | c("d_source").isNull())
    parts.append(row(bad, 2, c("ord"), c("ref_index"), F.when(invalid, "invalid_source_ref").otherwise("undeclared_source"), c("unit_id"), c("source_id"), c("block_id")))
    stored = once.join(manifests.where(c("stored_version") == version), c("d_source") == c("stored_as"), "left")
    parts.append(row(stored.where("stored_as is null"), 3, c("d_ord"), zero, "raw_version_missing", source=c("d_source")))
    other = (c("source_id") != c("stored_as")) | (c("version") != version)
    parts.append(row(stored.where(other), 3, c("d_ord"), zero, "manifest_identity_mismatch", source=c("d_source")))
    there = stored.where("stored_as is not null").select("d_source", "d_ord")
    mapped = blocks.join(there, c("stored_as") == c("d_source"))
    parts.append(row(mapped.where("source_id <> stored_as"), 3, c("d_ord"), c("nth"), "block_source_mismatch", source=c("d_source"), block=c("block_id")))
    nth = F.row_number().over(Window.partitionBy("stored_as", "block_id").orderBy("nth"))
    parts.append(row(mapped.where("source_id = stored_as").withColumn("again", nth).where("again > 1"), 3, c("d_ord"), c("nth"), "duplicate_raw_block_id", source=c("d_source"), block=c("block_id")))
    sound = checked.where(~invalid & c("d_source").isNotNull()).drop("d_ord", "d_source").join(there, c("source_id") == c("d_source"), "left_semi")
    known = mapped.select(c("stored_as").alias("k_source"), c("block_id").alias("k_block")).distinct()
    lost = sound.join(known, (c("source_id") == c("k_source")) & (c("block_id") == c("k_block")), "left_anti")
    parts.append(row(lost, 4, c("ord"), c("ref_index"), "raw_block_missing", c("unit_id"), c("source_id"), c("block_id")))
    return reduce(DataFrame.unionByName, parts)


def first_violation(violations: DataFrame) -> DataFrame:
    """One row: how many violations there are and the one that a check which stops at the first reports."""
    first = F.min(F.struct("phase", "ord", "nth", "reason", "unit_id", "source_id", "block_id"))
    return violations.agg(F.count(F.lit(1)).alias("violations"), first.alias("f")).select("violations", "f.reason", "f.unit_id", "f.source_id", "f.block_id")


def pack_decisions(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """canonical_key, ord, relation, disposition and existing_sha256 of each candidate, decided in order against what is known of its key by then.

    base and candidates: (canonical_key, ord, sha256, scope). An unknown key is new; a known content merges, after which its key is known by it alone, with both scopes; any other content is
    held against the first that is known, in conflict if their scopes overlap (trimmed, lower-cased), and becomes known too. A stream over each key whose state is what is known of it.
    """
    mark = lambda df, old: df.select("canonical_key", F.lit(old).alias("known"), F.col("ord").cast("long").alias("ord"), "sha256", "scope")
    rows = mark(base, True).unionByName(mark(candidates, False))
    plain = lambda scope: {s.strip().lower() for s in scope or ()}

    def step(seen, key, known, ord_, sha, scope):
        if known:
            seen.append((sha, plain(scope)))
            return []
        if not seen:
            seen.append((sha, plain(scope)))
            return [(key, ord_, "new", "add", None)]
        match = next((s for s in seen if s[0] == sha), None)
        if match:
            seen[:] = [(sha, match[1] | plain(scope))]
            return [(key, ord_, "duplicate", "merge", sha)]
        overlap = bool(seen[0][1] & plain(scope))
        first = seen[0][0]
        seen.append((sha, plain(scope)))
        return [(key, ord_, "overlapping" if overlap else "disjoint", "conflict_review" if overlap else "coexist_review", first)]

    order = [F.col("known").desc(), "ord"]
    return folded(rows, "canonical_key", order, ["known", "ord", "sha256", "scope"], list, step, "canonical_key string, ord bigint, relation string, disposition string, existing_sha256 string")


def row_violations(units: DataFrame) -> DataFrame:
    """(unit_id, rule) for each rule that a unit's row breaks. units: (unit_id, kind, content, refs, confidence, review_status, record_version, evidence_level, evidence_note)."""
    c = F.col
    rules: dict[str, Column] = {
        "content": F.coalesce(F.length("content"), F.lit(0)) < 1,
        "kind": ~F.coalesce(c("kind").isin(*KINDS), F.lit(False)),
        "source_refs": F.coalesce(c("refs"), F.lit(0)) < 1,
        "confidence": F.isnan("confidence") | (c("confidence") < 0) | (c("confidence") > 1),
        "review_status": ~F.coalesce(c("review_status").isin(*STATUSES), F.lit(False)),
        "record_version": F.coalesce(c("record_version"), F.lit(1)) < 1,
        "evidence_level": ~F.coalesce(c("evidence_level").isin(*LEVELS), F.lit(True)),
        "evidence_note": c("evidence_level").isin("inferred", "user_added") & (F.coalesce(c("evidence_note"), F.lit("")) == ""),
    }
    own = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    repeated = units.groupBy("unit_id").count().where("count > 1").select("unit_id", F.lit("unique_id").alias("rule"))
    return units.select("unit_id", F.explode(own).alias("rule")).unionByName(repeated)


def update_decision(change: DataFrame, errors: DataFrame, review_items: DataFrame, preserved: DataFrame) -> DataFrame:
    """One row: counts and what keeps an update from being published, the first that applies: partial_removal (units would go although sources failed), open_review, preserved_overrides, no_changes, or null."""
    counts = change.agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "removed", "modified")])
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    names = ["added", "removed", "modified", "errors", "review_items", "overrides"]
    rows = reduce(lambda a, b: a.unionByName(b, True), [one(errors, "errors"), one(review_items, "review_items"), one(preserved.select("override_id").distinct(), "overrides")], counts)
    rows = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    c = F.col
    blocker = F.when((c("removed") > 0) & (c("errors") > 0), "partial_removal").when(c("review_items") > 0, "open_review").when(c("overrides") > 0, "preserved_overrides").when(c("added") + c("removed") + c("modified") == 0, "no_changes")
    return rows.withColumn("blocker", blocker)


def patched(units: DataFrame, patches: DataFrame) -> DataFrame:
    """Units (unit_id, content, review_status) after their patches (unit_id, ord, disposition, revised) in order: the last one sets the status, the last merge with a text the content."""
    status = F.when(F.max_by("disposition", "ord") == "reject", "rejected").otherwise("reviewed")
    merge = (F.col("disposition") == "merge") & (F.coalesce("revised", F.lit("")) != "")
    last = patches.groupBy("unit_id").agg(status.alias("new_status"), F.max_by(F.when(merge, F.col("revised")), F.when(merge, F.col("ord"))).alias("new_content"))
    out = units.join(last, "unit_id", "left")
    return out.select("unit_id", F.coalesce("new_content", "content").alias("content"), F.coalesce("new_status", "review_status").alias("review_status"))


def standing_publications(log: DataFrame) -> DataFrame:
    """skill, ord and attempt of the last publication of each skill that stands: a failure cancels the one before it if both describe the same attempt.

    log: (skill, ord, success, action, attempt). A stream over each skill; what it remembers is the attempts that stand, as later failures may uncover earlier ones.
    """

    def step(stack, skill, ord_, success, action, attempt):
        if success:
            stack.append((ord_, action, attempt))
        elif stack and stack[-1][1:] == ("publish", attempt) and action == "publish":
            stack.pop()
        return []

    close = lambda stack, skill: [(skill, *stack[-1][::2])] if stack else []
    return folded(log, "skill", ["ord"], ["ord", "success", "action", "attempt"], list, step, "skill string, ord bigint, attempt string", close)

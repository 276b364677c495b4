"""From loose candidates to published units: coercion, casts, cards, publishability, reconciliation with what was rendered, merges into packs, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions import semver
from sedimark.functions import text as T
from sedimark.operators.governance import KINDS, STATUSES
from sedimark.operators.versions import INACTIVE

# What stands before a block's ordinal, by the kind of its locator.
PREFIXES = {"page": "pg", "chapter": "c", "paragraph": "p", "table": "t", "sheet": "s", "unknown": "b"}


def block_id(source: Column, kind: Column, ordinal: Column) -> Column:
    """The id of a block; null for an ordinal below 1. Unknown kinds count as the last."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.coalesce(kind, F.lit("unknown"))), F.lit("b"))
    return F.when(ordinal >= 1, F.concat(source, F.lit("-"), prefix, ordinal.cast("string")))


def cast_units(candidates: DataFrame) -> DataFrame:
    """Candidates as units: an unknown kind becomes technique, an unknown status candidate, missing references one to unknown."""
    c = F.col
    kind = F.when(c("kind").isin(*KINDS), c("kind")).otherwise("technique")
    status = F.when(c("review_status").isin(*STATUSES), c("review_status")).otherwise("candidate")
    refs = F.when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0, F.array(F.lit("unknown/unknown"))).otherwise(c("refs"))
    return candidates.withColumn("kind", kind).withColumn("review_status", status).withColumn("refs", refs)


def coerced(raw: Column) -> dict[str, Column]:
    """level (1 to 6), confidence (0 to 1, else 0.5), record_version (from 1), review_status and kind and content as text, of a loose JSON row."""
    text = lambda k: F.get_json_object(raw, f"$.{k}")
    flag = lambda k: text(k).isin("true", "false")
    number = lambda k: F.when(~flag(k), text(k).try_cast("double"))
    whole = lambda k, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number(k).try_cast("bigint"), F.lit(1)))).cast("long")
    return {
        "level": whole("level", 1, 6),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number("confidence"), F.lit(0.5)))),
        "record_version": whole("record_version", 1, (1 << 62)),
        "review_status": F.when(text("review_status").isin(*STATUSES), text("review_status")).otherwise("candidate"),
        "kind": F.coalesce(text("kind"), F.lit("")),
        "content": F.coalesce(text("content"), F.lit("")),
    }


def cards(units: DataFrame, model: str = "model") -> DataFrame:
    """What a critic gets of a unit: its content, conditions, exceptions, references and confidence, and the producing model behind a short hash."""
    return units.select("unit_id", "content", "refs", "confidence", F.left(F.sha2(F.coalesce(model, F.lit("unknown")), 256), F.lit(12)).alias("anonymized_model_id"))


def asset_candidates(units: DataFrame, manifests: DataFrame) -> DataFrame:
    """unit_id, canonical_key, content_sha256 and covered of units (unit_id, kind, content, review_status, source_id) that stand: the key is kind and hash of the content, case-folded with white space collapsed; covered tells whether a manifest (source_id) knows the source."""
    rows = units.where(~F.col("review_status").isin(*INACTIVE))
    plain = F.trim(F.regexp_replace(T.casefold(F.col("content")), r"\s+", " "))
    known = manifests.select("source_id").distinct().withColumn("__known", F.lit(True))
    return rows.join(known, "source_id", "left").select("unit_id", F.concat_ws(":", "kind", F.sha2(plain, 256)).alias("canonical_key"), F.sha2("content", 256).alias("content_sha256"), F.coalesce("__known", F.lit(False)).alias("covered"))


def publish_blockers(units: DataFrame, open_conflicts: DataFrame) -> DataFrame:
    """(reason, id) of what keeps units (unit_id, review_status) from being published: none at all, repeated ids, units that are not approved, open conflicts (conflict_id)."""
    nothing = units.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no_units").alias("reason"), F.lit(None).cast("string").alias("id"))
    twice = units.groupBy("unit_id").count().where("count > 1").select(F.lit("duplicate_id").alias("reason"), F.col("unit_id").alias("id"))
    waiting = units.where(~F.col("review_status").eqNullSafe(F.lit("approved"))).select(F.lit("not_approved").alias("reason"), F.col("unit_id").alias("id")).distinct()
    conflicts = open_conflicts.select(F.lit("open_conflict").alias("reason"), F.col("conflict_id").alias("id")).distinct()
    return nothing.unionByName(twice).unionByName(waiting).unionByName(conflicts)


def reconcile_units(expected: DataFrame, rendered: DataFrame) -> DataFrame:
    """(reason, id) where rendered units (unit_id, content) differ from expected ones (of repeated ones, from the one whose hash is last): missing, extra, repeated on either side, or with other content but for white space."""
    plain = lambda df: df.select("unit_id", F.sha2(F.trim(F.regexp_replace("content", r"\s+", " ")), 256).alias("h"))
    e = plain(expected).groupBy("unit_id").agg(F.count(F.lit(1)).alias("en"), F.max("h").alias("eh"))
    r = plain(rendered).groupBy("unit_id").agg(F.count(F.lit(1)).alias("rn"), F.min("h").alias("low"), F.max("h").alias("high"))
    both = e.join(r, "unit_id", "full_outer")
    c = F.col
    reasons = F.array_compact(F.array(F.when(c("rn").isNull(), F.lit("missing_unit")), F.when(c("en").isNull(), F.lit("extra_unit")), F.when((c("en") > 1) | (c("rn") > 1), F.lit("duplicate_unit")), F.when((c("low") != c("eh")) | (c("high") != c("eh")), F.lit("content_mismatch"))))
    return both.select(F.explode(reasons).alias("reason"), c("unit_id").alias("id"))


def reconcile_refs(expected: DataFrame, rendered: DataFrame) -> DataFrame:
    """(reason, id) where references (ref) differ as multisets: missing, extra, and among the extra ones those that are expected, only less often."""
    counts = lambda df, n: df.groupBy("ref").agg(F.count(F.lit(1)).alias(n))
    both = counts(expected, "e").join(counts(rendered, "r"), "ref", "full_outer").select("ref", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("r", F.lit(0)).alias("r"))
    reasons = F.array_compact(F.array(F.when(F.col("r") < F.col("e"), F.lit("missing_ref")), F.when(F.col("r") > F.col("e"), F.lit("extra_ref")), F.when((F.col("r") > F.col("e")) & (F.col("e") > 0), F.lit("duplicate_ref"))))
    return both.select(F.explode(reasons).alias("reason"), F.col("ref").alias("id"))


def reconcile_sources(expected: DataFrame, declared: DataFrame) -> DataFrame:
    """(reason, id) where declared sources (source_id, sha256) differ from expected ones: missing, extra, repeated on either side, or with another hash."""
    e = expected.groupBy("source_id").agg(F.count(F.lit(1)).alias("en"), F.max("sha256").alias("eh"))
    d = declared.groupBy("source_id").agg(F.count(F.lit(1)).alias("dn"), F.max("sha256").alias("dh"))
    both, c = e.join(d, "source_id", "full_outer"), F.col
    reasons = F.array_compact(F.array(F.when(c("dn").isNull(), F.lit("missing_source")), F.when(c("en").isNull(), F.lit("extra_source")), F.when((c("en") > 1) | (c("dn") > 1), F.lit("duplicate_source")), F.when(c("en").isNotNull() & c("dn").isNotNull() & ~c("eh").eqNullSafe(c("dh")), F.lit("hash_mismatch"))))
    return both.select(F.explode(reasons).alias("reason"), c("source_id").alias("id"))


def pack_release(base: DataFrame, approved: DataFrame) -> DataFrame:
    """canonical_key, sha256, scope, sources and action of a pack (canonical_key, sha256, scope, sources) with approved assets (and ord) put in: kept, inserted, or united in order where the content is equal.

    An asset whose content differs is a conflict, and its key keeps what it had; of several new assets with a new key the first by ord counts as what is there.
    """
    rows = base.select("canonical_key", F.lit(-1).cast("long").alias("ord"), "sha256", "scope", "sources").unionByName(approved.select("canonical_key", F.col("ord").cast("long").alias("ord"), "sha256", "scope", "sources"))
    first = rows.groupBy("canonical_key").agg(F.min_by(F.struct("ord", "sha256"), "ord").alias("f"))
    met = rows.join(first, "canonical_key")
    equal = F.col("sha256") == F.col("f.sha256")

    def united(name: str) -> DataFrame:
        """The distinct values of a key's equal rows in order of their first appearance."""
        values = met.where(equal).select("canonical_key", "ord", F.posexplode(name).alias("i", "v")).groupBy("canonical_key", "v").agg(F.min(F.struct("ord", "i")).alias("at"))
        return values.groupBy("canonical_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x.v).alias(name))

    out = met.groupBy("canonical_key", F.col("f.sha256").alias("sha256"), F.col("f.ord").alias("first")).agg(F.count_if(equal & (F.col("ord") > F.col("f.ord"))).alias("more"), F.count_if(~equal).alias("other"))
    out = out.join(united("scope"), "canonical_key", "left").join(united("sources"), "canonical_key", "left")
    action = F.when(F.col("other") > 0, "conflict").when(F.col("more") > 0, "unite").when(F.col("first") < 0, "keep").otherwise("insert")
    none = F.array().cast("array<string>")
    return out.select("canonical_key", "sha256", F.coalesce("scope", none).alias("scope"), F.coalesce("sources", none).alias("sources"), action.alias("action"))


def version_increases(old: Column, new: Column) -> Column:
    """Whether a pack's new version is greater than its old one; null if either is none."""
    return semver.key(new) > semver.key(old)


def manifest_differences(supplied: DataFrame, verified: DataFrame) -> DataFrame:
    """(reason, source_id) where supplied manifests (source_id, version, sha256) are not the verified ones: repeated, or missing or extra as whole rows."""
    key = ["source_id", "version", "sha256"]
    twice = supplied.groupBy("source_id").count().where("count > 1").select(F.lit("repeated").alias("reason"), "source_id")
    a, b = supplied.select(key).distinct(), verified.select(key).distinct()
    return twice.unionByName(b.exceptAll(a).select(F.lit("missing").alias("reason"), "source_id")).unionByName(a.exceptAll(b).select(F.lit("extra").alias("reason"), "source_id"))


def inventory_faults(inventory: DataFrame, members: DataFrame) -> DataFrame:
    """(reason, path) where lines of an inventory (path, sha256, any case) and members (path, sha256) differ: repeated, unlisted, unknown or with another hash."""
    twice = inventory.groupBy("path").count().where("count > 1").select(F.lit("repeated").alias("reason"), "path")
    i = inventory.groupBy("path").agg(F.lower(F.max("sha256")).alias("want"))
    both = i.join(members.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    reason = F.when(F.col("want").isNull(), "unlisted").when(F.col("have").isNull(), "unknown").when(F.col("want") != F.col("have"), "mismatch")
    return twice.unionByName(both.select(reason.alias("reason"), "path").where("reason is not null"))


def report_status(checks: DataFrame) -> DataFrame:
    """One row: status of a report from its checks (status): fail if any fails, pass_with_warnings if any warns, else pass; and how many of each there are."""
    n = lambda s: F.count_if(F.col("status") == s)
    status = F.when(n("fail") > 0, "fail").when(n("warn") > 0, "pass_with_warnings").otherwise("pass")
    return checks.agg(status.alias("status"), n("fail").alias("failed"), n("warn").alias("warned"), n("pass").alias("passed"))


def bundle_metrics(declared: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of a bundle's metrics: declared sources (source_id), candidates (unit_id, source_id, block_id: a row for each reference), those with a reference to a block of a declared source, their share (1 without candidates), and repeated ids.

    A candidate is told by its row number (row); its references share it.
    """
    known = declared.where("source_id <> ''").select("source_id").distinct().withColumn("__known", F.lit(True))
    good = F.coalesce(F.col("__known"), F.lit(False)) & (F.coalesce(F.col("block_id"), F.lit("")) != "")
    rows = candidates.join(known, "source_id", "left").groupBy("row").agg(F.first("unit_id").alias("unit_id"), F.bool_or(good).alias("supported"))
    m = rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("supported").alias("supported"), (F.count("unit_id") - F.count_distinct("unit_id")).alias("duplicate_ids"))
    m = m.unionByName(known.agg(F.count(F.lit(1)).alias("sources")), True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("sources", "candidates", "supported", "duplicate_ids")])
    return m.withColumn("unsupported", F.col("candidates") - F.col("supported")).withColumn("coverage", F.coalesce(F.try_divide("supported", "candidates"), F.lit(1.0)))

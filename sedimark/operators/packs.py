"""Reviews of pack candidates and patches, classes of emitted files, and the audit of products from before closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the first folder of an emitted file says of it.
SHAPES = {"schemas": ("schema", "exact_required"), "assets": ("asset_pack", "exact_required"), "scripts": ("tool", "exact_required"), "tools": ("tool", "exact_required"), "references": ("reference", "semantic_retrieval")}
KERNEL = ("SKILL.md", "kernel", "exact_required")
DISPOSITIONS = ("accept", "reject", "merge")


def pack_reviews(assets: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidate_id, assets, decided, missing, extra and stage of assets (candidate_id, asset_id) by decisions (candidate_id, asset_id, ord, decision).

    Of several decisions on an asset the last by ord counts. A candidate whose decided assets are not exactly its assets is review_required; it is approved if every decision approves, else rejected.
    """
    last = decisions.groupBy("candidate_id", "asset_id").agg(F.max(F.struct("ord", "decision")).alias("d"))
    both = assets.distinct().withColumn("own", F.lit(True)).join(last, ["candidate_id", "asset_id"], "full_outer")
    own, known = F.col("own").isNotNull(), F.col("d").isNotNull()
    by = both.groupBy("candidate_id").agg(F.count_if(own).alias("assets"), F.count_if(known).alias("decided"), F.count_if(own & ~known).alias("missing"), F.count_if(~own & known).alias("extra"), F.count_if(known & (F.col("d.decision") == "approve")).alias("yes"))
    stage = F.when((F.col("missing") > 0) | (F.col("extra") > 0), "review_required").when(F.col("yes") == F.col("decided"), "approved").otherwise("rejected")
    return by.select("candidate_id", "assets", "decided", "missing", "extra", stage.alias("stage"))


def patch_faults(patches: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, disposition, refs and code of patches (unit_id, disposition, refs) on units (unit_id, refs); arrays of references.

    Without a disposition a patch accepts; without references it has its unit's. unknown_unit, unknown_disposition, or unknown_refs if it names one that its unit does not have.
    """
    rows = patches.join(units.select("unit_id", F.col("refs").alias("own")), "unit_id", "left")
    disposition = F.coalesce("disposition", F.lit("accept"))
    refs = F.when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 0, F.col("refs")).otherwise(F.col("own"))
    code = F.when(F.col("own").isNull(), "unknown_unit").when(~disposition.isin(*DISPOSITIONS), "unknown_disposition").when(F.size(F.array_except(refs, "own")) > 0, "unknown_refs")
    return rows.select("unit_id", disposition.alias("disposition"), F.array_join(refs, ",").alias("refs"), code.alias("code"))


def resource_shape(path: Column) -> tuple[Column, Column]:
    """Kind and class of a file by its path, nulls for what a product does not consume."""
    top = F.split_part(path, F.lit("/"), F.lit(1))

    def pick(i: int) -> Column:
        out = F.when(path == KERNEL[0], KERNEL[1 + i])
        for name, shape in SHAPES.items():
            out = out.when(top == name, shape[i])
        return out

    return pick(0), pick(1)


def legacy_assessments(skills: DataFrame) -> DataFrame:
    """skill_id, disposition, reason and closure_hash of products (skill_id, has_main, manifest, report_code, closure_hash): manifest is the text of the closure's description, null without one.

    Products without their main file are blocked, those without a description legacy-unclosed, those whose description is no object or lacks its version, or whose validation has a code, blocked, and the others closure-ready. An id that comes twice is blocked.
    """
    valid = F.coalesce(F.get_json_object("manifest", "$.closure_version").isNotNull() & F.col("manifest").rlike(r"^\s*\{") & F.try_parse_json("manifest").isNotNull(), F.lit(False))
    reason = (
        F.when(F.col("n") > 1, "MIGRATION_INVALID").when(~F.coalesce("has_main", F.lit(False)), "MIGRATION_INVALID").when(F.col("manifest").isNull(), "MIGRATION_LEGACY_UNCLOSED")
        .when(~valid, "MIGRATION_CLOSURE_INVALID").when(F.col("report_code").isNotNull(), F.col("report_code"))
    )
    one = skills.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("has_main", "manifest", "report_code", "closure_hash")])
    rows = one.withColumn("reason", reason)
    disposition = F.when(F.col("reason").isNull(), "closure-ready").when(F.col("reason") == "MIGRATION_LEGACY_UNCLOSED", "legacy-unclosed").otherwise("blocked")
    return rows.select("skill_id", disposition.alias("disposition"), "reason", F.when(F.col("reason").isNull(), F.col("closure_hash")).alias("closure_hash"))


def escaped(json: Column) -> Column:
    """JSON text with every character beyond ASCII as \\\\uXXXX, those beyond 16 bits as two; texts of ASCII alone are left as they are."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        over = n - 0x10000
        return F.when(n < 128, c).when(n < 0x10000, code(n)).otherwise(F.concat(code(F.shiftright(over, 10) + 0xD800), code(over.bitwiseAND(0x3FF) + 0xDC00)))

    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json, ""), one), "")).otherwise(json)

"""What is built from units and how it meets its host: workflows, suggestions, designs, closures, preflights, fan-outs, releases and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators.governance import EXECUTABLE
from sedimark.operators.ordered import numbered
from sedimark.operators.versions import INACTIVE

# Phrases of a description that tell of several tasks.
MULTI_TASK = (" and also ", "; and ", "以及", "同时完成", "多个独立")


def usable(units: DataFrame) -> DataFrame:
    """All rows that are neither rejected nor superseded, whatever their version."""
    return units.where(~F.col("review_status").isin(*INACTIVE))


def multi_task(t: Column) -> Column:
    """Whether a description seems to tell of several tasks."""
    return T.casefold(t).rlike("|".join(MULTI_TASK))


def closure_findings(resources: DataFrame, files: DataFrame, versions: DataFrame, capabilities: DataFrame, host: DataFrame) -> DataFrame:
    """(id, code, blocking) of the pins of a runtime closure that its files, versions and host do not meet.

    resources: (resource_id, class, path, sha256, version); files: (path, sha256); versions: (resource_id, version); capabilities: (capability_id, kind, version, resource_id); host: (capability_id, version).
    Of a resource the first that applies counts: version_missing, version_mismatch, path_unsafe, resource_missing, hash_mismatch; an optional one is not held against versions, and its absence does not block.
    """
    from sedimark.operators.checks import safe_relative

    c = F.col
    found = resources.alias("r").join(versions.alias("v"), "resource_id", "left").join(files.alias("f"), c("r.path") == c("f.path"), "left")
    optional = c("class") == "optional"
    code = F.when(~optional & c("v.version").isNull(), "version_missing").when(~optional & (c("v.version") != c("r.version")), "version_mismatch").when(~safe_relative(c("r.path")), "path_unsafe")
    code = code.when(c("f.path").isNull(), "resource_missing").when(c("f.sha256") != c("r.sha256"), "hash_mismatch")
    own = found.select(c("resource_id").alias("id"), code.alias("code"), (~(optional & (code == "resource_missing"))).alias("blocking")).where("code is not null")
    met = capabilities.alias("c").join(host.alias("h"), "capability_id", "left").join(resources.select(c("resource_id").alias("pinned")), c("c.resource_id") == c("pinned"), "left")
    bundled, wanted = c("kind") == "bundled_script", c("kind") == "host_optional"
    code = F.when(bundled, F.when(c("pinned").isNull(), "bundled_not_pinned")).when(c("kind") == "unsupported", "capability_unsupported").when(c("h.version").isNull(), "capability_missing").when(c("h.version") != c("c.version"), "capability_mismatch")
    return own.unionByName(met.select(c("capability_id").alias("id"), code.alias("code"), (~(wanted & (code == "capability_missing"))).alias("blocking")).where("code is not null"))


def preflight(capabilities: DataFrame, host: DataFrame) -> DataFrame:
    """(capability_id, code, optional) of what a host lacks (missing) or has in another version (mismatch, which counts as missing too). capabilities: (capability_id, kind, version); host: (capability_id, version)."""
    c = F.col
    met = capabilities.where("kind <> 'bundled_script'").alias("c").join(host.alias("h"), "capability_id", "left")
    there = F.when(c("kind") != "unsupported", c("h.version"))
    codes = F.when(there.isNull(), F.array(F.lit("missing"))).when(there != c("c.version"), F.array(F.lit("mismatch"), F.lit("missing")))
    return met.select("capability_id", F.explode(codes).alias("code"), (c("kind") == "host_optional").alias("optional"))


def fan_out_violations(tasks: DataFrame, provenance: DataFrame, source_id: str, source_sha256: str) -> DataFrame:
    """(task_id, code): tasks (task_id, product_id) of one source that repeat a task or a product, or whose provenance (task_id, source_id, sha256) names another source or hash."""
    twice = lambda key, code: tasks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first")).where("n > 1").select(F.col("first").alias("task_id"), F.lit(code).alias("code"))
    other = F.when(F.col("source_id") != source_id, "other_source").when(F.col("sha256") != source_sha256, "other_hash")
    return twice("task_id", "duplicate_task").unionByName(twice("product_id", "duplicate_product")).unionByName(provenance.select("task_id", other.alias("code")).where("code is not null").distinct())


def compatibility(internal: DataFrame, external: DataFrame) -> DataFrame:
    """profile and status from internal (profile, status) and external (profile, status, blocking) evidence: fail if the internal report fails or a blocking tool fails or did not run, with warnings if anything is less than a pass."""
    c = F.col
    by = external.groupBy("profile").agg(F.bool_or(c("blocking") & c("status").isin("fail", "not_run")).alias("blocked"), F.bool_or(c("status") != "pass").alias("less"))
    rows = internal.join(by, "profile", "left")
    fail = (c("status") == "fail") | F.coalesce("blocked", F.lit(False))
    return rows.select("profile", F.when(fail, "fail").when((c("status") == "pass_with_warnings") | F.coalesce("less", F.lit(False)), "pass_with_warnings").otherwise("pass").alias("status"))


def design_scores(designs: DataFrame) -> DataFrame:
    """name and seven scores from 0 to 5 of designs (name, description, use_when, do_not_use_when, steps, steps_without_refs, references, assets, exceptions, examples: counts)."""
    c = F.col
    yes = lambda name: (c(name) > 0).cast("long")
    broad = ((c("steps") > 10) | multi_task(c("description"))).cast("long")
    scores = {
        "trigger_precision": 2 + yes("use_when") + 2 * yes("do_not_use_when"),
        "task_focus": 5 - 2 * broad,
        "workflow_executability": 2 + yes("steps") + 2 * (c("steps_without_refs") == 0).cast("long"),
        "progressive_disclosure": 2 + 3 * yes("references"),
        "deterministic_tooling": 2 + 2 * yes("assets"),
        "failure_boundary": 1 + 2 * yes("do_not_use_when") + 2 * yes("exceptions"),
        "example_quality": 1 + F.least(F.lit(4), c("examples")),
    }
    return designs.select("name", *[F.greatest(F.lit(0), F.least(F.lit(5), s)).cast("long").alias(n) for n, s in scores.items()])


def suggestions(units: DataFrame) -> DataFrame:
    """source_id, name and description of the one product that each source suggests: its units counted, its kinds in order."""
    rows = units.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    text = F.concat(F.lit("A skill compiled from "), "n", F.lit(" candidate unit(s) covering kinds: "), "kinds", F.lit("."))
    return rows.select("source_id", F.concat(F.lit("skill-"), F.left(F.sha2("source_id", 256), F.lit(8))).alias("name"), text.alias("description"))


def at_least_three(values: Column, fallbacks: list[str]) -> Column:
    """The values that are not blank, trimmed, and as many fallbacks that are not among them as make three; the first three of these."""
    own = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    more = F.array_except(F.array(*[F.lit(f) for f in fallbacks]), own)
    return F.slice(F.concat(own, more), 1, 3)


def provenance_union(groups: DataFrame) -> DataFrame:
    """key, place, source_id, locator and sha256 of groups (key, ord, source_id, locator, sha256): each reference once, in order of its first appearance."""
    once = groups.groupBy("key", "source_id", "locator", "sha256").agg(F.min("ord").alias("first"))
    return numbered(once, ["key"], ["first"], "place").select("key", "place", "source_id", "locator", "sha256")


def signature_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """owner of capability declarations (owner, capability_id, kind, version, resource_id) that differ as multisets; no resource is an empty one."""
    side = lambda df, n: df.select("owner", "capability_id", "kind", "version", F.coalesce("resource_id", F.lit("")).alias("resource_id"), F.lit(n).alias("n"))
    counts = side(left, 1).unionByName(side(right, -1)).groupBy("owner", "capability_id", "kind", "version", "resource_id").agg(F.sum("n").alias("n"))
    return counts.where("n <> 0").select("owner").distinct()


def batch_outcomes(skipped: DataFrame, resumed: DataFrame, processed: DataFrame) -> DataFrame:
    """path, status and failed of all files of a batch: those left out, those that an earlier run has finished (success or partial), and those of this run. Failed and skipped ones make the list of failures."""
    done = resumed.where(F.col("status").isin("success", "partial"))
    this = processed.join(done.select("path"), "path", "left_anti")
    rows = reduce(DataFrame.unionByName, [skipped.select("path", F.lit("skipped").alias("status")), done.select("path", "status"), this.select("path", "status")])
    return rows.withColumn("failed", F.col("status").isin("failed", "skipped"))


def release_order(releases: DataFrame) -> DataFrame:
    """pack_id, version and place (from 0) of releases whose versions are x.y.z, by number."""
    number = F.transform(F.split("version", r"\."), lambda x: x.cast("bigint"))
    return numbered(releases.withColumn("__v", number), ["pack_id"], ["__v"], "place").select("pack_id", "version", "place")


def executable_share(units: DataFrame) -> DataFrame:
    """source_id, executable and all units of each source."""
    return units.groupBy("source_id").agg(F.count_if(F.col("kind").isin(*EXECUTABLE)).alias("executable"), F.count(F.lit(1)).alias("units"))

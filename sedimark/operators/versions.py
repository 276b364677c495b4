"""Versioned collections: current views, diffs, three-way merges, supersession and overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sedimark.operators import relate

INACTIVE = ("superseded", "rejected")
#: Fields that a diff compares; those that neither collection has are left out.
FIELDS = ("kind", "content", "conditions", "exceptions", "confidence", "review_status", "source_refs")


def _fields(*sides: DataFrame) -> list[str]:
    return [f for f in FIELDS if any(f in side.columns for side in sides)]


def current_view(versions: DataFrame) -> DataFrame:
    """The row of each unit with the highest record_version, the earliest (ord) of equal ones."""
    latest = Window.partitionBy("unit_id").orderBy(F.col("record_version").desc(), "ord")
    return versions.withColumn("__nth", F.row_number().over(latest)).where("__nth = 1").drop("__nth")


def active_view(versions: DataFrame) -> DataFrame:
    """The current view without superseded and rejected units: the version is chosen first."""
    return current_view(versions).where(~F.col("review_status").isin(*INACTIVE))


def view_of_kind(versions: DataFrame, kind: str) -> DataFrame:
    """Current rows among those of a kind: the kind is chosen first, so a unit that changed its kind shows its old version."""
    return current_view(versions.where(F.col("kind") == kind))


def _differs(field: str) -> Column:
    a, b = F.col(f"o.{field}"), F.col(f"n.{field}")
    return F.coalesce(F.abs(a - b) > 1e-9, ~a.eqNullSafe(b)) if field == "confidence" else ~a.eqNullSafe(b)


def diff(old: DataFrame, new: DataFrame, allow_removals: bool = True) -> DataFrame:
    """unit_id, change and changed_fields from a full outer join of two collections."""
    both = old.alias("o").join(new.alias("n"), F.col("o.unit_id") == F.col("n.unit_id"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(_differs(f), F.lit(f)) for f in _fields(old, new)]))
    unit = F.coalesce("o.unit_id", "n.unit_id")
    both = both.select(unit.alias("unit_id"), F.col("o.unit_id").isNull().alias("add"), F.col("n.unit_id").isNull().alias("gone"), changed.alias("changed"))
    removed = "removed" if allow_removals else "unchanged"
    change = F.when(F.col("add"), "added").when(F.col("gone"), removed).when(F.size("changed") > 0, "modified").otherwise("unchanged")
    return both.select("unit_id", change.alias("change"), F.when(F.col("add") | F.col("gone"), "").otherwise(F.array_join("changed", ",")).alias("changed_fields"))


def latest_overrides(log: DataFrame) -> DataFrame:
    """Of the overrides that are not superseded, the last of each unit and field; equal times keep the first."""
    last = Window.partitionBy("unit_id", "field").orderBy(F.col("created_at").desc(), "override_id")
    return log.where(~F.col("superseded")).withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def standing_overrides(log: DataFrame) -> DataFrame:
    """The stricter reading: an override id with any superseded row does not count at all."""
    gone = log.where("superseded").select("override_id").distinct()
    return latest_overrides(log.join(gone, "override_id", "left_anti"))


def diff_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Conflicting pairs over the union of both collections; of a unit in both the old row counts. Ids are those of the units."""
    side = lambda df: df.select(F.col("unit_id").alias("id"), "kind", "content")
    return relate.conflict_pairs(side(old).unionByName(side(new.join(old.select("unit_id"), "unit_id", "left_anti"))))


def merge(base: DataFrame, new: DataFrame, overrides: DataFrame, allow_removals: bool = True) -> DataFrame:
    """Long form of a three-way merge: unit_id, field, value, outcome (new, ours, conflict, added, kept or preserved) for all units.

    Without an override, or with one that changes nothing against base, the new value stands; where both agree, or new changes nothing, ours
    does; otherwise ours stands and the row is a conflict. Units only in new are added as they are. Units only in base are left out, or with
    allow_removals=False kept with their overrides. The overrides of units that are added or left out are preserved. Lists are JSON; those of
    strings are equal as sets.
    """
    fields = _fields(base, new)
    kinds = {f: base.schema[f].dataType for f in fields}
    lists = [f for f in fields if isinstance(kinds[f], S.ArrayType)]
    text = lambda side, f: F.to_json(f"{side}.{f}") if f in lists else F.col(f"{side}.{f}").cast("string")
    both = base.alias("b").join(new.alias("n"), F.col("b.unit_id") == F.col("n.unit_id"), "full_outer")
    entries = [F.struct(F.lit(f).alias("field"), text("b", f).alias("base"), text("n", f).alias("new")) for f in fields]
    gone, add = F.col("n.unit_id").isNull(), F.col("b.unit_id").isNull()
    rows = both.where(~gone | F.lit(not allow_removals)).select(F.coalesce("b.unit_id", "n.unit_id").alias("unit_id"), gone.alias("gone"), add.alias("add"), F.explode(F.array(*entries)).alias("e"))
    rows = rows.select("unit_id", "gone", "add", "e.field", "e.base", F.when(F.col("gone"), F.col("e.base")).otherwise(F.col("e.new")).alias("new"))
    ours = overrides.select(F.col("unit_id").alias("u"), F.col("field").alias("f"), F.col("value").alias("ours"))
    rows = rows.join(ours, (F.col("unit_id") == F.col("u")) & (F.col("field") == F.col("f")) & ~F.col("add"), "left")

    def equal(a: str, b: str) -> Column:
        same = F.col(a).eqNullSafe(F.col(b))
        near = F.coalesce(F.abs(F.col(a).try_cast("double") - F.col(b).try_cast("double")) <= 1e-9, same)
        members = lambda x: F.array_sort(F.array_distinct(F.from_json(x, "array<string>")))
        sets = [f for f in lists if isinstance(kinds[f].elementType, S.StringType)]
        alike = F.when(F.col("field") == "confidence", near)
        return (alike.when(F.col("field").isin(*sets), same | members(a).eqNullSafe(members(b))) if sets else alike).otherwise(same)

    plain = F.col("f").isNull() | F.col("ours").isNull() | equal("base", "ours")
    outcome = F.when(F.col("add"), "added").when(plain & F.col("gone"), "kept").when(plain, "new").when(equal("ours", "new") | equal("base", "new"), "ours").otherwise("conflict")
    merged = rows.select("unit_id", "field", F.when(plain, F.col("new")).otherwise(F.col("ours")).alias("value"), outcome.alias("outcome"))
    ids = base.select(F.col("unit_id").alias("bu")).join(new.select(F.col("unit_id").alias("nu")), F.col("bu") == F.col("nu"), "full_outer")
    single = ids.where("bu is null or nu is null" if allow_removals else "bu is null").select(F.coalesce("bu", "nu").alias("unit_id"))
    preserved = overrides.join(single, "unit_id", "left_semi").select("unit_id", "field", "value", F.lit("preserved").alias("outcome"))
    return merged.unionByName(preserved)


def supersede(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: added units at version 1, modified ones at the next version, removed ones as superseded copies."""
    change = diff(old, new)
    o = old.select(F.col("unit_id").alias("ou"), F.col("record_version").alias("version"), F.col("review_status").alias("old_status"))
    n = new.select(F.col("unit_id").alias("nu"), F.col("review_status").alias("new_status"))
    rows = change.where("change <> 'unchanged'").join(o, F.col("unit_id") == F.col("ou"), "left").join(n, F.col("unit_id") == F.col("nu"), "left")
    gone = F.col("change") == "removed"
    return rows.select("unit_id", (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("record_version"), F.when(gone, "superseded").otherwise(F.col("new_status")).alias("review_status"), F.when(F.col("change") == "added", F.lit(None)).otherwise(F.col("unit_id")).alias("supersedes"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change of two tables (path, sha256)."""
    both = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full_outer")
    change = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "removed").when(F.col("o.sha256") != F.col("n.sha256"), "changed")
    return both.select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change")).where("change is not null")


def multiset_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, found and verdict (missing, extra) where the counts of two tables differ."""
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.lit(0).cast("long").alias("found"))
    f = found.groupBy(*keys).agg(F.lit(0).cast("long").alias("expected"), F.count(F.lit(1)).alias("found"))
    both = e.unionByName(f).groupBy(*keys).agg(F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    return both.where("expected <> found").withColumn("verdict", F.when(F.col("expected") > F.col("found"), "missing").otherwise("extra"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

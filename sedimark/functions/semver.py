"""Versions: parsing, order and ranges, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a version is, and one part of a range.
VERSION = r"^(0|[1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?(?:\.(0|[1-9][0-9]*))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
PART = r"^(>=|<=|>|<|==|~=|=)?\s*([^\s,]+)$"


def key(t: Column) -> Column:
    """A struct that orders like the version in t; null if t is none. A release follows its prereleases, whose identifiers are compared one by one, numbers as numbers; build metadata does not count."""
    t = F.trim(t)
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, VERSION, i), F.lit("")).cast("bigint"), F.lit(0))
    pre = F.regexp_extract(t, VERSION, 4)
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    rank = F.when(pre == "", F.lit("~")).otherwise(F.array_join(ids, "\x01"))
    return F.when(t.rlike(VERSION), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), rank.alias("rank")))


def satisfies(version: Column, part: Column) -> Column:
    """Whether a version's key satisfies one part of a range: an operator and a version, or a wildcard such as 1.x; null for a part that is neither."""
    part = F.trim(part)
    op, operand = F.regexp_extract(part, PART, 1), F.regexp_extract(part, PART, 2)
    numbers = F.filter(F.split(F.regexp_replace(operand, r"\.[x*]$", ""), r"\."), lambda x: x.rlike("^[0-9]+$"))
    first, second = F.get(numbers, F.lit(0)).cast("bigint"), F.get(numbers, F.lit(1)).cast("bigint")
    wild = (first.isNull() | (version["major"] == first)) & (second.isNull() | (version["minor"] == second))
    target = key(operand)
    near = (version["major"] < target["major"]) | ((version["major"] == target["major"]) & (version["minor"] < target["minor"] + 1))
    plain = F.when(op == ">", version > target).when(op == ">=", version >= target).when(op == "<", version < target).when(op == "<=", version <= target)
    plain = plain.when(op == "~=", (version >= target) & near).otherwise(version == target)
    return F.when(part == "", F.lit(True)).when(operand.rlike(r"\.[x*]$"), wild).otherwise(plain)


def in_range(version: Column, spec: Column) -> Column:
    """Whether a version's key satisfies all parts of a range, which commas separate; an empty one or * takes every version."""
    return F.when(F.trim(spec).isin("", "*"), F.lit(True)).otherwise(F.forall(F.split(spec, ","), lambda p: satisfies(version, p)))

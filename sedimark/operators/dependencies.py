"""The order in which extensions can be installed, and what keeps some from it.

The depth-first rule takes extensions by id, each behind all that it needs. A visit that starts at one extension stays within its connected component, so components are found by
pointer jumping over the graph and each is walked by the task that has it; the places over all follow from the ids at which visits start. Cycles are the strongly connected
components of the same walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions import semver
from sedimark.operators.ordered import folded, numbered
from sedimark.operators.relate import components
from sedimark.sources.scratch import staged

#: Dependencies of one connected component at most; a larger one is an error, as the rule by id is sequential within it.
LARGEST = 2_000_000


def cycles(needs: dict[str, list[str]]) -> dict[str, str]:
    """The smallest member of its cycle for each extension on one."""
    index, low, held, stack, out = {}, {}, set(), [], {}
    for start in sorted(needs):
        if start in index:
            continue
        walk = [(start, iter(needs[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    held.add(other)
                    walk.append((other, iter(needs.get(other, ()))))
                    break
                if other in held:
                    low[node] = min(low[node], index[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        held.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1 or node in needs.get(node, ()):
                        out |= dict.fromkeys(members, min(members))
    return out


def visits(needs: dict[str, list[str]], faulty: set[str]) -> dict[str, tuple[str, int]]:
    """The start of its visit and the place in it of each extension that needs no faulty one, directly or not. No cycles among these."""
    users: dict[str, list[str]] = {}
    for a, mine in needs.items():
        for b in mine:
            users.setdefault(b, []).append(a)
    barred, todo = set(faulty), list(faulty)
    while todo:
        more = [a for a in users.get(todo.pop(), ()) if a not in barred]
        barred.update(more)
        todo += more
    order: dict[str, tuple[str, int]] = {}
    seen: set[str] = set()
    for start in sorted(needs.keys() - barred):
        walk = [] if start in seen else [(start, iter(sorted(needs[start])))]
        seen.add(start)
        while walk:
            node, rest = walk[-1]
            other = next((x for x in rest if x not in seen), None)
            if other is None:
                order[walk.pop()[0]] = (start, len(order))
            else:
                seen.add(other)
                walk.append((other, iter(sorted(needs[other]))))
    return order


def install_plan(extensions: DataFrame, needs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """extension_id, place (from 0; null where it cannot be installed), problem and cycle.

    extensions: (extension_id, version), ids distinct; needs: (extension_id, needed, range). problem: missing:<id> or range:<id>, the first by id; else cycle, with the smallest member of the cycle in
    cycle; else behind for what needs one of these. Needs of ids that are no extensions are ignored, repeated ones count once.
    """
    known = extensions.select(F.col("extension_id").alias("needed"), semver.key(F.col("version")).alias("found"), F.lit(True).alias("there"))
    checked = staged(needs.join(extensions.select("extension_id"), "extension_id", "left_semi").join(known, "needed", "left").select("extension_id", "needed", F.col("there").isNotNull().alias("there"), semver.in_range(F.col("found"), F.col("range")).alias("fits")), "needs")
    fault = F.when(~F.col("there"), F.concat(F.lit("missing:"), "needed")).when(~F.coalesce("fits", F.lit(False)), F.concat(F.lit("range:"), "needed"))
    faults = checked.groupBy("extension_id").agg(F.min(F.when(fault.isNotNull(), F.struct("needed", fault.alias("fault")))).alias("f")).select("extension_id", F.col("f.fault").alias("fault"))
    edges = staged(checked.where("there").select("extension_id", "needed").distinct(), "edges")
    named = components(edges.select(F.col("extension_id").alias("a"), F.col("needed").alias("b")))
    nodes = extensions.select("extension_id").distinct().join(faults, "extension_id", "left").join(named.withColumnRenamed("id", "extension_id"), "extension_id", "left")
    rows = nodes.select("extension_id", "fault", F.coalesce("component", "extension_id").alias("component")).join(edges, "extension_id", "left")

    def step(state, component, node, fault_, needed):
        mine = state["needs"].setdefault(node, [])
        if needed is not None:
            mine.append(needed)
            state["n"] += 1
            if state["n"] > largest:
                raise ValueError(f"the component of {component} has more than {largest} dependencies")
        if fault_ is not None:
            state["faults"][node] = fault_
        return []

    def close(state, component):
        on = cycles(state["needs"])
        order = visits(state["needs"], {*state["faults"], *on})
        return [(n, *order.get(n, (None, None)), state["faults"].get(n, "cycle" if n in on else None if n in order else "behind"), on.get(n)) for n in state["needs"]]

    walked = folded(rows, "component", ["extension_id", "needed"], ["extension_id", "fault", "needed"], lambda: {"needs": {}, "faults": {}, "n": 0}, step, "extension_id string, start string, nth bigint, problem string, cycle string", close)
    walked = staged(walked, "walked")
    placed = numbered(walked.where("start is not null"), [], ["start", "nth"], "place")
    left = walked.where("start is null").withColumn("place", F.lit(None).cast("bigint"))
    return placed.unionByName(left).select("extension_id", "place", "problem", "cycle")

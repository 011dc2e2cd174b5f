"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.session import cut_lineage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable, for each id on an edge.

    Star contraction: in a round every node hooks on to the least among itself and its neighbours,
    hooks are followed two more steps, each edge is replaced by one between the two ends' hooks,
    and edges that fall together vanish. Nodes are compared by a hash of their id, so that a chain
    of ascending ids is no worse than any other: a constant share of the nodes goes in every round.
    Hooks are resolved at the end, round by round. Self-loops and repeated edges are allowed; edges
    with a null end are ignored. Each round is written to the shared folder, narrow rows only."""
    ends = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    pairs = cut_lineage(ends.select(node(left).alias("a"), node(right).alias("b")))
    nodes = pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n"))).distinct()
    live = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    rounds = []
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("n"), F.least("a", "b").alias("up")))
        further = cut_lineage(_follow(hook, hook))
        hook = cut_lineage(_follow(further, further))
        rounds.append(hook)
        moved = live.join(hook.select(F.col("n").alias("a"), F.col("up").alias("ua")), "a").join(hook.select(F.col("n").alias("b"), F.col("up").alias("ub")), "b")
        live = cut_lineage(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    found = nodes.select("n", F.col("n").alias("up"))
    for hook in rounds:
        found = _follow(found, hook)
    found = cut_lineage(found)
    least = found.groupBy("up").agg(F.min("n.id").alias("component"))
    return found.join(least, "up").select(F.col("n.id").alias("id"), "component")


def _follow(found: DataFrame, hook: DataFrame) -> DataFrame:
    """``found``'s ends, one hook further; a node that hooks to nothing stays."""
    step = hook.select(F.col("n").alias("at"), F.col("up").alias("further"))
    return found.join(step, found["up"] == step["at"], "left").select("n", F.coalesce("further", "up").alias("up"))

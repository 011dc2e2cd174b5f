"""Entity clusters: components, then greedy merging under constraints inside each of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.text import model_families, text
from knitwork.functions.values import f1, safe_div
from knitwork.operators.components import connected_components
from knitwork.session import cut_lineage


@dataclass(frozen=True)
class ClusterConfig:
    component_probability: float = 0.5
    merge_probability: float = 0.72
    max_size: int = 30
    same_source: bool = True
    brand: bool = True
    model: bool = True
    signature: bool = True


#: (field, reason): values of two clusters must meet where both have any.
SIGNATURE = (("screen", "screen_size_conflict"), ("resolution", "resolution_conflict"))


class Cluster:
    __slots__ = ("members", "sources", "brands", "families", "screen", "resolution")

    def __init__(self, uid, source, brand, families, screen, resolution):
        one = lambda v: {v} if v else set()
        self.members, self.sources, self.brands = [uid], one(source), one(brand)
        self.families, self.screen, self.resolution = set(families), one(screen), one(resolution)

    def absorb(self, other: Cluster) -> None:
        self.members += other.members
        for name in self.__slots__[1:]:
            setattr(self, name, getattr(self, name) | getattr(other, name))


def conflict(a: Cluster, b: Cluster, config: ClusterConfig) -> str | None:
    """The first constraint that forbids joining two clusters."""
    apart = lambda name: (x := getattr(a, name)) and (y := getattr(b, name)) and not x & y
    rules = [
        (len(a.members) + len(b.members) > config.max_size, "max_cluster_size"), (config.same_source and a.sources & b.sources, "same_source_duplicate"),
        (config.brand and apart("brands"), "brand_conflict"), (config.model and apart("families"), "model_conflict"),
        *((config.signature and apart(f), reason) for f, reason in SIGNATURE),
    ]
    return next((reason for broken, reason in rules if broken), None)


def merge_greedily(rows, edges, config: ClusterConfig):
    """(uid -> root uid, log) of one component: strongest edge first, ties by pair."""
    clusters = {r[0]: Cluster(*r) for r in rows}
    home = {uid: uid for uid in clusters}
    log = []
    for p, left, right in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        a, b = home[left], home[right]
        if a == b:
            continue
        reason = conflict(clusters[a], clusters[b], config)
        log.append((left, right, a, b, p, "rejected" if reason else "accepted", reason or "compatible"))
        if not reason:
            keep, gone = (a, b) if len(clusters[a].members) >= len(clusters[b].members) else (b, a)
            clusters[keep].absorb(lost := clusters.pop(gone))
            for uid in lost.members:
                home[uid] = keep
    return home, log


def constrained_clusters(records: DataFrame, edges: DataFrame, config: ClusterConfig = ClusterConfig()) -> tuple[DataFrame, DataFrame]:
    """(memberships: uid, cluster_root; merge log). ``records``: uid, source_id, brand, model_number,
    screen, resolution; ``edges``: left_uid, right_uid, match_probability.

    Merges never cross components of the merge edges, so each is merged on its own, by a cogroup
    on the component. Records without such an edge are their own clusters and meet no Python."""
    strong = cut_lineage(edges.filter(F.col("match_probability") >= config.merge_probability).select("left_uid", "right_uid", "match_probability"))
    found = connected_components(strong, "left_uid", "right_uid").select(F.col("id").alias("uid"), "component")
    rows = records.join(found.hint("merge"), "uid").select("component", "uid", text(F.col("source_id")).alias("source_id"), F.lower(text(F.col("brand"))).alias("brand"), model_families(F.array(text(F.col("model_number")))).alias("families"), text(F.col("screen")).alias("screen"), text(F.col("resolution")).alias("resolution"))
    linked = strong.join(found.withColumnRenamed("uid", "left_uid").hint("merge"), "left_uid").select(F.col("component").alias("linked_component"), "left_uid", "right_uid", "match_probability")

    def merge(left, right):
        import pandas as pd

        home, log = merge_greedily(left[["uid", "source_id", "brand", "families", "screen", "resolution"]].values.tolist(), right[["match_probability", "left_uid", "right_uid"]].values.tolist(), config)
        out = [(u, r, None, None, None, None, None, None) for u, r in home.items()] + [(None, None, *x[:2], *x[4:7], f"{x[2]}|{x[3]}") for x in log]
        return pd.DataFrame(out, columns=["uid", "cluster_root", "left_uid", "right_uid", "match_probability", "decision", "reason", "roots"])

    schema = "uid string, cluster_root string, left_uid string, right_uid string, match_probability double, decision string, reason string, roots string"
    merged = rows.groupBy("component").cogroup(linked.groupBy("linked_component")).applyInPandas(merge, schema)
    merged = cut_lineage(merged)
    members = merged.filter("uid is not null").select("uid", "cluster_root")
    lone = records.join(members.hint("merge"), "uid", "left_anti").select("uid", F.col("uid").alias("cluster_root"))
    return members.unionByName(lone), merged.filter("uid is null").select("left_uid", "right_uid", "match_probability", "decision", "reason", "roots")


def component_members(records: DataFrame, edges: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(uid, cluster_root) by connected components alone, over all edges of at least
    ``component_probability``: what constrained clusters are compared with. A record without an edge
    is its own component."""
    linked = edges.filter(F.col("match_probability") >= config.component_probability)
    found = connected_components(linked, "left_uid", "right_uid").select(F.col("id").alias("uid"), F.col("component").alias("cluster_root"))
    lone = records.select("uid").join(found.hint("merge"), "uid", "left_anti").select("uid", F.col("uid").alias("cluster_root"))
    return found.join(records.select("uid").hint("merge"), "uid", "left_semi").unionByName(lone)


def merge_counts(merge_log: DataFrame) -> DataFrame:
    n = lambda d: F.count(F.when(F.col("decision") == d, 1)).alias(f"{d}_merges")
    return merge_log.agg(n("accepted"), n("rejected"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``name``: 1, 2, ... in the order of a unique column. Ranges of it are counted, and each row adds
    its place in its own range to the rows of the ranges before: no task sees all rows."""
    placed = cut_lineage(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = sorted(map(tuple, placed.groupBy("part").agg(F.count("*")).collect()))  # a number a range
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "part int, rows_before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.withColumn("place", place).join(F.broadcast(offsets), "part").withColumn(name, F.col("place") + F.col("rows_before")).drop("part", "place", "rows_before")


def cluster_rows(memberships: DataFrame, records: DataFrame, truth: DataFrame, prefix: str = "entity") -> DataFrame:
    """entity_id by the order of smallest members, size, sources, confidence, most frequent gold
    entity (ties: the smaller id)."""
    m = memberships.join(records.select("uid", "source_id").hint("merge"), "uid").join(truth.select("uid", "gold_entity").hint("merge"), "uid", "left")
    sizes = m.groupBy("cluster_root").agg(F.min("uid").alias("first_uid"), F.count("*").alias("size"), F.countDistinct("source_id").alias("sources"))
    modes = m.filter("gold_entity is not null").groupBy("cluster_root", "gold_entity").agg(F.count("*").alias("n")).groupBy("cluster_root").agg(F.min_by("gold_entity", F.struct((-F.col("n")).alias("x"), "gold_entity")).alias("primary_truth"))
    named = numbered(sizes, "first_uid", "at").withColumn("entity_id", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("at").cast("string"), 6, "0"))).drop("at")
    confidence = F.least(F.lit(1.0), 0.45 + 0.1 * (F.col("size") - 1))
    return named.join(modes.hint("merge"), "cluster_root", "left").select("cluster_root", "entity_id", "first_uid", "size", "sources", confidence.alias("confidence"), "primary_truth")


def cluster_pair_metrics(memberships: DataFrame, truth: DataFrame) -> DataFrame:
    """Pair precision, recall and F1 from group sizes: no pair is ever written out."""
    both = memberships.join(truth.select("uid", "gold_entity").hint("merge"), "uid", "left")
    pairs = F.expr("n * (n - 1) div 2")
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"))
    tp = count(both.filter("gold_entity is not null"), "cluster_root", "gold_entity").withColumnRenamed("pairs", "tp")
    got, want = count(both, "cluster_root").withColumnRenamed("pairs", "predicted"), count(truth, "gold_entity").withColumnRenamed("pairs", "wanted")
    row = tp.join(got, F.lit(True)).join(want, F.lit(True))
    p, r = safe_div(F.col("tp"), F.col("predicted")), safe_div(F.col("tp"), F.col("wanted"))
    return row.select("tp", "predicted", "wanted", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))



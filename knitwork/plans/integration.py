"""The stages in order, as one lazily composed plan; a run keeps what is settled."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.functions.values import normalize_value
from knitwork.operators import blocking, clustering, fusion, matching, profile, schema_align
from knitwork.plans.runs import Run
from knitwork.session import cut_lineage

Overlays = dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]
STAGES = ("profile", "schema", "normalize", "block", "match", "cluster", "claims", "fuse")
CORE_NAMES = tuple(n for n, _ in schema_align.CORE if n != "specifications")


@dataclass(frozen=True)
class IntegrationConfig:
    schema: schema_align.SchemaConfig = field(default_factory=schema_align.SchemaConfig)
    blocking: blocking.BlockingConfig = field(default_factory=blocking.BlockingConfig)
    clustering: clustering.ClusterConfig = field(default_factory=clustering.ClusterConfig)
    attributes: tuple[tuple[str, str], ...] = schema_align.CORE
    default_threshold: float = 0.5

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def normalize_records(values: DataFrame, accepted: DataFrame) -> DataFrame:
    """Long rows of canonical values; attributes without a target become specifications."""
    mapped = values.withColumn("source_attribute_id", F.concat_ws("//", "source_id", "attribute")).join(accepted.select("source_attribute_id", "target"), "source_attribute_id", "left")
    target = F.when(F.col("target").isNull() | (F.col("target") == "UNMAPPED"), "specifications").otherwise(F.col("target"))
    return mapped.withColumn("target", target).withColumn("canonical", normalize_value(F.col("target"), F.col("value"), F.col("attribute")))


def product_records(normalized: DataFrame) -> DataFrame:
    """One wide row per record: the first value of each core attribute, names of all the others."""
    first = lambda name: F.min_by("canonical.value", F.when((F.col("target") == name) & (F.col("canonical.value") != ""), F.col("attr_ord"))).alias(name)
    from knitwork.functions.text import spec_key

    key = spec_key(F.col("attribute"))
    spec = lambda *names: F.min_by("canonical.value", F.when(F.col("target").isin(*names) | key.isin(*names), F.col("attr_ord")))
    others = F.when(~F.col("target").isin(*CORE_NAMES), F.concat(F.lit("spec_"), key))
    ids = F.array(*map(F.lit, ("record_uid", "source_id", "source_record_id")))
    return normalized.groupBy(F.col("record_uid").alias("uid"), "source_id").agg(*map(first, CORE_NAMES), spec("screen_size_diagonal", "screen_size").alias("screen"), spec("supported_resolution", "recommended_resolution").alias("resolution"), F.array_union(ids, F.array_sort(F.collect_set(others))).alias("spec_keys"))


def flat_records(normalized: DataFrame) -> DataFrame:
    """record_uid and fields: a map of the record's canonical values by target, of its specifications as
    spec_<key>, and of its three ids. The first value of a name counts; empty core values are left out.
    ``normalized``: record_uid, source_id, source_record_id, target, attribute, value, attr_ord."""
    from knitwork.functions.text import spec_key

    ids = ("record_uid", "source_id", "source_record_id")
    spec = F.col("target") == "specifications"
    name = F.when(spec, F.concat(F.lit("spec_"), spec_key(F.col("attribute")))).otherwise(F.col("target"))
    named = normalized.filter(spec | F.col("value").isNotNull()).withColumn("name", name)
    first = named.groupBy(*ids, "name").agg(F.min_by(F.coalesce("value", F.lit("")), "attr_ord").alias("value"))
    fields = first.filter(~F.col("name").isin(*ids)).groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("own"))
    return fields.select("record_uid", F.map_concat("own", F.create_map(*[x for i in ids for x in (F.lit(i), F.col(i).cast("string"))])).alias("fields"))


def integrate(spark: SparkSession, records: DataFrame, gold: DataFrame | None = None, config: IntegrationConfig = IntegrationConfig(), stop_after: str = "fuse", overlays: Overlays | None = None, run: Run | None = None) -> dict[str, DataFrame]:
    """Artifacts by name, up to a stage. ``gold``: uid, gold_entity. Lineage is cut where a stage's
    result feeds several later ones. ``overlays``: by artifact (mappings, predictions, fused), a
    function that gets the artifact and all artifacts so far and gives the one to go on with.
    ``run``: settled artifacts are its tables; those that an earlier attempt completed are read."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        out[name] = cut_lineage(make()) if run is None else run.table(name, make)
        return out[name]

    def settle(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if overlays and name in overlays:
            made = keep(f"deterministic_{name}", make)
            return keep(name, lambda: overlays[name](made, out))
        return keep(name, make)

    def done(stage: str) -> bool:
        return STAGES.index(stage) >= STAGES.index(stop_after)

    gold = gold if gold is not None else spark.createDataFrame([], "uid string, gold_entity string")
    values = keep("values", lambda: profile.explode_payload(records))
    counts = records.groupBy("source_id").agg(F.count("*").alias("records"))
    placed = values.withColumn("ord", F.struct("record_uid", "attr_ord"))
    keep("profiles", lambda: profile.attribute_profiles(placed.select("source_id", "attribute", "ord", "value"), counts))
    if done("profile"):
        return out
    schema = schema_align.mediated_schema(spark, config.attributes)
    out["mapping_candidates"] = schema_align.rank_candidates(schema_align.score_candidates(out["profiles"], schema, config.schema), config.schema)
    settle("mappings", lambda: schema_align.accept_mappings(out["mapping_candidates"], config.schema))
    if done("schema"):
        return out
    keep("normalized", lambda: normalize_records(values, out["mappings"]))
    products = keep("products", lambda: product_records(out["normalized"]))
    if done("normalize"):
        return out
    keep("pairs", lambda: blocking.candidate_pairs(blocking.blocking_keys(products, config.blocking), config.blocking, blocking.RULES))
    if done("block"):
        return out
    known = products.join(gold.select("uid", "gold_entity").hint("merge"), "uid", "left").withColumn("split", matching.split_of(F.col("gold_entity"), F.col("uid")))
    features = matching.pair_features(out["pairs"], known, carry=("gold_entity", "split")).withColumnsRenamed({"left_gold_entity": "left_gold", "right_gold_entity": "right_gold"})
    labelled = features.withColumn("label", matching.pair_label(F.col("left_gold"), F.col("right_gold"))).withColumn("split", matching.pair_split(F.col("left_split"), F.col("right_split")))

    def predict() -> DataFrame:
        scored = matching.match_model(cut_lineage(labelled))
        threshold = matching.calibrate(scored, config.default_threshold).first().threshold
        return scored.withColumn("threshold", F.lit(threshold)).withColumn("prediction", (F.col("match_probability") >= threshold).cast("int"))

    settle("predictions", predict)
    if done("match"):
        return out
    edges = out["predictions"].filter("prediction = 1")
    # the greedy merge starts from edges that are also good enough for the component level
    strong = edges.filter(F.col("match_probability") >= config.clustering.component_probability)
    merged: list[DataFrame] = []

    def members() -> DataFrame:
        if not merged:
            merged.extend(clustering.constrained_clusters(products, strong, config.clustering))
        return merged[0]

    constrained = keep("members", members)
    keep("merge_log", lambda: (members(), merged[1])[1])
    keep("clusters", lambda: clustering.cluster_rows(constrained, products, gold))
    keep("memberships", lambda: constrained.join(out["clusters"].select("cluster_root", "entity_id").hint("merge"), "cluster_root"))
    components = keep("component_members", lambda: clustering.component_members(products, edges, config.clustering))
    keep("component_clusters", lambda: clustering.cluster_rows(components, products, gold, prefix="cc"))
    level = lambda name, m: clustering.cluster_pair_metrics(m, gold).withColumn("level", F.lit(name))
    out["cluster_metrics"] = level("constrained", constrained).unionByName(level("components", components))
    if done("cluster"):
        return out
    n = out["normalized"]
    claims = n.select("record_uid", F.col("target").alias("attribute"), F.col("canonical.value").alias("value"), F.col("canonical.unit").alias("unit"), F.col("canonical.confidence").alias("confidence"), F.struct("record_uid", "attr_ord").cast("string").alias("ord"))
    keep("claims", lambda: fusion.extract_claims(claims, out["memberships"]))
    if done("claims"):
        return out
    settle("fused", lambda: fusion.fuse(out["claims"]))
    out["entities"] = fusion.integrated_entities(out["fused"], out["clusters"])
    return out


def row_digest(df: DataFrame) -> str:
    """An order-free checksum of a table."""
    return str(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first()).replace(" ", "")


__all__ = ["IntegrationConfig", "integrate", "normalize_records", "product_records", "row_digest"]

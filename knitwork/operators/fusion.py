"""Claims and their fusion into one value per entity and attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.text import jaccard_of_sets, qgrams
from knitwork.functions.values import as_float, content_id

TEXT_ATTRIBUTES = ("title", "description")
MEDOID_LIMIT = 50
UNSUPPORTED = ("", "no info", "unknown", "n/a", "none")
KEY = ["entity_id", "attribute"]


def extract_claims(values: DataFrame, memberships: DataFrame) -> DataFrame:
    """Values of records that are in an entity. ``values``: record_uid, attribute, value, unit, confidence, ord."""
    joined = values.join(memberships.select(F.col("uid").alias("record_uid"), "entity_id").hint("merge"), "record_uid")
    return joined.withColumn("claim_id", content_id("claim_", 20, F.col("entity_id"), F.col("record_uid"), F.col("attribute"), F.col("value"), F.col("ord").cast("string")))


def fuse(claims: DataFrame) -> DataFrame:
    """One row per entity and attribute. Text: the medoid of distinct values by 3-gram similarity;
    all numbers: the value nearest the median; else the most frequent. Ties go to the first claim.

    Everything is decided on distinct values with their counts, so a group's size is that of its
    vocabulary. They are dealt by group once, and all steps are windows over the same order. Only groups
    of at most ``MEDOID_LIMIT`` values meet themselves pairwise, beyond it the most frequent, longest
    value stands in, as in small ones."""
    c = claims.select(*KEY, "claim_id", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), "ord")
    group = Window.partitionBy(*KEY)
    col = F.col
    first = lambda ok, *order: F.min_by("value", F.when(ok, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).over(group)
    given, textual = col("value") != "", col("attribute").isin(*TEXT_ATTRIBUTES)
    rows = c.groupBy(*KEY, "value").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.collect_list("claim_id").alias("ids"))
    rows = rows.withColumn("number", F.when(given, as_float(col("value")))).withColumn("grams", F.when(textual & given, F.array_distinct(qgrams(F.lower("value"), 3))))
    rows = rows.select(
        "*", F.coalesce(F.bool_and(F.when(given, col("number").isNotNull())).over(group), F.lit(False)).alias("numeric"), F.count(F.when(given, 1)).over(group).alias("kinds"),
        first(given, -col("n"), col("ord"), col("value")).alias("majority"), first(given & textual, -col("n"), -F.length("value"), col("value")).alias("longest"),
    )
    # a group without any value has no method of its own
    method = F.when(col("kinds") == 0, "majority_vote").when(textual, "text_medoid").when(col("numeric"), "numeric_median").otherwise("majority_vote")
    rows = rows.withColumn("method", method)
    few = given & (col("method") == "text_medoid") & col("kinds").between(2, MEDOID_LIMIT)
    rows = rows.select(
        "*", F.percentile(F.when(col("method") == "numeric_median", col("number")), 0.5, col("n")).over(group).alias("middle"),
        F.collect_list(F.when(few, F.struct("value", "grams"))).over(group).alias("others"),
    )
    likeness = F.aggregate(F.filter("others", lambda o: o["value"] != col("value")), F.lit(0.0), lambda total, o: total + jaccard_of_sets(col("grams"), o["grams"]))
    rows = rows.withColumn("score", F.when(few, F.round(likeness / (col("kinds") - 1), 9))).drop("others", "grams")
    nearest = first(given & (col("method") == "numeric_median"), F.abs(col("number") - col("middle")), col("ord"), col("value"))
    medoid = first(few, -col("score"), -F.length("value"), -col("n"), col("value"))
    chosen = F.when(col("method") == "numeric_median", nearest).when(col("method") == "text_medoid", F.coalesce(medoid, "longest")).otherwise(col("majority"))
    rows = rows.withColumn("selected_value", F.coalesce(chosen, F.lit("")))
    supports = col("value") == col("selected_value")
    fused = rows.groupBy(*KEY, "selected_value").agg(
        F.max("method").alias("fusion_method"), (F.sum(F.when(supports, col("n")).otherwise(0)) / F.sum("n")).alias("confidence"), F.sum("n").alias("claims"),
        F.array_sort(F.flatten(F.collect_list(F.when(supports, col("ids"))))).alias("supporting_claim_ids"), F.array_sort(F.flatten(F.collect_list(F.when(~supports, col("ids"))))).alias("contradicting_claim_ids"),
        F.array_sort(F.collect_set("value")).alias("alternative_values"),
    )
    units = c.filter("unit <> ''").groupBy(*KEY, "unit").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).groupBy(*KEY).agg(F.min_by("unit", F.struct((-F.col("n")).alias("a"), F.col("ord").alias("b"))).alias("selected_unit"))
    return fused.join(units, KEY, "left").withColumn("fused_value_id", content_id("fused_", 20, *map(F.col, KEY)))


def integrated_entities(fused: DataFrame, entities: DataFrame) -> DataFrame:
    """canonical payload and provenance per entity, as JSON with sorted keys; {} where nothing fused."""
    entries = lambda v: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", v)))))
    rows = fused.groupBy("entity_id").agg(entries(F.col("selected_value")).alias("canonical_payload"), entries(F.col("supporting_claim_ids")).alias("provenance"))
    return entities.select("entity_id").distinct().join(rows.hint("merge"), "entity_id", "left").select("entity_id", F.coalesce("canonical_payload", F.lit("{}")).alias("canonical_payload"), F.coalesce("provenance", F.lit("{}")).alias("provenance"))


def is_unsupported() -> Column:
    return F.lower(F.trim("selected_value")).isin(*UNSUPPORTED)


def is_high_conflict(least: int = 4) -> Column:
    return F.size("alternative_values") >= least


def is_low_support(below: float = 0.67) -> Column:
    return (F.size("alternative_values") > 1) | (F.col("confidence") < below)


def unsupported(fused: DataFrame) -> DataFrame:
    return fused.filter(is_unsupported())


def high_conflict(fused: DataFrame, least: int = 4) -> DataFrame:
    return fused.filter(is_high_conflict(least))


def low_support(fused: DataFrame, below: float = 0.67) -> DataFrame:
    return fused.filter(is_low_support(below))


def fusion_accuracy(fused: DataFrame, gold: DataFrame, primary: DataFrame) -> DataFrame:
    """evaluated, correct, accuracy: gold entities are looked up by the cluster whose primary truth
    they are (the last one), else by their own id."""
    remap = primary.filter("primary_truth is not null").groupBy("primary_truth").agg(F.max("entity_id").alias("mapped"))
    wanted = gold.join(remap, gold["entity_id"] == remap["primary_truth"], "left").select(F.coalesce("mapped", gold["entity_id"]).alias("entity_id"), F.col("attribute"), F.col("truth"))
    hits = wanted.join(fused, KEY).agg(F.count("*").alias("evaluated"), F.coalesce(F.sum((F.lower(F.trim("truth")) == F.lower(F.trim("selected_value"))).cast("long")), F.lit(0)).alias("correct"))
    return hits.withColumn("accuracy", F.when(F.col("evaluated") > 0, F.col("correct") / F.col("evaluated")))


def fusion_mismatches(fused: DataFrame, gold: DataFrame, primary: DataFrame) -> DataFrame:
    """(entity_id, attribute, value, gold_value) of the looked-up gold values that differ from what was
    fused; entities are found as in ``fusion_accuracy``."""
    remap = primary.filter("primary_truth is not null").groupBy("primary_truth").agg(F.max("entity_id").alias("mapped"))
    wanted = gold.join(remap, gold["entity_id"] == remap["primary_truth"], "left").select(F.coalesce("mapped", gold["entity_id"]).alias("entity_id"), "attribute", F.col("truth").alias("gold_value"))
    met = wanted.join(fused.select(*KEY, F.col("selected_value").alias("value")), KEY)
    same = F.coalesce(F.lower(F.trim("gold_value")) == F.lower(F.trim("value")), F.lit(False))
    return met.filter(~same).select(*KEY, "value", "gold_value")


def fusion_metrics(fused: DataFrame, primary: DataFrame, bootstrap: DataFrame | None = None, curated: DataFrame | None = None) -> DataFrame:
    """A row for each gold table there is (kind: bootstrap, curated) with evaluated, correct and accuracy,
    and one of kind primary: the curated row where such gold was given, else the bootstrap one."""
    none = fused.sparkSession.createDataFrame([(0, 0, None)], "evaluated long, correct long, accuracy double")
    chosen, out = "curated" if curated is not None else "bootstrap", None
    for kind, gold in (("bootstrap", bootstrap), ("curated", curated)):
        row = (fusion_accuracy(fused, gold, primary) if gold is not None else none).withColumn("gold_available", F.lit(gold is not None))
        # the primary row is the chosen one under another name, not looked up again
        row = row.withColumn("kind", F.explode(F.array(*map(F.lit, (kind, "primary") if kind == chosen else (kind,)))))
        out = row if out is None else out.unionByName(row)
    return out.select("kind", "gold_available", "evaluated", "correct", "accuracy")

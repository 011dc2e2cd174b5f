"""Evidence, error tables and summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.text import model_families, text

# The configurations of a full release, and how they are called in reports.
REQUIRED = ("A0", "C-LLM", "B-All", "B-S", "B-L", "B-F", "B-SL", "B-LF", "Budget-0", "Budget-5", "Budget-10", "Budget-25")
LABELS = {"A0": "Deterministic", "C-LLM": "LLM", "B-All": "Hybrid"}


def cluster_evidence(memberships: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """Members, distinct sources, brands, model families, screens, resolutions and gold entities of
    each cluster, sorted; how many gold entities."""
    m = memberships.join(records, "uid").join(truth, "uid", "left")
    families = F.array_sort(F.array_distinct(F.flatten(F.collect_set(model_families(F.array(text(F.col("model_number"))))))))
    some = lambda c: F.array_sort(F.filter(F.collect_set(c), lambda v: v != ""))
    rows = m.groupBy("cluster_root").agg(F.count("*").alias("members"), some("source_id").alias("sources"), some(F.lower("brand")).alias("brands"), families.alias("families"), some("screen").alias("screens"), some("resolution").alias("resolutions"), some("gold_entity").alias("truths"))
    return rows.withColumn("truth_count", F.size("truths"))


def over_merged(memberships: DataFrame, truth: DataFrame) -> DataFrame:
    return memberships.join(truth, "uid").groupBy("cluster_root").agg(F.countDistinct("gold_entity").alias("truths")).filter("truths > 1")


def under_merged(memberships: DataFrame, truth: DataFrame) -> DataFrame:
    return memberships.join(truth, "uid").groupBy("gold_entity").agg(F.countDistinct("cluster_root").alias("clusters")).filter("clusters > 1")


def weak_bridges(merge_log: DataFrame, below: float = 0.85) -> DataFrame:
    return merge_log.filter((F.col("decision") == "accepted") & (F.col("match_probability") < below))


def linkage_errors(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("label").isNotNull() & (F.col("label") != F.col("prediction"))).withColumn("kind", F.when(F.col("label") == 1, "false_negative").otherwise("false_positive"))


def mediated_coverage(profiles: DataFrame) -> DataFrame:
    """How many of the eight core roles any attribute has."""
    core = ("title", "brand", "model identifier", "category", "description", "price", "currency", "specification")
    return profiles.select(F.explode("semantic_roles").alias("role")).filter(F.col("role").isin(*core)).agg(F.countDistinct("role").alias("mediated_coverage"))


def gold_profiles(mapping_gold: DataFrame, roles) -> DataFrame:
    """Profile rows from a mapping gold table alone: the id is split at its first //, roles come from
    the attribute's and target's names."""
    parts = F.split("source_attribute_id", "//", 2)
    rows = mapping_gold.select(parts[0].alias("source_id"), parts[1].alias("attribute"), "target_attribute_name").dropDuplicates(["source_id", "attribute"])
    return rows.select("source_id", "attribute", roles(F.concat_ws(" ", "attribute", "target_attribute_name"), F.lit("")).alias("semantic_roles"))


def first_cases(cases: DataFrame, n: int, *order: Column) -> DataFrame:
    """Up to n cases of each kind, first by a total order; repeated case ids count once."""
    once = cases.withColumn("__at", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).filter("__at = 1")
    return once.withColumn("__at", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("__at") <= n).drop("__at")


def mean_present(*metrics: str) -> Column:
    """Mean of the metrics that are there; null where none is."""
    present = F.array_compact(F.array(*[F.col(m).cast("double") for m in metrics]))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def rounded(c: Column, empty: Column | None = None) -> Column:
    return F.coalesce(F.round(c.try_cast("double"), 4), empty if empty is not None else F.lit(0.0))


def missing_configurations(runs: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Required configurations without a run, or whose fusion metrics rest on no value."""
    have = {r.configuration for r in runs.filter("fusion_evaluated > 0").select("configuration").distinct().collect()}
    return [c for c in required if c not in have]


def label(configuration: Column) -> Column:
    """How a configuration is called in a report: the name itself where it has no other."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, configuration), F.when(configuration.startswith("A0-"), "Deterministic Scale"), configuration)


def last_by_configuration(rows: DataFrame, order: str) -> DataFrame:
    """One row a configuration: the last."""
    return rows.groupBy("configuration").agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def budget_series(summaries: DataFrame, operational: DataFrame) -> DataFrame:
    """Quality against calls of the runs with a budget: a point each, by calls. Runs without a summary
    or an operational row count as zero there."""
    names = summaries.sparkSession.createDataFrame([(n,) for n in REQUIRED if n.startswith("Budget-")], "configuration string")
    met = names.join(summaries.select("configuration", "end_to_end", "linkage_f1"), "configuration", "left").join(operational.select("configuration", "calls", "cost"), "configuration", "left")
    return met.select("configuration", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("end_to_end", "linkage_f1", "cost")]).orderBy("calls", "configuration")


def uncovered(summaries: DataFrame) -> DataFrame:
    """Configurations whose fusion metrics rest on no value."""
    return summaries.filter(F.coalesce("fusion_evaluated", F.lit(0)) == 0).select("configuration")


def preferred(row: Column, first: str, second: str) -> Column:
    """A metric by its preferred name, else by the other."""
    return F.coalesce(row[first], row[second])


def confusion(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Counts of one split; zeros where it has none."""
    cells = {"true_positive": "tp", "false_positive": "fp", "true_negative": "tn", "false_negative": "fn"}
    return metrics.filter(F.col("split") == split).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(n) for n, c in cells.items()])


def claim_metrics(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count("*").alias("claim_count"), F.countDistinct("record_uid").alias("record_count_with_claims"), F.countDistinct("entity_id").alias("entity_count_with_claims"))


def record_confidence(normalized: DataFrame) -> DataFrame:
    """Mean confidence of each record's values; of records without any, zero."""
    return normalized.groupBy("record_uid").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def normalization_metrics(normalized: DataFrame) -> DataFrame:
    return normalized.agg(F.countDistinct("record_uid").alias("record_count"), F.count("*").alias("normalized_value_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))


def dataset_summary(records: DataFrame, gold: DataFrame, attributes: int) -> DataFrame:
    """One row: sources, records, entities, labelled records, positive pairs, mediated attributes.
    ``gold``: entity_id, spec_id."""
    sizes = gold.distinct().groupBy("entity_id").agg(F.count("*").alias("n"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of_gold = sizes.agg(F.count("*").alias("entity_count"), n(F.sum("n")).alias("labeled_record_count"), n(F.sum(F.expr("n * (n - 1) div 2"))).alias("positive_pair_count"))
    of_records = records.agg(F.countDistinct("source_id").alias("source_count"), F.count("*").alias("record_count"))
    one = F.lit(1).alias("one")
    return of_records.select("*", one).join(of_gold.select("*", one), "one").select("source_count", "record_count", "entity_count", "labeled_record_count", "positive_pair_count", F.lit(attributes).alias("mediated_attribute_count"))

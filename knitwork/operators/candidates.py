"""Which of several datasets is the best to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Per measure the amount that earns all of its points, and the points.
POINTS = {"source_count": (8, 8), "record_count": (25_000, 8), "entity_count": (500, 20), "positive_pair_count": (500, 15), "mediated_coverage": (8, 10), "schema_heterogeneity": (None, 8), "overlap_score": (None, 10), "labeled_record_count": (2_500, 10), "fusion_conflict_count": (5_000, 8), "model_number_coverage": (None, 3), "title_signal_coverage": (None, 3)}


def local_score() -> Column:
    """Score of a dataset by what can be counted without reading all its records."""
    part = lambda name, full, points: (F.least(F.col(name) / full, F.lit(1.0)) if full else F.col(name)) * points
    total = F.lit(0.0)
    for name, (full, points) in POINTS.items():
        total = total + part(name, full, points)
    return F.round(total, 4)


def overlap_score(gold: DataFrame, record_count: Column | int) -> DataFrame:
    """Share of the records that are in clusters of more than one."""
    sizes = gold.groupBy("entity_id").agg(F.count("*").alias("n"))
    n = record_count if isinstance(record_count, Column) else F.lit(record_count)
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("overlapping")).select(F.when(n != 0, F.col("overlapping") / n).otherwise(0.0).alias("overlap_score"))


def resolve_specs(gold: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id and record_uid of gold specs, which name a record by its uid or by source//id. Each
    form is an equi-join of its own; a spec found by both counts once."""
    by_uid = records.select(F.col("record_uid").alias("spec_id"), "record_uid")
    by_path = records.select(F.concat_ws("//", "source_id", "source_record_id").alias("spec_id"), "record_uid")
    return gold.join(by_uid.unionByName(by_path).distinct(), "spec_id").select("entity_id", "record_uid").distinct()


def fusion_conflicts(gold: DataFrame, records: DataFrame, values: DataFrame) -> DataFrame:
    """Attributes of an entity on which its records differ: (entity_id, attribute, n). ``values``:
    record_uid, attribute, value; case and outer blanks don't count."""
    met = resolve_specs(gold, records).join(values.filter("value is not null and value <> \'\'"), "record_uid")
    distinct = met.groupBy("entity_id", F.lower("attribute").alias("attribute")).agg(F.countDistinct(F.lower(F.trim("value"))).alias("n"))
    return distinct.filter("n > 1")


def best_candidate(metrics: DataFrame, gate: Column, score: str = "selection_score") -> DataFrame:
    """The row with the highest score among those that pass the gate; ties go to the first name."""
    return metrics.filter(gate).orderBy(F.desc(score), "dataset_id").limit(1)


def selection_table(metrics: DataFrame, gate: Column, score: str = "selection_score") -> DataFrame:
    """All candidates with their gate and rank; the rank is over the datasets, a handful of rows."""
    from pyspark.sql.window import Window

    passed = metrics.withColumn("passes", F.coalesce(gate, F.lit(False)))
    return passed.withColumn("rank", F.row_number().over(Window.partitionBy("passes").orderBy(F.desc(score), "dataset_id")))

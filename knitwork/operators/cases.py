"""Error cases of a run, each with the records that show it.

Every builder takes the first cases by a total order and looks up evidence for those alone: the joins
are of a handful of ids against whole tables, and never collect a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("case_id", "stage", "source_records", "system_output", "expected_output", "explanation")
# What each kind of case is said to show.
EXPLANATIONS = {
    "schema_alignment": "The attribute went to the wrong field of the mediated schema, which normalization and fusion then build on.",
    "fusion": "The fused value differs from the curated one.",
    "linkage": "The pair was decided against its label.",
    "clustering": "Records of one true entity lie in several clusters, so fusion sees only part of their claims.",
}
FUSION_CASES, FUSION_RECORDS, CLUSTER_ENTITIES, CLUSTER_RECORDS, EXAMPLES = 2, 3, 2, 4, 3


def record_evidence(normalized: DataFrame, raw: DataFrame) -> DataFrame:
    """record_uid and evidence: ids, canonical and raw payload; the raw one is null where unknown."""
    own = normalized.select("record_uid", "source_id", "source_record_id", "normalized_payload")
    met = own.join(raw.select("record_uid", "raw_payload"), "record_uid", "left")
    return met.select("record_uid", F.struct("record_uid", "source_id", "source_record_id", "normalized_payload", "raw_payload").alias("evidence"))


def first_rows(rows: DataFrame, n: int, by: tuple[str, ...], *order: Column) -> DataFrame:
    """Up to n rows of each group, by a total order."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", at).filter(F.col("place") <= n)


def _with_records(cases: DataFrame, members: DataFrame, evidence: DataFrame, n: int) -> DataFrame:
    """``cases`` (case_id, ...) with the evidence of the first n of their members (case_id, at,
    record_uid), in order; a case without known records keeps an empty list."""
    chosen = first_rows(members, n, ("case_id",), F.col("at"), F.col("record_uid"))
    shown = chosen.join(evidence, "record_uid").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda x: F.to_json(x["evidence"])).alias("source_records"))
    none = F.array().cast("array<string>")
    return cases.join(shown, "case_id", "left").withColumn("source_records", F.coalesce("source_records", none))


def _case(stage: str, system: list[str], expected: list[str]) -> list[Column]:
    return [F.col("case_id"), F.lit(stage).alias("stage"), F.col("source_records"), F.to_json(F.struct(*sorted(system))).alias("system_output"), F.to_json(F.struct(*sorted(expected))).alias("expected_output"), F.lit(EXPLANATIONS[stage]).alias("explanation")]


def attribute_examples(asked: DataFrame, values: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """Up to n records of each asked (source_id, attribute) that have it: record_uid, value, in order
    of the uid. ``values``: record_uid, source_id, attribute, value."""
    met = values.join(F.broadcast(asked.select("source_id", "attribute").distinct().limit(1_000)), ["source_id", "attribute"])
    return first_rows(met, n, ("source_id", "attribute"), F.col("record_uid")).drop("place")


def schema_case(wrong: DataFrame, values: DataFrame) -> DataFrame:
    """The first wrongly mapped attribute with examples of its values. ``wrong``: source_attribute_id,
    source_id, attribute, target, score, gold_target."""
    first = wrong.orderBy("source_attribute_id").limit(1).withColumn("case_id", F.concat(F.lit("schema_"), "source_attribute_id"))
    shown = attribute_examples(first, values).groupBy("source_id", "attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_uid", "source_id", "attribute", "value"))), lambda x: F.to_json(x)).alias("source_records"))
    out = first.join(shown, ["source_id", "attribute"], "left").withColumn("source_records", F.coalesce("source_records", F.array().cast("array<string>")))
    return out.select(*_case("schema_alignment", ["source_attribute_id", "target", "score"], ["gold_target"]))


def fusion_cases(wrong: DataFrame, memberships: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first two fused values that differ from gold. ``wrong``: entity_id, attribute, value,
    gold_value; memberships: entity_id, record_uid."""
    at = F.row_number().over(Window.orderBy("entity_id", "attribute"))
    first = wrong.orderBy("entity_id", "attribute").limit(FUSION_CASES).withColumn("case_id", F.concat(F.lit("fusion_"), at.cast("string"), F.lit("_"), "entity_id"))
    members = first.select("case_id", "entity_id").join(memberships, "entity_id").select("case_id", F.lit(0).alias("at"), "record_uid")
    return _with_records(first, members, evidence, FUSION_RECORDS).select(*_case("fusion", ["entity_id", "attribute", "value"], ["gold_value"]))


def cluster_case(under: DataFrame, memberships: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first true entity whose records lie in several clusters. ``under``: gold_entity and
    predicted (sorted entity ids); records of its first two predicted entities are shown."""
    first = under.orderBy("gold_entity").limit(1).withColumn("case_id", F.concat(F.lit("cluster_undermerge_"), "gold_entity"))
    asked = first.select("case_id", F.posexplode(F.slice("predicted", 1, CLUSTER_ENTITIES)).alias("at", "entity_id"))
    members = asked.join(memberships, "entity_id").select("case_id", "at", "record_uid")
    shown = _with_records(first.withColumn("predicted_cluster_count", F.size("predicted")).withColumn("expected_cluster_count", F.lit(1)), members, evidence, CLUSTER_RECORDS)
    return shown.select(*_case("clustering", ["predicted", "predicted_cluster_count"], ["gold_entity", "expected_cluster_count"]))


def linkage_cases(wrong: DataFrame, evidence: DataFrame, n: int = 2) -> DataFrame:
    """The first n pairs of each kind of error. ``wrong``: left_uid, right_uid, label, prediction, kind."""
    first = first_rows(wrong, n, ("kind",), F.col("left_uid"), F.col("right_uid")).drop("place").withColumn("case_id", F.concat_ws("_", F.lit("linkage"), "kind", "left_uid", "right_uid"))
    members = first.select("case_id", F.posexplode(F.array("left_uid", "right_uid")).alias("at", "record_uid"))
    return _with_records(first, members, evidence, 2).select(*_case("linkage", ["prediction", "kind"], ["label"]))


def enough(cases: DataFrame, least: int = 3) -> DataFrame:
    """The cases; an error where there are fewer than the report needs."""
    found = cases.count()
    if found < least:
        raise ValueError(f"{found} error cases, {least} needed")
    return cases


def flat(cases: DataFrame) -> DataFrame:
    """As a table of plain columns for a CSV file."""
    return cases.select("case_id", "stage", "system_output", "expected_output", "explanation")


def preferred_run(names: list[str], wanted: str = "B-All") -> str | None:
    """The run whose errors are shown: the wanted one, else the first."""
    return wanted if wanted in names else next(iter(names), None)

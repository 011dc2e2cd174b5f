"""Rows of the routing record: one for each case that was called, skipped, defaulted or summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "stage": "string", "case_id": "string", "selected": "boolean", "accepted": "boolean", "fallback_applied": "boolean", "fallback_reason": "string", "request_id": "string", "input_hash": "string",
    "validation_status": "string", "failure_type": "string", "cache_status": "string", "latency_ms": "double", "input_tokens": "long", "output_tokens": "long", "cost": "double", "call_count_charge": "int",
    "defaulted": "boolean", "summary": "boolean", "eligible_count": "long", "unselected_default_count": "long", "batch_index": "int", "before": "string", "after": "string",
}
NOTHING = {"selected": False, "accepted": False, "fallback_applied": False, "latency_ms": 0.0, "input_tokens": 0, "output_tokens": 0, "cost": 0.0, "call_count_charge": 0, "defaulted": False, "summary": False}


def rows(cases: DataFrame, given: dict[str, Column]) -> DataFrame:
    """All fields: those given, those that ``cases`` has, else what they are where nothing happened."""
    have = set(cases.columns)

    def field(name: str) -> Column:
        c = given[name] if name in given else F.col(name) if name in have else F.lit(NOTHING.get(name))
        return c.cast(FIELDS[name]).alias(name)

    return cases.select(*map(field, FIELDS))


def called(cases: DataFrame, reason: Column) -> DataFrame:
    """Of answered cases: accepted where no check failed."""
    failed = reason.isNotNull()
    return rows(cases, {"selected": F.lit(True), "accepted": ~failed, "fallback_applied": failed, "fallback_reason": reason, "call_count_charge": F.lit(1), "defaulted": failed})


def batched(cases: DataFrame, reason: Column) -> DataFrame:
    """Of cases answered in batches: the first of a batch carries the call, its tokens and its cost."""
    first = F.col("batch_index") == 0
    failed = reason.isNotNull()
    charge = lambda name: F.when(first, F.col(name)).otherwise(0)
    charged = {n: charge(n) for n in ("latency_ms", "input_tokens", "output_tokens", "cost") if n in cases.columns}
    return rows(cases, {"selected": F.lit(True), "accepted": ~failed, "fallback_applied": failed, "fallback_reason": reason, "call_count_charge": first.cast("int"), "defaulted": failed} | charged)


def skipped(cases: DataFrame, reason: Column) -> DataFrame:
    """Of cases that the budget left out; their estimates stay."""
    return rows(cases, {"fallback_reason": reason, "validation_status": F.lit("not_called"), "call_count_charge": F.lit(0)})


def defaulted(cases: DataFrame, reason: Column) -> DataFrame:
    """Of left-out cases that then take the conservative default."""
    return rows(cases, {"fallback_reason": reason, "validation_status": F.lit("not_called"), "call_count_charge": F.lit(0), "defaulted": F.lit(True)})


def summary(cases: DataFrame, stage: str) -> DataFrame:
    """One row: how many cases there were, and how many took the default without a call."""
    counts = cases.agg(F.count("*").alias("eligible_count"), F.coalesce(F.sum((~F.col("selected")).cast("long")), F.lit(0)).alias("unselected_default_count"))
    return rows(counts, {"stage": F.lit(stage), "case_id": F.lit("__primary_summary__"), "fallback_reason": F.lit("summary"), "validation_status": F.lit("summary"), "summary": F.lit(True)})


def unsupported_values(*routes: DataFrame) -> DataFrame:
    """How many cases of the routing records fell back on an unsupported value; records without
    that column have none."""
    usable = [r.select("fallback_reason") for r in routes if "fallback_reason" in r.columns]
    spark = routes[0].sparkSession
    out = usable[0] if usable else spark.createDataFrame([], "fallback_reason string")
    for r in usable[1:]:
        out = out.unionByName(r)
    return out.agg(F.count(F.when(F.col("fallback_reason") == "unsupported_value", 1)).alias("unsupported_value_count"))


def operational(runs: DataFrame) -> DataFrame:
    """Per configuration of (configuration, selected, accepted, fallbacks, invalid, abstained, cost,
    latency_ms): totals, latency weighted by selected cases, and rates to four places."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda c: F.round(F.when(F.col("calls") > 0, F.col(c) / F.col("calls")).otherwise(0.0), 4)
    sums = runs.groupBy("configuration").agg(total("selected").alias("calls"), *[total(c).alias(c) for c in ("accepted", "fallbacks", "invalid", "abstained", "cost")], F.sum(F.col("latency_ms") * F.col("selected")).alias("weighted"))
    latency = F.when(F.col("calls") > 0, F.col("weighted") / F.col("calls")).otherwise(0.0)
    return sums.select("configuration", "calls", "accepted", "fallbacks", "cost", latency.alias("average_latency_ms"), rate("invalid").alias("invalid_output_rate"), rate("abstained").alias("abstention_rate"), rate("fallbacks").alias("fallback_rate"))

"""Routing of uncertain cases to a decision provider, within a budget, and what comes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.values import safe_div
from knitwork.session import cut_lineage


def route_schema(accepted: DataFrame, margin: float = 0.08, unmapped_score: float = 0.35, listed: DataFrame | None = None) -> DataFrame:
    """Ids with a small lead, or unmapped with a fair score, or listed."""
    ids = accepted.filter((F.col("margin") <= margin) | ((F.col("target") == "UNMAPPED") & (F.col("score") >= unmapped_score))).select("source_attribute_id")
    return (ids.unionByName(listed.select("source_attribute_id")) if listed is not None else ids).distinct()


def route_linkage(scored: DataFrame, low: float = 0.35, high: float = 0.75) -> DataFrame:
    return scored.filter(F.col("match_probability").between(low, high))


def route_fusion(*tables: DataFrame) -> DataFrame:
    """(entity, attribute) in any error table that has both columns."""
    usable = [t.select("entity_id", "attribute") for t in tables if {"entity_id", "attribute"} <= set(t.columns)]
    out = usable[0]
    for t in usable[1:]:
        out = out.unionByName(t)
    return out.distinct()


def top_cases(cases: DataFrame, cap: int, *order: Column) -> DataFrame:
    return cases.orderBy(*order).limit(cap)


def batches(cases: DataFrame, size: int, *order: Column) -> DataFrame:
    """batch_id and place within it, over cases already capped: their number is a parameter."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    return cases.withColumn("__at", at).withColumn("batch_id", F.floor(F.col("__at") / size).cast("int")).withColumn("batch_index", (F.col("__at") % size).cast("int")).drop("__at")


def estimate(prompt: Column, output_tokens: int, in_price: float, out_price: float) -> Column:
    """struct<input_tokens, output_tokens, cost>: a token for four characters, prices per million."""
    tokens = F.ceil(F.length(prompt) / 4)
    return F.struct(tokens.alias("input_tokens"), F.lit(output_tokens).cast("long").alias("output_tokens"), ((tokens * in_price + output_tokens * out_price) / 1e6).alias("cost"))


def budget_gate(cases: DataFrame, stage_cap: int, run_cap: int, used: int = 0, cost_cap: float | None = None) -> DataFrame:
    """selected and reason, in route order within a stage and over the run. Call caps are monotone,
    so running counts decide; a cost cap is held on the running sum of estimates. Each stage is capped
    by a rank of its own; the counts of the run go over the rows that pass, whose number the stages'
    caps bound, and the first ``run_cap`` of those settle them all."""
    ranked = cases.withColumn("stage_at", F.row_number().over(Window.partitionBy("stage").orderBy("route_ord")))
    over = ranked.filter(F.col("stage_at") > stage_cap).select(*cases.columns, F.lit("stage_cap").alias("why"))
    passed = ranked.filter(F.col("stage_at") <= stage_cap)
    head = passed.orderBy("route_ord").limit(max(run_cap - used, 0) + 1)
    rest = passed.join(head.select("route_ord"), "route_ord", "left_anti").select(*cases.columns, F.lit("run_call_cap").alias("why"))
    running = Window.orderBy("route_ord").rowsBetween(Window.unboundedPreceding, 0)
    counted = head.withColumn("run_at", F.count("*").over(running) + used).withColumn("spent", F.sum("estimated_cost").over(running))
    over_cost = F.lit(False) if cost_cap is None else F.col("spent") > cost_cap
    why = F.when(F.col("run_at") > run_cap, "run_call_cap").when(over_cost, "run_cost_cap")
    inside = counted.select(*cases.columns, why.alias("why")).unionByName(rest).unionByName(over)
    return inside.select(*cases.columns, F.col("why").isNull().alias("selected"), F.coalesce("why", F.lit("selected")).alias("reason"))


def call_provider(cases: DataFrame, provider: Callable[[str, str], str]) -> DataFrame:
    """(case_id, response) of budgeted cases: (case_id, stage, payload). The provider is any function
    of stage and payload; errors come back as null."""

    def call(frames: Iterator) -> Iterator:
        for frame in frames:
            out = []
            for stage, payload in zip(frame["stage"], frame["payload"], strict=True):
                try:
                    out.append(provider(stage, payload))
                except Exception:  # noqa: BLE001 - any failure of a provider is a missing answer
                    out.append(None)
            yield frame[["case_id"]].assign(response=out)

    return cases.select("case_id", "stage", "payload").mapInPandas(call, "case_id string, response string")


def cached_calls(cases: DataFrame, cache: DataFrame, provider: Callable[[str, str], str], add_to: str | None = None) -> DataFrame:
    """Answers by input hash: from the cache where there, else from the provider, once per hash. The
    provider's answers are written before anything else happens, so that they are paid for once,
    and appended to the cache's folder if ``add_to`` names it."""
    keyed = cases.withColumn("input_hash", F.sha2(F.concat_ws("|", "stage", "payload"), 256))
    known = cache.groupBy("input_hash").agg(F.min("response").alias("response"))
    hits = keyed.join(known, "input_hash").select("case_id", "input_hash", "response", F.lit("hit").alias("cache_status"))
    misses = keyed.join(known, "input_hash", "left_anti")
    once = cut_lineage(misses.groupBy("input_hash").agg(F.first("stage").alias("stage"), F.first("payload").alias("payload")).withColumnRenamed("input_hash", "case_id"))
    answers = cut_lineage(call_provider(once, provider).withColumnRenamed("case_id", "input_hash"))
    if add_to is not None:
        answers.filter("response is not null").write.mode("append").parquet(add_to)
    return hits.unionByName(misses.join(answers, "input_hash").select("case_id", "input_hash", "response", F.lit("miss").alias("cache_status")))


def fallback_decision(valid: Column, abstains: Column, allowed: Column, confidence: Column, least: float) -> Column:
    """Null where a decision is taken, else why not: the first failed check of four."""
    return F.when(~valid, "invalid_response").when(abstains, "abstained").when(~allowed, "value_not_allowed").when(confidence < least, "low_confidence")


def apply_decisions(cases: DataFrame, default: Column, decided: Column, reason: Column) -> DataFrame:
    return cases.withColumn("fallback_reason", reason).withColumn("final", F.when(reason.isNull(), decided).otherwise(default)).withColumn("accepted", reason.isNull())


def linkage_answer(probability: Column) -> Column:
    """The deterministic stand-in for a provider: a match from one half on, surer away from it."""
    return F.struct(F.when(probability >= 0.5, "match").otherwise("non_match").alias("decision"), F.round(0.6 + F.abs(probability - 0.5) * 0.8, 6).alias("confidence"))


def validate_batches(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """Batches with a missing, unknown or repeated case id: (batch_id, case_id, problem)."""
    got = answers.groupBy("batch_id", "case_id").agg(F.count("*").alias("n"))
    both = expected.select("batch_id", "case_id", F.lit(True).alias("asked")).join(got, ["batch_id", "case_id"], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.withColumn("problem", problem).filter("problem is not null").select("batch_id", "case_id", "problem")


def quality_cost(routes: DataFrame) -> DataFrame:
    """Per stage: cases, calls, tokens, cost, acceptance and quality of routed cases."""
    n = lambda c: F.sum(c.cast("long"))
    c = F.col
    out = routes.groupBy("stage").agg(
        F.count("*").alias("cases"), n(c("selected")).alias("selected"), n(c("accepted")).alias("accepted"), n(~c("accepted") & c("selected")).alias("fallbacks"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
        n(c("before_correct")).alias("before_correct"), n(c("after_correct")).alias("after_correct"),
    )
    return out.withColumn("fallback_rate", safe_div(c("fallbacks"), c("selected"))).withColumn("gain", safe_div(c("after_correct") - c("before_correct"), c("cases")))


def frontier(routes: DataFrame) -> DataFrame:
    """Quality and cost when only the first b cases are decided by the provider, for every b: running
    sums over the routed cases, whose number the budget bounds."""
    running = Window.orderBy("route_ord").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    base = F.sum(F.col("before_correct").cast("long")).over(whole)
    gain = F.sum(F.col("after_correct").cast("long") - F.col("before_correct").cast("long")).over(running)
    rows = routes.select(F.row_number().over(Window.orderBy("route_ord")).alias("budget"), F.sum("cost").over(running).alias("cost"), (base + gain).alias("correct"))
    zero = routes.agg(F.lit(0).alias("budget"), F.lit(0.0).alias("cost"), F.coalesce(F.sum(F.col("before_correct").cast("long")), F.lit(0)).alias("correct"))
    return zero.unionByName(rows)


def operational_rollup(runs: DataFrame) -> DataFrame:
    """Totals, and latency weighted by the number of selected cases."""
    return runs.agg(F.sum("selected").alias("selected"), F.sum("accepted").alias("accepted"), F.sum("cost").alias("cost"), safe_div(F.sum(F.col("latency_ms") * F.col("selected")), F.sum("selected")).alias("average_latency_ms"))


def remaining(cases: DataFrame, progress: DataFrame) -> DataFrame:
    return cases.join(progress, "case_id", "left_anti")


def progress_errors(progress: DataFrame, expected: DataFrame) -> DataFrame:
    unknown = progress.join(expected, "case_id", "left_anti").select("case_id", F.lit("unknown").alias("problem")).distinct()
    twice = progress.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("duplicate").alias("problem"))
    return unknown.unionByName(twice)

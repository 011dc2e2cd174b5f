"""Runs in which a provider decides uncertain cases (assist) or all capped ones (primary)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.operators import decisions, fusion, routes, routing
from knitwork.plans.integration import IntegrationConfig, integrate
from knitwork.plans.provider import Budget, Used, gate, input_hash, replay
from knitwork.plans.runs import Run
from knitwork.session import cut_lineage
from knitwork.sources.discovery import without_gold

Provider = Callable[[str, str], str]


@dataclass(frozen=True)
class Assistance:
    """stages: which of schema, linkage and fusion a provider takes part in. The caps are feature
    limits of paid calls: per stage in assist mode, pairs and fusion cases in primary mode."""

    mode: str = "assist"
    stages: tuple[str, ...] = ("schema", "linkage", "fusion")
    cases_per_stage: int = 25
    primary_pairs: int = 5000
    primary_fusion: int = 1000
    linkage_band: tuple[float, float] = (0.35, 0.75)
    input_price: float = 0.4
    output_price: float = 1.6
    budget: Budget = Budget()
    batch_size: int = 10


#: Experiments by name: what the matrix of runs compares.
MATRIX = {
    "B-All": Assistance(),
    "B-S": Assistance(stages=("schema",)),
    "B-L": Assistance(stages=("linkage",)),
    "B-F": Assistance(stages=("fusion",)),
    "B-SL": Assistance(stages=("schema", "linkage")),
    "B-LF": Assistance(stages=("linkage", "fusion")),
    "C-LLM": Assistance(mode="primary"),
    **{f"Budget-{n}": Assistance(cases_per_stage=n, budget=Budget(stage_cases=n, run_calls=3 * n)) for n in (0, 5, 10, 25)},
}


class Desk:
    """Takes the cases of one stage after the other to the provider, within the budget, and keeps the
    routing record: called, skipped, defaulted and summary rows."""

    def __init__(self, a: Assistance, provider: Provider | None, used: Used = Used()):
        self.a, self.provider, self.used = a, provider, used
        self.primary = a.mode == "primary"
        self.records: list[DataFrame] = []

    def ask(self, stage: str, eligible: DataFrame, case_id: Column, cap: int | None, *order: Column) -> DataFrame:
        """The eligible cases that are answered, with payload, response and parsed. The first ``cap``
        by the order may go; of those the budget takes what it can pay."""
        a = self.a
        told = eligible.withColumn("case_id", case_id).withColumn("stage", F.lit(stage)).withColumn("payload", decisions.stand_in(stage))
        told = cut_lineage(told.withColumn("estimated_cost", routing.estimate(F.col("payload"), 0, a.input_price, a.output_price)["cost"]))
        chosen = routing.top_cases(told, cap, *order) if cap is not None else told
        gated = cut_lineage(gate(chosen.withColumn("route_ord", F.row_number().over(Window.orderBy(*order))), a.budget, self.used))
        taken = gated.filter("selected").drop("selected", "reason")
        if self.primary:
            taken = routing.batches(taken, a.batch_size, F.col("route_ord"))
        if self.provider is None:
            answered = taken.withColumn("response", F.col("payload"))
        else:
            answered = taken.join(cut_lineage(routing.call_provider(taken, self.provider)), "case_id")
        skipped = gated.filter("not selected").select("stage", "case_id", "reason").unionByName(told.join(chosen, "case_id", "left_anti").select("stage", "case_id", F.lit("stage_case_limit").alias("reason")))
        self.records.append((routes.defaulted if self.primary else routes.skipped)(skipped, F.col("reason")))
        if self.primary:
            flags = taken.select(F.lit(True).alias("selected")).unionByName(skipped.select(F.lit(False).alias("selected")))
            self.records.append(routes.summary(flags, stage))
        return answered.withColumn("parsed", decisions.parse(F.col("response"), stage))

    def record(self, decided: DataFrame, before: Column, after: Column) -> None:
        """Route rows of decided cases, and what they cost."""
        a = self.a
        estimate = routing.estimate(F.col("payload"), 0, a.input_price, a.output_price)
        tokens = F.ceil(F.length(F.coalesce("response", F.lit(""))) / 4)
        known = decided.select(
            "stage", "case_id", *(["batch_index"] if self.primary else []), "fallback_reason", input_hash(F.col("stage"), F.col("payload")).alias("input_hash"), estimate["input_tokens"].alias("input_tokens"), tokens.alias("output_tokens"),
            (estimate["cost"] + tokens * a.output_price / 1e6).alias("cost"), F.when(F.col("parsed").isNotNull(), "valid").otherwise("invalid").alias("validation_status"),
            F.when(F.col("response").isNull(), "provider_error").when(F.col("parsed").isNull(), "invalid_output").alias("failure_type"), before.cast("string").alias("before"), after.cast("string").alias("after"),
        )
        rows = cut_lineage((routes.batched if self.primary else routes.called)(known, F.col("fallback_reason")))
        self.records.append(rows)
        self.used = replay(rows, self.used)

    def routes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.records)


def assisted_run(spark: SparkSession, records: DataFrame, gold: DataFrame | None = None, config: IntegrationConfig = IntegrationConfig(), assistance: Assistance = Assistance(), provider: Provider | None = None, used: Used = Used(), run: Run | None = None) -> dict[str, DataFrame]:
    """Artifacts of a run with overlays, and ``routes``: the routing record. Payloads are made of the
    artifacts alone; columns that hold gold labels are dropped before anything is sent. ``used``: what
    the day's budget has gone on already."""
    a = assistance
    desk = Desk(a, provider, used)
    primary = desk.primary

    def schema(mappings: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
        ids = mappings.select("source_attribute_id") if primary else routing.route_schema(mappings)
        best = out["mapping_candidates"].filter("rank = 1").select("source_attribute_id", F.col("target").alias("best"))
        eligible = mappings.join(ids, "source_attribute_id", "left_semi").join(best, "source_attribute_id").withColumn("before", F.col("target"))
        answered = desk.ask("schema", without_gold(eligible), F.col("source_attribute_id"), None if primary else a.cases_per_stage, F.col("margin"), F.col("source_attribute_id"))
        decided = cut_lineage(decisions.decide_schema(answered, [n for n, _ in config.attributes], a.mode))
        desk.record(decided, F.col("before"), F.col("target"))
        kept = mappings.join(decided, "source_attribute_id", "left_anti")
        if primary:  # without an answer nothing is mapped
            kept = kept.withColumn("target", F.lit("UNMAPPED")).withColumn("decision", F.lit("unmapped"))
        return kept.unionByName(decided.select(*mappings.columns))

    def linkage(predictions: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
        uids = (F.col("left_uid"), F.col("right_uid"))
        eligible = predictions if primary else routing.route_linkage(predictions, *a.linkage_band)
        order = F.desc("match_probability") if primary else F.abs(F.col("match_probability") - 0.5)
        cases = without_gold(eligible).drop("label").withColumn("before", F.col("prediction"))
        answered = desk.ask("linkage", cases, F.concat_ws("|", *uids), a.primary_pairs if primary else a.cases_per_stage, order, *uids)
        decided = cut_lineage(decisions.decide_linkage(answered, a.mode))
        desk.record(decided, F.col("before"), F.col("prediction"))
        kept = predictions.join(decided, ["left_uid", "right_uid"], "left_anti")
        kept = kept.withColumn("prediction", F.lit(0)) if primary else kept
        changed = decided.select("left_uid", "right_uid", F.col("prediction").alias("decided"))
        rows = predictions.join(changed, ["left_uid", "right_uid"]).withColumn("prediction", F.col("decided")).select(*predictions.columns)
        return kept.unionByName(rows)

    def fuse(fused: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
        routed = routing.route_fusion(fusion.high_conflict(fused), fusion.low_support(fused), fusion.unsupported(fused))
        order = (F.when(F.col("confidence") == 0, 1.0).otherwise(F.col("confidence")), F.desc(F.size("alternative_values")), F.col("entity_id"), F.col("attribute"))
        cases = decisions.allowed_outputs(fused.join(routed, fusion.KEY, "left_semi"), out["claims"]).withColumn("default_supporting", F.col("supporting_claim_ids")).withColumn("default_contradicting", F.col("contradicting_claim_ids"))
        answered = desk.ask("fusion", cases.withColumn("before", F.col("selected_value")), F.concat_ws("|", *fusion.KEY), a.primary_fusion if primary else a.cases_per_stage, *order)
        decided = cut_lineage(decisions.decide_fusion(answered, a.mode))
        desk.record(decided, F.col("before"), F.col("selected_value"))
        taken = F.col("provider_used")
        ids = lambda c: F.when(taken, F.array_sort(F.col(f"parsed.{c}"))).otherwise(F.col(c)).alias(c)
        rows = decided.select(*[ids(c) if c in ("supporting_claim_ids", "contradicting_claim_ids") else F.when(taken, "provider").otherwise(F.col(c)).alias(c) if c == "fusion_method" else F.col(c) for c in fused.columns], "abstained", "provider_used")
        kept = fused.join(decided, fusion.KEY, "left_anti").withColumn("abstained", F.lit(False)).withColumn("provider_used", F.lit(False))
        return kept.unionByName(rows)

    overlays = {name: f for name, f, stage in (("mappings", schema, "schema"), ("predictions", linkage, "linkage"), ("fused", fuse, "fusion")) if stage in a.stages}
    out = integrate(spark, records, gold, config, overlays=overlays, run=run)
    if run is None:
        out["routes"] = desk.routes()
    elif desk.records:
        out["routes"] = run.table("routes", desk.routes)
    else:  # every stage was done before
        out["routes"] = spark.read.parquet(f"{run.root}/routes")
    return out


def run_matrix(spark: SparkSession, records: DataFrame, gold: DataFrame | None = None, config: IntegrationConfig = IntegrationConfig(), names: tuple[str, ...] = tuple(MATRIX), provider: Provider | None = None) -> dict[str, dict[str, DataFrame]]:
    """The deterministic run (A0) and the named experiments, by name."""
    return {"A0": integrate(spark, records, gold, config)} | {n: assisted_run(spark, records, gold, config, MATRIX[n], provider) for n in names}

"""Decisions of a provider: contracts, a deterministic stand-in, and their application.

Two modes. *assist*: uncertain cases only, and whatever fails a check keeps the deterministic
result. *primary*: the provider decides, and whatever fails falls back to a conservative default
(unmapped, no match, abstained)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRACTS = {
    "schema": "struct<source_attribute:string,target_attribute:string,decision:string,confidence:double,supporting_evidence:array<string>,abstain:boolean>",
    "linkage": "struct<decision:string,confidence:double,supporting_evidence:array<string>,contradicting_evidence:array<string>,abstain:boolean>",
    "fusion": "struct<selected_value:string,confidence:double,supporting_claim_ids:array<string>,contradicting_claim_ids:array<string>,reason:string,abstain:boolean>",
}
DECISIONS = {"schema": ("match", "unmapped", "abstain"), "linkage": ("match", "non_match", "abstain")}
LEAST = {"schema": 0.7, "linkage": 0.72, "fusion": 0.7}


def fields(stage: str, batched: bool = False) -> list[str]:
    names = [f.split(":")[0] for f in CONTRACTS[stage][7:-1].replace("array<string>", "array").split(",")]
    return (["case_id"] if batched else []) + names


def parse(response: Column, stage: str, batched: bool = False) -> Column:
    """The decision as a struct; null unless it has all fields (abstain may lack), no others, a
    confidence in [0, 1] and, where the stage has them, one of the listed decisions."""
    contract = CONTRACTS[stage] if not batched else CONTRACTS[stage].replace("struct<", "struct<case_id:string,", 1)
    parsed = F.from_json(response, contract)
    keys, known = F.json_object_keys(response), fields(stage, batched)
    wanted = [n for n in known if n != "abstain"]
    ok = (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0) & (F.size(F.array_except(F.array(*map(F.lit, wanted)), keys)) == 0)
    for name in wanted:
        ok = ok & parsed[name].isNotNull()
    ok = ok & parsed["confidence"].between(0, 1)
    if stage in DECISIONS:
        ok = ok & parsed["decision"].isin(*DECISIONS[stage])
    return F.when(F.coalesce(ok, F.lit(False)), parsed)


def parse_batch(responses: DataFrame, stage: str) -> DataFrame:
    """(batch_id, case_id, parsed) of {"decisions": [...]} responses; an item that breaks its contract
    has a null decision."""
    items = responses.select("batch_id", F.explode(F.from_json("response", "struct<decisions:array<string>>")["decisions"]).alias("item"))
    return items.select("batch_id", F.get_json_object("item", "$.case_id").alias("case_id"), parse(F.col("item"), stage, batched=True).alias("parsed"))


def stand_in(stage: str) -> Column:
    """A deterministic provider's JSON, from the case's columns. schema: attribute, best, score;
    linkage: match_probability; fusion: allowed (array), default_supporting, default_contradicting."""
    c = F.col
    evidence = F.array(F.lit("deterministic evidence")).alias("supporting_evidence")
    never = F.lit(False).alias("abstain")
    clamp = lambda x: F.greatest(F.lit(0.55), F.least(F.lit(0.9), x)).alias("confidence")
    if stage == "schema":
        target = F.coalesce("best", F.lit("UNMAPPED"))
        return F.to_json(F.struct(c("attribute").alias("source_attribute"), target.alias("target_attribute"), F.when(target == "UNMAPPED", "unmapped").otherwise("match").alias("decision"), clamp(F.coalesce("score", F.lit(0.55))), evidence, never))
    if stage == "linkage":
        p = c("match_probability")
        return F.to_json(F.struct(F.when(p >= 0.5, "match").otherwise("non_match").alias("decision"), clamp(F.abs(p - 0.5) + 0.5), evidence, F.array().cast("array<string>").alias("contradicting_evidence"), never))
    chosen = F.coalesce(F.get("allowed", F.lit(0)), F.lit("ABSTAIN"))
    return F.to_json(F.struct(chosen.alias("selected_value"), F.when(chosen != "ABSTAIN", 0.75).otherwise(0.0).alias("confidence"), c("default_supporting").alias("supporting_claim_ids"), c("default_contradicting").alias("contradicting_claim_ids"), F.lit("first allowed value").alias("reason"), (chosen == "ABSTAIN").alias("abstain")))


def stand_in_batches(cases: DataFrame, stage: str) -> DataFrame:
    """(batch_id, response): the stand-in's answers to all cases of a batch as one {"decisions": [...]},
    in the batch's order. A batch has as many cases as its size, a parameter of the run."""
    item = F.concat(F.lit('{"case_id":"'), F.col("case_id"), F.lit('",'), F.substring(stand_in(stage), 2, 1 << 30))
    rows = cases.select("batch_id", F.struct("batch_index", item.alias("item")).alias("x"))
    return rows.groupBy("batch_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("batch_id", F.concat(F.lit('{"decisions":['), F.array_join(F.transform("xs", lambda x: x["item"]), ","), F.lit("]}")).alias("response"))


def claim_prompt() -> Column:
    """What a provider is told of a claim, and no more."""
    return F.struct("claim_id", "source_id", "raw_value", F.col("value").alias("normalized_value"), "unit", F.col("confidence").alias("extraction_confidence"))


def allowed_outputs(fused: DataFrame, claims: DataFrame) -> DataFrame:
    """Per fused row the values a decision may take: all that are known and not empty, then ABSTAIN;
    with the row's claims as structs of id, value and unit."""
    known = claims.groupBy("entity_id", "attribute").agg(F.array_sort(F.collect_list(F.struct("claim_id", F.coalesce("value", F.lit("")).alias("value"), F.coalesce(F.lower(F.trim("unit")), F.lit("")).alias("unit")))).alias("known"))
    values = F.array_union(F.array("selected_value"), F.array_union("alternative_values", F.transform("known", lambda k: k["value"])))
    allowed = F.array_append(F.array_sort(F.filter(values, lambda v: v != "")), F.lit("ABSTAIN"))
    return fused.join(known, ["entity_id", "attribute"]).withColumn("allowed", allowed)


def schema_reason(parsed: Column, targets: list[str], least: float = LEAST["schema"]) -> Column:
    target = parsed["target_attribute"]
    return (
        F.when(parsed.isNull(), "invalid_output").when(F.coalesce(parsed["abstain"], F.lit(False)) | (target == "ABSTAIN"), "abstention")
        .when(~target.isin("UNMAPPED", *targets), "unsupported_target").when(parsed["confidence"] < least, "low_confidence")
    )


def linkage_reason(parsed: Column, least: float = LEAST["linkage"]) -> Column:
    return F.when(parsed.isNull(), "invalid_output").when(F.coalesce(parsed["abstain"], F.lit(False)) | (parsed["decision"] == "abstain"), "abstention").when(parsed["confidence"] < least, "low_confidence")


def fusion_reason(parsed: Column, allowed: Column, known: Column, selected_unit: Column, least: float = LEAST["fusion"]) -> Column:
    value, supporting = parsed["selected_value"], parsed["supporting_claim_ids"]
    ids = F.transform(known, lambda k: k["claim_id"])
    same = F.filter(known, lambda k: k["value"] == value)
    backing = F.filter(same, lambda k: F.array_contains(supporting, k["claim_id"]))
    units = F.array_distinct(F.filter(F.transform(backing, lambda k: k["unit"]), lambda u: u != ""))
    unit = F.coalesce(F.lower(F.trim(selected_unit)), F.lit(""))
    strangers = (F.size(supporting) == 0) | (F.size(F.array_except(supporting, ids)) > 0) | (F.size(F.array_except(parsed["contradicting_claim_ids"], ids)) > 0)
    return (
        F.when(parsed.isNull(), "invalid_output").when(F.coalesce(parsed["abstain"], F.lit(False)) | (value == "ABSTAIN"), "abstention")
        .when(~F.array_contains(allowed, value), "unsupported_value").when(strangers, "unknown_claim_id").when(F.size(backing) == 0, "unsupported_value")
        .when((unit != "") & (F.size(units) > 0) & ~F.array_contains(units, unit), "incompatible_unit").when(parsed["confidence"] < least, "low_confidence")
    )


def decide_schema(cases: DataFrame, targets: list[str], mode: str = "assist") -> DataFrame:
    """target and decision of (source_attribute_id, target, parsed), with the fallback reason."""
    reason = schema_reason(F.col("parsed"), targets)
    kept = F.col("target") if mode == "assist" else F.lit("UNMAPPED")
    target = F.when(reason.isNull(), F.col("parsed.target_attribute")).otherwise(kept)
    return cases.withColumn("fallback_reason", reason).withColumn("target", target).withColumn("decision", F.when(F.col("target") == "UNMAPPED", "unmapped").otherwise("accepted"))


def decide_linkage(cases: DataFrame, mode: str = "assist") -> DataFrame:
    reason = linkage_reason(F.col("parsed"))
    kept = F.col("prediction") if mode == "assist" else F.lit(0)
    return cases.withColumn("fallback_reason", reason).withColumn("prediction", F.when(reason.isNull(), (F.col("parsed.decision") == "match").cast("int")).otherwise(kept))


def decide_fusion(cases: DataFrame, mode: str = "assist") -> DataFrame:
    """A failed check keeps the value (assist; an abstention is marked) or blanks it (primary)."""
    reason = fusion_reason(F.col("parsed"), F.col("allowed"), F.col("known"), F.col("selected_unit"))
    taken = reason.isNull()
    abstained = ~taken & ((reason == "abstention") if mode == "assist" else F.lit(True))
    value = F.when(taken, F.col("parsed.selected_value")).otherwise(F.col("selected_value") if mode == "assist" else F.lit(""))
    confidence = F.when(taken, F.col("parsed.confidence")).otherwise(F.col("confidence") if mode == "assist" else F.lit(0.0))
    return cases.withColumn("fallback_reason", reason).withColumn("abstained", abstained).withColumn("provider_used", taken).withColumn("confidence", confidence).withColumn("selected_value", value)


def daily_usage(calls: DataFrame, day: Column | None = None) -> DataFrame:
    """Calls and cost of one day (today unless given) of a call log with created_at and cost."""
    return calls.filter(F.to_date("created_at") == (day if day is not None else F.current_date())).agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))

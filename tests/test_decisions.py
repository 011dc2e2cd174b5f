"""Contracts, the order of checks, and both modes' fallbacks."""

import json

from pyspark.sql import functions as F

from knitwork.operators import decisions as D
from knitwork.operators import report

GOOD = {"decision": "match", "confidence": 0.9, "supporting_evidence": [], "contradicting_evidence": []}


def test_contracts(spark):
    texts = {"ok": GOOD, "with": GOOD | {"abstain": True}, "extra": GOOD | {"x": 1}, "range": GOOD | {"confidence": 1.5}, "enum": GOOD | {"decision": "perhaps"}, "lacks": {"decision": "match"}}
    rows = [(k, json.dumps(v)) for k, v in texts.items()] + [("broken", "{"), ("null", None)]
    got = {r.k: r.p is not None for r in spark.createDataFrame(rows, "k string, r string").select("k", D.parse(F.col("r"), "linkage").alias("p")).collect()}
    assert {k for k, v in got.items() if v} == {"ok", "with"}
    batch = spark.createDataFrame([(1, json.dumps({"decisions": [GOOD | {"case_id": "a"}, GOOD | {"case_id": "b", "confidence": 2}]}))], "batch_id int, response string")
    assert {r.case_id: r.parsed is not None for r in D.parse_batch(batch, "linkage").collect()} == {"a": True, "b": False}


def fusion_case(spark, **decision):
    base = {"selected_value": "15", "confidence": 0.9, "supporting_claim_ids": ["c1"], "contradicting_claim_ids": [], "reason": "r"} | decision
    df = spark.createDataFrame([(json.dumps(base), ["15", "16", "ABSTAIN"], [("c1", "15", "inch"), ("c2", "16", "cm")], "inch", "16", 0.5)], "response string, allowed array<string>, known array<struct<claim_id:string,value:string,unit:string>>, selected_unit string, selected_value string, confidence double")
    return df.withColumn("parsed", D.parse(F.col("response"), "fusion"))


def test_fusion_checks_in_order(spark):
    reason = lambda **d: D.decide_fusion(fusion_case(spark, **d)).first().fallback_reason
    assert reason() is None
    assert reason(abstain=True) == "abstention"
    assert reason(selected_value="17") == "unsupported_value"
    assert reason(supporting_claim_ids=["zz"]) == "unknown_claim_id" and reason(supporting_claim_ids=[]) == "unknown_claim_id"
    assert reason(selected_value="16") == "unsupported_value"
    assert reason(selected_value="16", supporting_claim_ids=["c2"]) == "incompatible_unit"
    assert reason(confidence=0.1) == "low_confidence"
    taken = D.decide_fusion(fusion_case(spark)).first()
    assert (taken.selected_value, taken.confidence, taken.abstained, taken.provider_used) == ("15", 0.9, False, True)
    kept, blank = (D.decide_fusion(fusion_case(spark, abstain=True), m).first() for m in ("assist", "primary"))
    assert (kept.selected_value, kept.abstained) == ("16", True) and (blank.selected_value, blank.abstained) == ("", True)


def test_schema_modes(spark):
    ok = {"source_attribute": "a", "target_attribute": "brand", "decision": "match", "confidence": 0.9, "supporting_evidence": []}
    rows = [("1", "title", json.dumps(ok)), ("2", "title", json.dumps(ok | {"target_attribute": "nope"})), ("3", "title", json.dumps(ok | {"confidence": 0.2})), ("4", "title", "no")]
    df = spark.createDataFrame(rows, "source_attribute_id string, target string, r string").withColumn("parsed", D.parse(F.col("r"), "schema"))
    run = lambda mode: {r.source_attribute_id: (r.target, r.fallback_reason) for r in D.decide_schema(df, ["brand", "title"], mode).collect()}
    assert run("assist") == {"1": ("brand", None), "2": ("title", "unsupported_target"), "3": ("title", "low_confidence"), "4": ("title", "invalid_output")}
    assert {v[0] for k, v in run("primary").items() if k != "1"} == {"UNMAPPED"}


def test_means_skip_what_is_missing(spark):
    row = spark.createDataFrame([(0.5, None, 1.0)], "a double, b double, c double").select(report.mean_present("a", "b", "c").alias("m"), report.mean_present("b").alias("none")).first()
    assert row.m == 0.75 and row.none is None
    runs = spark.createDataFrame([("A0", 3), ("C-LLM", 0)], "configuration string, fusion_evaluated int")
    assert report.missing_configurations(runs, ("A0", "C-LLM", "B-All")) == ["C-LLM", "B-All"]
    assert report.missing_configurations(runs) == [c for c in report.REQUIRED if c != "A0"] and len(report.REQUIRED) == 12

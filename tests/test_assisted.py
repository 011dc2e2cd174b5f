"""Assisted and primary runs on a few products, with the stand-in and with a failing provider."""

import json

import pytest

from knitwork.plans.assisted import Assistance, assisted_run


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for i in range(6):
        for s in ("s1", "s2", "s3"):
            payload = {"product name": f"Canon EOS {1000 + i}D reflex {s}", "maker": "canon", "model": f"EOS-{1000 + i}D", "sale price": f"${300 + i}.00", "finish": f"black {s}"}
            rows.append((f"{s}:{i}", s, str(i), json.dumps(payload)))
    return spark.createDataFrame(rows, "record_uid string, source_id string, source_record_id string, raw_payload string")


def test_assist_keeps_what_fails(spark, records):
    out = assisted_run(spark, records, assistance=Assistance(cases_per_stage=5), provider=lambda stage, payload: "no json")
    every = out["routes"].collect()
    routes = [r for r in every if r.selected]
    assert all(r.fallback_reason == "stage_case_limit" and r.call_count_charge == 0 for r in every if not r.selected)
    assert routes and all(not r.accepted and r.fallback_reason == "invalid_output" and r.before == r.after for r in routes)
    before = sorted(map(tuple, out["deterministic_mappings"].select("source_attribute_id", "target").collect()))
    assert before == sorted(map(tuple, out["mappings"].select("source_attribute_id", "target").collect()))
    assert max(sum(r.stage == s for r in routes) for s in ("schema", "linkage", "fusion")) <= 5
    assert not any("gold" in (r.case_id or "") for r in routes)


def test_primary_defaults_are_conservative(spark, records):
    out = assisted_run(spark, records, assistance=Assistance(mode="primary", stages=("linkage",), primary_pairs=3))
    kept = out["predictions"].filter("prediction = 1").count()
    rows = out["routes"].collect()
    called = [r for r in rows if r.selected]
    assert kept <= 3 and len(called) == 3
    # one batch: one call, charged to its first case
    assert sum(r.call_count_charge for r in called) == 1 and sum(r.cost > 0 for r in called) == 1
    (total,) = [r for r in rows if r.summary]
    assert total.case_id == "__primary_summary__" and total.eligible_count == out["deterministic_predictions"].count() == 3 + total.unselected_default_count
    assert all(r.defaulted for r in rows if not r.selected and not r.summary)
    assert out["predictions"].count() == out["deterministic_predictions"].count()
    assert out["entities"].count() == out["clusters"].count()

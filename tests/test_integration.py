"""Readers, components, clusters, fusion, routing and a whole run on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from knitwork.operators import fusion, matching, routing, schema_align
from knitwork.operators.clustering import Cluster, ClusterConfig, conflict, constrained_clusters
from knitwork.operators.components import connected_components
from knitwork.plans.integration import integrate
from knitwork.plans.runs import open_run
from knitwork.sources.readers import Source, ingest, read_entity_gold, read_mapping_gold, read_or_none, write_checked
from knitwork.streaming.progress import follow_progress


def test_formats_give_the_same_records(spark, tmp_path):
    rows = [{"id": "a1", "title": "One"}, {"id": "a2", "title": "Two"}]
    (tmp_path / "r.csv").write_text("id,title\na1,One\na2,Two\n")
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n{\"id\":\n[1]\n")
    spark.createDataFrame(rows, "id string, title string").write.parquet(f"{tmp_path}/r.parquet")
    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "a1.json").write_text(json.dumps(rows[0]))
    (tmp_path / "d" / "bad.json").write_text('{"id":')
    sources = [Source(f, f"{tmp_path}/r.{f}", f, "id") for f in ("csv", "json", "jsonl", "parquet")] + [Source("dir", f"{tmp_path}/d", "json_dir")]
    records, errors = ingest(spark, sources)
    got = {r.record_uid: json.loads(r.raw_payload) for r in records.collect()}
    assert got == {f"{f}:{r['id']}": r for f in ("csv", "json", "jsonl", "parquet") for r in rows} | {"dir:x/a1": rows[0]}
    assert sorted((r.source_id, r.error_type) for r in errors.collect()) == [("dir", "malformed_row"), ("jsonl", "malformed_row"), ("jsonl", "malformed_row")]


def test_gold_and_sinks(spark, tmp_path):
    (tmp_path / "e.csv").write_text("entity_id,spec_id\ne1,s//1\ne1,s//1\ne2,\n")
    assert [tuple(r) for r in read_entity_gold(spark, f"{tmp_path}/e.csv").collect()] == [("e1", "s//1")]
    (tmp_path / "m.csv").write_text("source_attribute_id,target_attribute_name\na,x\na,y\n")
    assert read_mapping_gold(spark, f"{tmp_path}/m.csv").first().target_attribute_name == "y"
    assert read_or_none(spark, f"{tmp_path}/none.parquet") is None
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    write_checked(df, f"{tmp_path}/ok", "k long, v string")
    with pytest.raises(ValueError, match="schema differs"):
        write_checked(df, f"{tmp_path}/no", "k long")


def least(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(300)], [(0, i) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], [(random.Random(i).randrange(150), random.Random(i + 999).randrange(150)) for i in range(110)], []])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    assert dict(map(tuple, connected_components(df).collect())) == least(edges)


def test_conflicts():
    a = Cluster("a", "s1", "canon", ["EOS4000", "4000"], "15", "")
    assert conflict(a, Cluster("b", "s1", "canon", [], "", ""), ClusterConfig()) == "same_source_duplicate"
    assert conflict(a, Cluster("c", "s2", "sony", [], "", ""), ClusterConfig()) == "brand_conflict"
    assert conflict(a, Cluster("d", "s3", "canon", ["4000"], "24", ""), ClusterConfig()) == "screen_size_conflict"
    assert conflict(a, Cluster("e", "s3", "canon", ["5000"], "", ""), ClusterConfig()) == "model_conflict"
    assert conflict(a, Cluster("f", "s3", "", [], "", "x"), ClusterConfig()) is None
    assert conflict(a, Cluster("g", "s3", "", [], "", ""), ClusterConfig(max_size=1)) == "max_cluster_size"


def test_constrained_clusters(spark):
    records = spark.createDataFrame([("a", "s1", "x", "", "", ""), ("b", "s2", "x", "", "", ""), ("c", "s2", "x", "", "", ""), ("d", "s3", "y", "", "", ""), ("e", "s9", "", "", "", "")], "uid string, source_id string, brand string, model_number string, screen string, resolution string")
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "d", 0.85), ("a", "e", 0.6)], "left_uid string, right_uid string, match_probability double")
    members, log = constrained_clusters(records, edges)
    got = dict(map(tuple, members.collect()))
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert sorted(r.reason for r in log.collect()) == ["brand_conflict", "compatible", "same_source_duplicate"]


def test_fusion_ties_and_empties(spark):
    rows = [("e", "color", "1", "red", "", 1), ("e", "color", "2", "blue", "", 2), ("e", "size", "3", "10", "in", 1), ("e", "size", "4", "12", "cm", 2), ("e", "size", "5", "20", "cm", 3), ("e", "note", "6", "", "", 1), ("e", "title", "7", "abcd", "", 1), ("e", "title", "8", "abcde", "", 2), ("e", "title", "9", "zzz", "", 3)]
    fused = {r.attribute: r for r in fusion.fuse(spark.createDataFrame(rows, "entity_id string, attribute string, claim_id string, value string, unit string, ord int")).collect()}
    assert fused["color"].selected_value == "red" and fused["color"].confidence == 0.5
    assert fused["size"].selected_value == "12" and fused["size"].selected_unit == "cm"
    assert fused["note"].selected_value == "" and fused["note"].confidence == 1.0
    assert fused["title"].selected_value == "abcde"


def test_calibration_default_and_lowest_winner(spark):
    rows = spark.createDataFrame([(0.9, 1, "validation"), (0.1, 0, "validation")], "match_probability double, label int, split string")
    assert matching.calibrate(rows).first().threshold == 0.2
    assert matching.calibrate(rows.limit(0)).first().threshold == 0.5


def test_rollup_weights_latency(spark):
    runs = spark.createDataFrame([(2, 1, 0.1, 100.0), (1, 1, 0.2, 400.0)], "selected int, accepted int, cost double, latency_ms double")
    assert routing.operational_rollup(runs).first().average_latency_ms == 200


def test_core_schema_is_required(spark):
    with pytest.raises(ValueError, match="lacks"):
        schema_align.mediated_schema(spark, (("title", "string"),))


def test_whole_run_and_stage_cache(spark, tmp_path):
    rows = []
    for i in range(12):
        for s in ("s1", "s2", "s3"):
            payload = {"product name": f"Canon EOS {1000 + i}D reflex", "maker": "canon", "model": f"EOS-{1000 + i}D", "sale price": f"${300 + i}.00", "colour": "black"}
            rows.append((f"{s}:{i}", s, str(i), json.dumps(payload)))
    records = spark.createDataFrame(rows, "record_uid string, source_id string, source_record_id string, raw_payload string")
    gold = spark.createDataFrame([(u, f"g{n}") for u, _, n, _ in rows], "uid string, gold_entity string")
    out = integrate(spark, records, gold)
    members = out["memberships"].collect()
    assert sorted(r.uid for r in members) == sorted(r[0] for r in rows)
    assert out["pairs"].filter("left_uid >= right_uid").count() == 0
    claims = {r.claim_id for r in out["claims"].collect()}
    assert all(set(r.supporting_claim_ids) <= claims for r in out["fused"].collect())
    assert out["entities"].count() == out["clusters"].count()
    assert set(integrate(spark, records, gold, stop_after="schema")) == {"values", "profiles", "mapping_candidates", "mappings"}
    metrics = {r.level: r for r in out["cluster_metrics"].collect()}
    assert set(metrics) == {"constrained", "components"} and all(0 <= r.f1 <= 1 for r in metrics.values())
    assert sorted(r.uid for r in out["component_members"].collect()) == sorted(r[0] for r in rows)
    run, made = open_run(spark, f"{tmp_path}/run", "r1", {"config": "a", "dataset": "b"}), []
    for _ in range(2):
        assert run.table("clusters", lambda: made.append(1) or out["clusters"]).count() == out["clusters"].count()
    assert made == [1]
    again = open_run(spark, f"{tmp_path}/run", "r1", {"config": "a", "dataset": "b"}, resume=True)
    assert again.complete("clusters") and not again.complete("fused")
    for wrong in (("r2", {"config": "a"}), ("r1", {"config": "other"})):
        with pytest.raises(ValueError):
            open_run(spark, f"{tmp_path}/run", *wrong, resume=True)


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"case_id": "a"}\n{"case_id": "a"}\n{"case_id": "b"}\n')
    follow_progress(spark, f"{tmp_path}/in", "case_id string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    # the same case in a later batch is not written again
    (tmp_path / "in" / "2.json").write_text('{"case_id": "b"}\n')
    follow_progress(spark, f"{tmp_path}/in", "case_id string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out").select("case_id")
    assert sorted(r.case_id for r in done.collect()) == ["a", "b"]
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert [r.case_id for r in routing.remaining(cases, done).collect()] == ["c"]
    assert routing.progress_errors(done.union(done.limit(1)).union(spark.createDataFrame([("z",)], "case_id string")), cases).count() == 2


def test_provider_errors_are_missing_answers(spark):
    cases = spark.createDataFrame([("1", "s", "ok"), ("2", "s", "bad")], "case_id string, stage string, payload string")

    def provider(stage, payload):
        if payload == "bad":
            raise RuntimeError
        return stage + payload

    assert {r.case_id: r.response for r in routing.call_provider(cases, provider).collect()} == {"1": "sok", "2": None}
    assert cases.filter(F.col("case_id") == "1").count() == 1

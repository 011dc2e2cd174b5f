"""Discovery, provider calls, budgets, resumed releases and the command line, on a few records."""

import json

import pytest
from pyspark.sql import functions as F

from knitwork.operators import report
from knitwork.plans import cli, provider, release
from knitwork.plans.provider import Budget, HttpProvider, Model, Used, gate, replay
from knitwork.sources import discovery


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for s in ("s1", "s2", "s3"):
        (root / "shop" / s).mkdir(parents=True)
        for i in range(5):
            payload = {"product name": f"Canon EOS {1000 + i}D reflex {s}", "maker": "canon", "model": f"EOS-{1000 + i}D", "sale price": f"${300 + i}.00", "finish": f"black {s}"}
            (root / "shop" / s / f"{i}.json").write_text(json.dumps(payload))
    (root / "shop" / "s1" / "bad.json").write_text('{"a":')
    (root / "shop" / "empty").mkdir()
    (root / "gold.csv").write_text("entity_id,spec_id\n" + "".join(f"g{i},{s}//{i}\n" for s in ("s1", "s2", "s3") for i in range(5)))
    (root / "mapping.csv").write_text("source_attribute_id,target_attribute_name\ns1//maker,brand\ns2//maker,brand\ns3//finish,color\n")
    return root


@pytest.fixture(scope="module")
def config(folder, spark):
    sources = [{"source_id": s.source_id, "path": s.path, "format": s.format} for s in discovery.discover_sources(spark, f"{folder}/shop")]
    (folder / "sources.json").write_text(json.dumps({"sources": sources, "gold": f"{folder}/gold.csv", "mapping_gold": f"{folder}/mapping.csv"}))
    return str(folder / "sources.json")


def test_discovery(spark, folder):
    files = discovery.json_files(spark, f"{folder}/shop")
    assert {r.source_id: r.files for r in discovery.files_per_source(files).collect()} == {"s1": 6, "s2": 5, "s3": 5}
    found = discovery.discover_verticals(spark, {"shop": f"{folder}/shop", "none": f"{folder}/nowhere"})
    assert [s.source_id for s in found["shop"]] == ["s1", "s2", "s3"] and set(found) == {"shop"}
    specs = spark.createDataFrame([("s1//0",), ("s1//bad",), ("s9//0",), ("noid",)], "spec_id string")
    got = discovery.payloads_of(specs, files, spark).collect()
    assert [r.spec_id for r in got] == ["s1//0"] and json.loads(got[0].payload)["maker"] == "canon"
    assert discovery.row_count(spark, f"{folder}/nothing.parquet") is None
    import hashlib

    sums = {r.path.rsplit("/", 1)[1]: r.checksum for r in discovery.file_checksums(spark, f"{folder}/gold.csv").collect()}
    assert sums == {"gold.csv": hashlib.sha256((folder / "gold.csv").read_bytes()).hexdigest()}


def test_clean(tmp_path):
    for name in ("out/a.txt", "keep/.gitkeep", "data/raw/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert discovery.clean(str(tmp_path), ["out", "keep", "gone"]) == ["out"]
    assert (tmp_path / "out/a.txt").exists()
    assert discovery.clean(str(tmp_path), ["out"], really=True) == ["out"] and not (tmp_path / "out/a.txt").exists()
    for bad in ("data/raw", "../elsewhere"):
        with pytest.raises(ValueError):
            discovery.clean(str(tmp_path), [bad], really=True)
    for n in ("run_old_shop_1", "run_shop_2"):
        (tmp_path / n).mkdir()
    assert discovery.latest_run(str(tmp_path), "Shop!") is None
    (tmp_path / "run_shop_2" / "run.json").write_text("{}")
    assert discovery.latest_run(str(tmp_path), "Shop!") == "run_shop_2"


def test_http_provider_tries_again():
    tried = []

    def post(url, body, headers, timeout):
        tried.append(json.loads(body))
        if len(tried) < 3:
            raise OSError
        return json.dumps({"output": [{"content": [{"text": "yes"}]}]}).encode()

    model = Model(provider="http", name="m", template="Q: {{payload}}")
    assert HttpProvider("u", "k", model, retries=2, post=post)("linkage", "p") == "yes" and tried[0]["input"] == "Q: p"
    tried.clear()
    with pytest.raises(RuntimeError, match="2 attempts"):
        HttpProvider("u", "k", model, retries=1, post=post)("linkage", "p")
    assert provider.dispatch(Model()) is None
    with pytest.raises(ValueError):
        provider.dispatch(Model(provider="x"))


def test_strict_schema():
    schema = {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "object", "properties": {"x": {}}}}, "a": {}}, "required": ["a"]}
    got = provider.strict(schema)
    assert got["required"] == ["a", "b"] and got["additionalProperties"] is False
    assert got["properties"]["b"]["items"]["required"] == ["x"] and schema["required"] == ["a"]


def test_budget_goes_on_where_it_was(spark):
    rows = [("s", i, 0.1) for i in range(10)]
    cases = spark.createDataFrame(rows, "stage string, route_ord int, estimated_cost double")
    assert gate(cases, Budget()).filter("selected").count() == 10
    assert gate(cases, Budget(run_calls=4)).filter("selected").count() == 4
    assert gate(cases, Budget(stage_cases=0)).filter("selected").count() == 0
    charged = spark.createDataFrame([("s", 1, 0.1), ("s", 0, 0.0), ("t", 1, 0.3)], "stage string, call_count_charge int, cost double")
    used = replay(charged)
    assert used.run_calls == 2 and used.by_stage == (("s", 1), ("t", 1)) and abs(used.run_cost - 0.4) < 1e-9
    assert gate(cases, Budget(run_calls=4), used).filter("selected").count() == 2
    assert gate(cases, Budget(stage_cases=4), used).filter("selected").count() == 3
    over = gate(cases, Budget(daily_cost=0.75), Used(daily_cost=0.4)).filter("not selected").collect()
    assert len(over) == 7 and {r.reason for r in over} == {"daily_cost_budget"}


def test_release_resumes_and_is_checked(spark, folder, config, tmp_path):
    cli.main(["ingest", "--config", config, "--out", f"{tmp_path}/in"], spark)
    records = spark.read.parquet(f"{tmp_path}/in/records")
    gold = spark.read.csv(f"{folder}/gold.csv", header=True).select(F.replace("spec_id", F.lit("//"), F.lit(":")).alias("uid"), F.col("entity_id").alias("gold_entity"))
    manifest = release.run_release(spark, f"{tmp_path}/rel", records, gold, names=("A0", "Budget-0"))
    assert release.read_manifest(f"{tmp_path}/rel") == manifest
    release.check_release(manifest, ("A0", "Budget-0"))
    with pytest.raises(ValueError, match="B-All"):
        release.check_release(manifest)
    with pytest.raises(ValueError):
        release.check_scale(manifest, ("x",))
    again = release.run_release(spark, f"{tmp_path}/rel", records, gold, names=("A0", "Budget-0"))
    assert again == manifest
    routes = spark.read.parquet(f"{tmp_path}/rel/Budget-0/routes")
    assert routes.filter("selected").count() == 0
    rows = {r.configuration: r for r in release.summaries(spark, manifest).collect()}
    assert rows["A0"].label == "Deterministic" and rows["A0"].cluster_f1 == rows["Budget-0"].cluster_f1
    with pytest.raises(ValueError, match="A0, Budget-0"):
        release.check_coverage(release.summaries(spark, manifest))
    cli.main(["report", "--release", f"{tmp_path}/rel", "--out", f"{tmp_path}/report", "--names", "A0,Budget-0"], spark)
    assert spark.read.csv(f"{tmp_path}/report/summaries", header=True).count() == 2
    assert spark.read.text(f"{tmp_path}/report/entities").count() == spark.read.parquet(f"{tmp_path}/rel/A0/entities").count()
    with pytest.raises(ValueError, match="changed"):
        release.run_release(spark, f"{tmp_path}/rel", records.limit(3), gold, names=("A0",))


def test_command_line(spark, config, tmp_path, capsys):
    cli.main(["schema", "evaluate", "--config", config, "--out", str(tmp_path)], spark)
    metrics = json.loads((tmp_path / "schema_metrics.json").read_text())
    assert metrics["tp"] >= 2 and list(metrics) == sorted(metrics)
    cli.main(["schema", "validate", "--config", config], spark)
    assert capsys.readouterr().out.strip() == "8"
    cli.main(["run", "--config", config, "--out", f"{tmp_path}/run", "--upto", "schema"], spark)
    cli.main(["run", "--config", config, "--out", f"{tmp_path}/run", "--upto", "normalize", "--resume"], spark)
    assert json.loads((tmp_path / "run/run/run.json").read_text())["done"][:3] == ["values", "profiles", "mappings"]
    cli.main(["dataset", "subset", "--config", config, "--out", str(tmp_path), "--entities", "2"], spark)
    assert spark.read.json(f"{tmp_path}/subset/records").count() == 6
    assert spark.read.csv(f"{tmp_path}/subset/entity_gold", header=True).count() == 6
    assert report.missing_configurations(spark.createDataFrame([], "configuration string, fusion_evaluated long"), ("A0",)) == ["A0"]

"""python -m knitwork.plans.cli COMMAND ...

Sources are listed in a JSON file:
{"sources": [{"source_id": ..., "path": ..., "format": ..., "id_field": ...}], "gold": "clusters.csv",
 "mapping_gold": "mapping.csv", "fusion_gold": "fusion.jsonl", "attributes": [["title", "string"], ...]}
"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.operators import candidates, profile, report, routes, schema_align, subset
from knitwork.plans import release
from knitwork.plans.assisted import MATRIX, assisted_run
from knitwork.plans.integration import STAGES, IntegrationConfig, integrate, row_digest
from knitwork.plans.runs import open_run
from knitwork.session import build_session
from knitwork.sources import discovery, readers


def _config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _settings(config: dict) -> IntegrationConfig:
    made = IntegrationConfig()
    return replace(made, attributes=tuple(tuple(a) for a in config["attributes"])) if config.get("attributes") else made


def _records(spark: SparkSession, config: dict, out: str) -> DataFrame:
    records, errors = readers.ingest(spark, [readers.Source(**s) for s in config["sources"]])
    records.write.mode("overwrite").parquet(f"{out}/records")
    errors.write.mode("overwrite").parquet(f"{out}/errors")
    records = spark.read.parquet(f"{out}/records")
    readers.write_csv(readers.manifest(records), f"{out}/manifest")
    return records


def _gold(spark: SparkSession, config: dict) -> DataFrame | None:
    if not config.get("gold"):
        return None
    return readers.read_entity_gold(spark, config["gold"]).select(F.replace("spec_id", F.lit("//"), F.lit(":")).alias("uid"), F.col("entity_id").alias("gold_entity"))


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    _records(spark, _config(a.config), a.out)


def stage(spark: SparkSession, a: argparse.Namespace) -> None:
    """One run up to a stage; with --resume what an earlier attempt settled is read."""
    config = _config(a.config)
    records = readers.read_or_none(spark, f"{a.out}/records") if a.resume else None
    if records is None:  # nothing is ingested yet
        records = _records(spark, config, a.out)
    settings = _settings(config)
    run = open_run(spark, f"{a.out}/run", a.run_id, {"config": settings.digest(), "dataset": row_digest(records.drop("ingested_at"))}, a.resume)
    out = integrate(spark, records, _gold(spark, config), settings, stop_after=a.upto, run=run)
    for name in sorted(set(out) - set(run.done)):
        run.table(name, lambda: out[name])  # noqa: B023
    if a.upto == STAGES[-1]:
        run.finish()


def experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    config = _config(a.config)
    records = _records(spark, config, a.out)
    out = assisted_run(spark, records, _gold(spark, config), _settings(config), MATRIX[a.name])
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")


def run_release(spark: SparkSession, a: argparse.Namespace) -> None:
    config = _config(a.config)
    names = tuple(a.names.split(",")) if a.names else report.REQUIRED
    release.run_release(spark, a.out, _records(spark, config, f"{a.out}/input"), _gold(spark, config), _settings(config), names)


def run_scale(spark: SparkSession, a: argparse.Namespace) -> None:
    """Every dataset whole, deterministic: --datasets name=config.json,..."""
    datasets = {}
    for pair in a.datasets.split(","):
        name, path = pair.split("=", 1)
        config = _config(path)
        datasets[name] = (_records(spark, config, f"{a.out}/input-{name}"), _gold(spark, config))
    release.run_scale(spark, a.out, datasets)


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tables of a release as CSV, and its entities as JSON lines. Whatever is missing is an error."""
    manifest = release.read_manifest(a.release)
    release.check_release(manifest, tuple(a.names.split(",")) if a.names else report.REQUIRED)
    gold = None
    if a.fusion_gold:
        rows = readers.read_fusion_gold(spark, a.fusion_gold)
        gold = rows.select("entity_id", F.col("mediated_attribute").alias("attribute"), F.col("selected_truth_value").alias("truth"))
    summaries = release.summaries(spark, manifest, gold)
    if gold is not None:
        release.check_coverage(summaries)
    readers.write_csv(summaries.coalesce(1), f"{a.out}/summaries")
    ops = None
    for r in manifest["runs"]:
        if "routes" in r["tables"]:
            rows = spark.read.parquet(f"{r['folder']}/routes").filter("not summary")
            n = lambda c: c.cast("int")
            part = rows.select(F.lit(r["configuration"]).alias("configuration"), n(F.col("selected")).alias("selected"), n(F.col("accepted")).alias("accepted"), n(F.col("fallback_applied")).alias("fallbacks"), n(F.col("validation_status") == "invalid").alias("invalid"), n(F.coalesce(F.col("fallback_reason") == "abstention", F.lit(False))).alias("abstained"), "cost", "latency_ms")
            ops = part if ops is None else ops.unionByName(part)
    if ops is not None:
        summary = routes.operational(ops)
        readers.write_csv(summary.coalesce(1), f"{a.out}/operational")
        quality = summaries.select("configuration", "end_to_end", F.lit(None).cast("double").alias("linkage_f1"))
        readers.write_csv(report.budget_series(quality, summary).coalesce(1), f"{a.out}/budget_series")
    release.final_dataset(spark, manifest, f"{a.out}/entities")


def dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.action == "discover":
        found = discovery.discover_sources(spark, a.root)
        print(json.dumps({"sources": [asdict(s) for s in found]}, indent=2))
    elif a.action == "profile":
        records = _records(spark, _config(a.config), a.out)
        values = profile.explode_payload(records).withColumn("ord", F.struct("record_uid", "attr_ord"))
        counts = records.groupBy("source_id").agg(F.count("*").alias("records"))
        profile.attribute_profiles(values.select("source_id", "attribute", "ord", "value"), counts).write.mode("overwrite").parquet(f"{a.out}/profiles")
    elif a.action == "select":
        metrics = spark.read.parquet(a.metrics).withColumn("selection_score", candidates.local_score())
        readers.write_csv(candidates.selection_table(metrics, F.col(a.gate) if a.gate else F.lit(True)).coalesce(1), f"{a.out}/selection")
    else:
        config = _config(a.config)
        records, gold = _records(spark, config, f"{a.out}/input"), readers.read_entity_gold(spark, config["gold"])
        parts = [F.get(F.split("spec_id", "//", 2), F.lit(k)) for k in (0, 1)]
        chosen = subset.select_entities(gold.select("entity_id", parts[0].alias("source_id"), parts[1].alias("record_id")), a.entities, a.seed)
        mapping = readers.read_mapping_gold(spark, config["mapping_gold"]) if config.get("mapping_gold") else None
        fused = spark.read.json(config["fusion_gold"]) if config.get("fusion_gold") else None
        subset.materialize(f"{a.out}/subset", chosen, gold, records, mapping, fused)


def schema(spark: SparkSession, a: argparse.Namespace) -> None:
    config = _config(a.config)
    if a.action == "validate":
        print(schema_align.mediated_schema(spark, _settings(config).attributes).count())
        return
    records = _records(spark, config, a.out)
    out = integrate(spark, records, None, _settings(config), stop_after="schema")
    gold = readers.read_mapping_gold(spark, config["mapping_gold"]).select("source_attribute_id", F.col("target_attribute_name").alias("target"))
    discovery.write_metrics(schema_align.mapping_metrics(out["mappings"], gold), f"{a.out}/schema_metrics.json")


def clean(_: SparkSession | None, a: argparse.Namespace) -> None:
    print("\n".join(discovery.clean(a.root, a.targets, a.yes)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="knitwork")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, action, *needed: str, **optional):
        p = commands.add_parser(name)
        p.set_defaults(action_=action)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=default, **({"type": int} if isinstance(default, int) and not isinstance(default, bool) else {}))
        return p

    add("ingest", ingest, "config", "out")
    staged = add("run", stage, "config", "out", run_id="run", upto=STAGES[-1])
    staged.add_argument("--resume", action="store_true")
    add("experiment", experiment, "config", "out").add_argument("--name", choices=sorted(MATRIX), required=True)
    add("release", run_release, "config", "out", names=None)
    add("scale", run_scale, "datasets", "out")
    add("report", run_report, "release", "out", names=None, fusion_gold=None)
    add("dataset", dataset, root=None, config=None, out=None, metrics=None, gate=None, entities=60, seed=13).add_argument("action", choices=["discover", "profile", "select", "subset"])
    add("schema", schema, "config", out=None).add_argument("action", choices=["validate", "evaluate"])
    cleaning = add("clean", clean, "root")
    cleaning.add_argument("targets", nargs="+")
    cleaning.add_argument("--yes", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.action_(spark if spark is not None or a.command == "clean" else build_session(), a)


if __name__ == "__main__":
    main()

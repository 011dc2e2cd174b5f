"""Releases: a matrix of runs over one dataset, deterministic runs over several, and what they are held to."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.operators import report
from knitwork.plans.assisted import MATRIX, Provider, assisted_run
from knitwork.plans.integration import IntegrationConfig, integrate, row_digest
from knitwork.plans.runs import MARKER, open_run
from knitwork.sources.readers import write_jsonl

MANIFEST = "release.json"


def _attempt(spark: SparkSession, root: str, name: str, records: DataFrame, gold: DataFrame | None, config: IntegrationConfig, provider: Provider | None, digest: str) -> dict:
    """One configuration in its own folder: read where it is complete, gone on with where it began."""
    folder = f"{root}/{name}"
    made = hashlib.sha256(json.dumps(asdict(MATRIX[name]), sort_keys=True).encode()).hexdigest() if name in MATRIX else None
    hashes = {"config": config.digest(), "dataset": digest, "assistance": made}
    run = open_run(spark, folder, name, hashes, resume=(Path(folder) / MARKER).exists())
    if run.status != "complete":
        if name in MATRIX:
            out = assisted_run(spark, records, gold, config, MATRIX[name], provider, run=run)
        else:
            out = integrate(spark, records, gold, config, run=run)
        run.table("entities", lambda: out["entities"])
        run.table("cluster_metrics", lambda: out["cluster_metrics"])
        run.finish()
    return {"configuration": name, "role": "deterministic" if name not in MATRIX else MATRIX[name].mode, "folder": folder, "hashes": run.hashes, "tables": sorted(run.done)}


def _write(root: str, manifest: dict) -> dict:
    Path(root).mkdir(parents=True, exist_ok=True)
    (Path(root) / MANIFEST).write_text(json.dumps(manifest, indent=2, sort_keys=True), encoding="utf-8")
    return manifest


def run_release(spark: SparkSession, root: str, records: DataFrame, gold: DataFrame | None = None, config: IntegrationConfig = IntegrationConfig(), names: tuple[str, ...] = report.REQUIRED, provider: Provider | None = None) -> dict:
    """The configurations by name, each resumed where an earlier attempt left it; the manifest."""
    digest = row_digest(records)
    runs = [_attempt(spark, root, n, records, gold, config, provider, digest) for n in names]
    return _write(root, {"mode": "release", "runs": runs, "dataset": digest, "with_provider": provider is not None})


def run_scale(spark: SparkSession, root: str, datasets: dict[str, tuple[DataFrame, DataFrame | None]], config: IntegrationConfig = IntegrationConfig()) -> dict:
    """The deterministic run over every dataset, whole: A0-name each."""
    runs = [_attempt(spark, root, f"A0-{name}", records, gold, config, None, row_digest(records)) for name, (records, gold) in datasets.items()]
    return _write(root, {"mode": "deterministic_scale", "runs": runs, "with_provider": False})


def read_manifest(root: str) -> dict:
    return json.loads((Path(root) / MANIFEST).read_text(encoding="utf-8"))


def check_release(manifest: dict, required: tuple[str, ...] = report.REQUIRED, live: bool = False) -> None:
    """An error where configurations are missing, or a provider was called for and none took part."""
    if manifest.get("mode") != "release" or live and not manifest.get("with_provider"):
        raise ValueError("not the manifest of a release" + (" with a provider" if live else ""))
    missing = sorted(set(required) - {r["configuration"] for r in manifest["runs"]})
    if missing:
        raise ValueError(f"missing configurations: {', '.join(missing)}")


def check_scale(manifest: dict, datasets: tuple[str, ...]) -> None:
    if manifest.get("mode") != "deterministic_scale":
        raise ValueError("not the manifest of deterministic runs")
    missing = sorted({f"A0-{d}" for d in datasets} - {r["configuration"] for r in manifest["runs"]})
    if missing:
        raise ValueError(f"missing configurations: {', '.join(missing)}")


def check_coverage(summaries: DataFrame) -> None:
    names = [r.configuration for r in report.uncovered(summaries).orderBy("configuration").collect()]
    if names:
        raise ValueError(f"no evaluated fusion values: {', '.join(names)}")


def summaries(spark: SparkSession, manifest: dict, fusion_gold: DataFrame | None = None) -> DataFrame:
    """Per configuration: label, cluster metrics, fused rows and the mean of what is measured; a row a
    run, from the runs' tables. ``fusion_gold``: entity_id, attribute, truth."""
    from knitwork.operators import fusion

    out = None
    for r in manifest["runs"]:
        read = lambda t: spark.read.parquet(f"{r['folder']}/{t}")  # noqa: B023, E731
        metrics = read("cluster_metrics").filter("level = 'constrained'").select(F.col("f1").alias("cluster_f1"), F.lit(1).alias("one"))
        if fusion_gold is None:
            fused = spark.createDataFrame([(0, None, 1)], "fusion_evaluated long, fusion_accuracy double, one int")
        else:
            fused = fusion.fusion_accuracy(read("fused"), fusion_gold, read("clusters")).select(F.col("evaluated").alias("fusion_evaluated"), F.col("accuracy").alias("fusion_accuracy"), F.lit(1).alias("one"))
        name = F.lit(r["configuration"])
        row = metrics.join(fused, "one").select(name.alias("configuration"), report.label(name).alias("label"), "cluster_f1", "fusion_evaluated", "fusion_accuracy", report.rounded(report.mean_present("cluster_f1", "fusion_accuracy")).alias("end_to_end"))
        out = row if out is None else out.unionByName(row)
    return out


def final_dataset(spark: SparkSession, manifest: dict, path: str) -> str:
    """The entities of the preferred run as JSON lines; which run that was."""
    from knitwork.operators.cases import preferred_run

    folders = {r["configuration"]: r["folder"] for r in manifest["runs"]}
    name = preferred_run(list(folders))
    write_jsonl(spark.read.parquet(f"{folders[name]}/entities"), path)
    return name

"""What lies in a folder of JSON records by source, and sinks for short results.

Layout: root / vertical / source / record.json. Folders are listed by Spark's file source, so any store
that it can read will do; only names pass through the plans here, unless payloads are asked for.
"""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.sources.readers import Source


def json_files(spark: SparkSession, root: str) -> DataFrame:
    """path, source_id and record_id of every JSON file under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    path = F.url_decode(F.col("path"))
    parts = F.split(path, "/")
    return files.select(F.col("path"), F.element_at(parts, -2).alias("source_id"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("record_id"))


def files_per_source(files: DataFrame) -> DataFrame:
    return files.groupBy("source_id").agg(F.count("*").alias("files"))


def discover_sources(spark: SparkSession, root: str) -> list[Source]:
    """A source for each folder that holds a JSON file, by name; a folder without any is none."""
    folders = json_files(spark, root).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "source_id").distinct()
    return [Source(r.source_id, r.folder, "json_dir") for r in folders.orderBy("source_id", "folder").collect()]


def discover_verticals(spark: SparkSession, roots: dict[str, str]) -> dict[str, list[Source]]:
    """Sources by vertical; verticals whose folder is missing or empty are left out."""
    from pyspark.errors import AnalysisException

    found = {}
    for name, root in roots.items():
        try:
            sources = discover_sources(spark, root)
        except AnalysisException:
            continue
        if sources:
            found[name] = sources
    return found


def payloads_of(specs: DataFrame, files: DataFrame, spark: SparkSession) -> DataFrame:
    """spec_id and payload of ``source//record`` ids: only the files asked for are opened. Ids without
    a file, and files that aren't JSON objects, give no row."""
    parts = [F.get(F.split("spec_id", "//", 2), F.lit(k)) for k in (0, 1)]
    asked = specs.select("spec_id", parts[0].alias("source_id"), parts[1].alias("record_id")).distinct()
    wanted = asked.join(files, ["source_id", "record_id"]).select("spec_id", "path")
    paths = [r.path for r in wanted.select("path").distinct().collect()]  # as many as the report shows
    if not paths:
        return spark.createDataFrame([], "spec_id string, payload string")
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("payload"))
    return wanted.join(texts, "path").filter(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")).select("spec_id", "payload")


def manifest_mismatches(manifest: DataFrame, total: int) -> DataFrame:
    """One row where the counts of the sources don't add up to the total."""
    return manifest.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("counted")).filter(F.col("counted") != total).withColumn("total", F.lit(total).cast("long"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, by path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("checksum"))


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a Parquet table, counted from its footers; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return None


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file on the driver: sorted keys, indented."""
    (found,) = row.toJSON().collect()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(json.loads(found), indent=2, sort_keys=True) + "\n", encoding="utf-8")


def without_gold(df: DataFrame) -> DataFrame:
    """The columns that may reach a provider: none whose name speaks of gold or ground truth."""
    return df.select(*[c for c in df.columns if not any(x in c.lower() for x in ("gold", "ground_truth"))])


def nonempty(values: Column) -> Column:
    """The set of the values that are neither null nor empty, sorted."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def latest_run(root: str, slug: str, marker: str = "run.json") -> str | None:
    """The newest run folder of that name that has a marker file."""
    short = "_".join(x for x in "".join(c if c.isalnum() else " " for c in slug.lower()).split())[:24]
    runs = [p for p in Path(root).glob(f"run_*{short}*") if (p / marker).exists()]
    return max(runs, key=lambda p: p.stat().st_mtime).name if runs else None


def clean(root: str, targets: list[str], really: bool = False) -> list[str]:
    """Generated paths under ``root`` that hold anything; deleted only if ``really``, and never outside
    the root or under a raw data folder. A folder keeps its .gitkeep."""
    base, found = Path(root).resolve(), []
    for name in targets:
        path = (base / name).resolve()
        if base not in path.parents:
            raise ValueError(f"outside the root: {name}")
        if path.is_file() or path.is_dir() and any(x.name != ".gitkeep" for x in path.iterdir()):
            found.append(os.path.relpath(path, base))
    if really:
        raw = [x for x in found if x == "data/raw" or x.startswith("data/raw/")]
        if raw:
            raise ValueError(f"raw data is never deleted: {raw}")
        for name in found:
            path = base / name
            for x in [path] if path.is_file() else [x for x in path.iterdir() if x.name != ".gitkeep"]:
                shutil.rmtree(x) if x.is_dir() else x.unlink()
            if path.is_dir():
                (path / ".gitkeep").touch()
    return found

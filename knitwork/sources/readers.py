"""Readers of heterogeneous sources into one record table, with malformed input on the side."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.functions.values import record_uid

RECORDS = "record_uid string, source_id string, source_record_id string, raw_payload string, raw_checksum string, ingested_at timestamp"


@dataclass(frozen=True)
class Source:
    source_id: str
    path: str
    format: str  # csv, json, jsonl, parquet or json_dir
    id_field: str | None = None


def _typed(df: DataFrame, id_field: str) -> DataFrame:
    columns = sorted(df.columns)
    return df.select(F.col(id_field).cast("string").alias("id"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in sorted(df.dtypes)])).alias("payload")) if columns else df


def _parsed(lines: DataFrame, id_field: str | None) -> DataFrame:
    """(id, payload) from texts of single JSON objects; the id from a field unless there already."""
    tree = F.try_parse_json("payload")
    kind = F.schema_of_variant(tree)
    return lines.withColumn("ok", kind.startswith("OBJECT")).withColumn("id", F.try_variant_get(tree, f"$['{id_field}']", "string") if id_field else F.col("id"))


def read_source(spark: SparkSession, s: Source) -> DataFrame:
    """source_id, id, payload, error_type, position (file or line, for the error)."""
    none = F.lit(None).cast("string")
    if s.format == "csv":
        rows = _typed(spark.read.csv(s.path, header=True, inferSchema=False, multiLine=True), s.id_field).withColumn("ok", F.lit(True)).withColumn("position", none)
    elif s.format == "parquet":
        rows = _typed(spark.read.parquet(s.path), s.id_field).withColumn("ok", F.lit(True)).withColumn("position", none)
    elif s.format == "jsonl":
        lines = spark.read.text(s.path).select(F.col("value").alias("payload"), F.concat(F.lit("line_"), (F.monotonically_increasing_id() + 1).cast("string")).alias("position")).filter(F.trim("payload") != "")
        rows = _parsed(lines, s.id_field)
    elif s.format == "json":
        files = spark.read.text(s.path, wholetext=True).select(F.col("value").alias("whole"))
        as_list = F.when(F.trim("whole").startswith("["), F.col("whole")).otherwise(F.concat(F.lit("["), F.col("whole"), F.lit("]")))
        items = files.select(F.posexplode_outer(F.try_variant_get(F.try_parse_json(as_list), "$", "array<variant>")).alias("at", "item"))
        rows = _parsed(items.select(F.to_json("item").alias("payload"), F.col("at").cast("string").alias("position")), s.id_field)
    elif s.format == "json_dir":
        files = spark.read.text(s.path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
        name = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + "\\Q" + s.path.rstrip("/").rsplit("/", 1)[-1] + "\\E/", "")
        rows = _parsed(files.select(F.trim("value").alias("payload"), F.regexp_replace(F.url_decode(name), r"\.json$", "").alias("id")).withColumn("position", F.col("id")), None)
    else:
        raise ValueError(f"unknown format: {s.format}")
    uid = record_uid(F.lit(s.source_id), F.col("id"))
    error = F.when(~F.coalesce("ok", F.lit(False)), "malformed_row").when(uid.isNull(), "unstable_identifier")
    return rows.select(F.lit(s.source_id).alias("source_id"), F.col("id").alias("source_record_id"), "payload", "position", uid.alias("record_uid"), error.alias("error_type"))


def ingest(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """(records, errors). Repeated record ids are errors too, all but the first payload of each."""
    rows = reduce(DataFrame.unionByName, [read_source(spark, s) for s in sources])
    return split_records(rows)


def split_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = rows.filter("error_type is null")
    first = good.groupBy("record_uid").agg(F.min_by(F.struct("source_id", "source_record_id", "payload"), F.col("payload")).alias("r"), F.count("*").alias("n"))
    records = first.select("record_uid", "r.source_id", "r.source_record_id", F.col("r.payload").alias("raw_payload"), F.sha2("r.payload", 256).alias("raw_checksum"), F.current_timestamp().alias("ingested_at"))
    bad = rows.filter("error_type is not null").select("source_id", "error_type", F.coalesce("position", "source_record_id").alias("position"), "payload")
    again = first.filter("n > 1").select("r.source_id", F.lit("duplicate_identifier").alias("error_type"), F.col("record_uid").alias("position"), F.col("r.payload").alias("payload"))
    return records, bad.unionByName(again)


def manifest(records: DataFrame) -> DataFrame:
    """Record count and an order-free checksum of each source."""
    return records.groupBy("source_id").agg(F.count("*").alias("record_count"), F.sha2(F.array_join(F.array_sort(F.collect_list("raw_checksum")), ""), 256).alias("input_checksum"))


def read_entity_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    uid = F.col("record_uid") if "record_uid" in rows.columns else F.lit(None).cast("string")
    spec = F.col("spec_id") if "spec_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("entity_id", F.coalesce(F.nullif(spec, F.lit("")), uid).alias("spec_id")).filter("entity_id <> '' and spec_id <> ''").distinct()


def read_mapping_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True).withColumn("at", F.monotonically_increasing_id())
    return rows.groupBy("source_attribute_id").agg(F.max_by("target_attribute_name", "at").alias("target_attribute_name"))


def read_fusion_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).select("entity_id", "mediated_attribute", F.col("selected_truth_value").cast("string").alias("selected_truth_value"))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_checked(df: DataFrame, path: str, schema: str) -> None:
    """Writes only what has exactly the declared columns and types."""
    from pyspark.sql.types import _parse_datatype_string

    want = {f.name: f.dataType for f in _parse_datatype_string(schema)}
    have = {f.name: f.dataType for f in df.schema}
    if want != have:
        raise ValueError(f"schema differs: {sorted(set(want.items()) ^ set(have.items()), key=str)}")
    df.select(*want).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns)))).write.mode("overwrite").text(path)

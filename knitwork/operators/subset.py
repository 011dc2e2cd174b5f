"""Reproducible subsets of entities with everything that belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_entities(gold: DataFrame, n: int, seed: int = 13, required: tuple[str, ...] = ()) -> DataFrame:
    """Entities by required first, then most sources, most records, a seeded hash, the id.
    ``gold``: entity_id, source_id, record_id."""
    sizes = gold.groupBy("entity_id").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("specs"))
    tie = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "entity_id"), 256), 1, 16)
    first = F.col("entity_id").isin(*required) if required else F.lit(False)
    return sizes.withColumn("tie", tie).orderBy(F.desc(first), F.desc("sources"), F.desc("specs"), "tie", "entity_id").limit(n).select("entity_id", "sources", "specs", "tie")


def restrict(rows: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    return rows.join(chosen.select(*keys).distinct(), list(keys), "left_semi")


def spec_lists(gold: DataFrame) -> DataFrame:
    """entity_id with its specs in a list, repeated ones too. An entity has few of them by nature."""
    return gold.filter("entity_id <> '' and spec_id <> ''").groupBy("entity_id").agg(F.array_sort(F.collect_list("spec_id")).alias("specs"))


def materialize(out: str, chosen: DataFrame, gold: DataFrame, records: DataFrame, mapping_gold: DataFrame | None = None, fusion_gold: DataFrame | None = None) -> None:
    """A subset on disk: its records, by source, and the gold tables cut down to it.

    ``gold``: entity_id, spec_id (source//record); ``records``: source_id, source_record_id,
    raw_payload. Sources without a chosen record don't appear; mapping gold keeps the sources that do,
    fusion gold the chosen entities. Everything is a semi-join; nothing passes through the driver."""
    specs = restrict(gold, chosen, "entity_id")
    parts = [F.get(F.split("spec_id", "//", 2), F.lit(k)) for k in (0, 1)]
    ids = specs.filter(F.col("spec_id").contains("//")).select(parts[0].alias("source_id"), parts[1].alias("source_record_id")).distinct()
    kept = records.join(ids, ["source_id", "source_record_id"], "left_semi")
    kept.select("source_id", "source_record_id", F.col("raw_payload").alias("payload")).write.mode("overwrite").partitionBy("source_id").json(f"{out}/records")
    specs.select("entity_id", "spec_id").write.mode("overwrite").option("header", True).csv(f"{out}/entity_gold")
    if mapping_gold is not None:
        source = F.split("source_attribute_id", "//", 2)[0]
        mapping_gold.join(kept.select("source_id").distinct(), source == F.col("source_id"), "left_semi").write.mode("overwrite").option("header", True).csv(f"{out}/mapping_gold")
    if fusion_gold is not None:
        restrict(fusion_gold, chosen, "entity_id").write.mode("overwrite").json(f"{out}/fusion_gold")

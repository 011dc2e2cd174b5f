"""Attribute profiles and dataset metrics over exploded payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.text import jaccard
from knitwork.functions.values import as_float, safe_div

# What profiling looks for in values and names.
MODEL = r"(?iU)\b[A-Z]{1,5}[- ]?\d{2,5}[A-Z0-9-]*\b"
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
CURRENCY = r"(?iU)([$€£]|usd|eur|gbp)\b"
URL = r"(?i)^https?://"
UNIT = r"(?iU)\b(mm|cm|inch|inches|kg|g|gb|tb|hz|mp|mah|w)\b"
PATTERNS = {"has_model_like_token": MODEL, "has_number": r"(?U)\d", "has_unit": UNIT, "has_currency": CURRENCY, "has_url": URL}
#: Values that types and roles are read from; samples and frequent values kept.
SNIFFED, SAMPLES = 50, 5


def explode_payload(records: DataFrame) -> DataFrame:
    """One row per non-empty attribute: attr_ord is the key's place; of repeated keys the last value
    counts, at the first place."""
    pairs = records.select("record_uid", "source_id", "source_record_id", F.posexplode(F.map_entries(F.from_json("raw_payload", "map<string,string>"))).alias("attr_ord", "kv"))
    rows = pairs.select("record_uid", "source_id", "source_record_id", "attr_ord", F.col("kv.key").alias("attribute"), F.col("kv.value").alias("value"))
    once = rows.groupBy("record_uid", "source_id", "source_record_id", "attribute").agg(F.min("attr_ord").alias("attr_ord"), F.max_by("value", "attr_ord").alias("value"))
    return once.filter("value is not null and value <> ''")


def attribute_profiles(values: DataFrame, record_counts: DataFrame) -> DataFrame:
    """Per (source, attribute) of (source_id, attribute, ord, value): rates, lengths, numbers, type,
    roles, units, pattern counts, frequent and first values. Lists are top-k, never whole groups: a
    row number with a limit on it is planned as a partial group limit, so that each task keeps the
    first rows of its own before the shuffle, and no task sorts all values of an attribute."""
    key = ["source_id", "attribute"]
    number = as_float(F.when(F.trim("value").rlike(PLAIN_NUMBER), F.col("value")))
    ranked = values.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "value")))
    sniffed = ranked.filter(F.col("at") <= SNIFFED).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("first"))
    counted = values.groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "ord", "value"))).filter(F.col("rank") <= SAMPLES).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("top"))
    stats = values.groupBy(*key).agg(
        F.count("*").alias("non_null"), F.countDistinct("value").alias("cardinality"),
        F.min(F.length("value")).alias("length_min"), F.avg(F.length("value")).alias("length_avg"), F.max(F.length("value")).alias("length_max"),
        F.min(number).alias("number_min"), F.avg(number).alias("number_avg"), F.max(number).alias("number_max"),
        F.bool_and((F.trim("value") == "") | F.trim("value").rlike(PLAIN_NUMBER)).alias("all_numbers"),
        *[F.sum(F.col("value").rlike(p).cast("int")).alias(n) for n, p in PATTERNS.items()],
    )
    joined = F.array_join(F.transform("first", lambda x: x["value"]), " ")
    out = stats.join(sniffed, key).join(top, key).join(record_counts, "source_id").withColumn("joined", joined)
    return out.select(
        *key, F.concat_ws("//", *key).alias("source_attribute_id"), "non_null",
        safe_div(F.col("non_null"), F.col("records")).alias("non_null_rate"), (1 - safe_div(F.col("non_null"), F.col("records"))).alias("null_rate"),
        safe_div(F.col("cardinality"), F.col("non_null")).alias("uniqueness_rate"), "cardinality",
        "length_min", "length_avg", "length_max", "number_min", "number_avg", "number_max", *PATTERNS,
        infer_type(F.col("attribute"), F.col("joined"), F.col("all_numbers"), F.col("length_avg")).alias("inferred_type"),
        semantic_roles(F.col("attribute"), F.col("joined")).alias("semantic_roles"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("joined", F.lit(UNIT), F.lit(1)))).alias("unit_patterns"),
        F.transform("top", lambda x: x["value"]).alias("frequent_values"), F.transform(F.slice("first", 1, SAMPLES), lambda x: x["value"]).alias("sample_values"),
    )


def infer_type(attribute: Column, joined: Column, all_numbers: Column, mean_length: Column) -> Column:
    return (
        F.when(all_numbers, "number").when(attribute.rlike(CURRENCY) | joined.rlike(CURRENCY), "currency_or_price")
        .when(joined.rlike(URL), "url").when(joined.rlike(UNIT), "measurement").when(mean_length > 80, "free_text").otherwise("string")
    )


def semantic_roles(attribute: Column, joined: Column) -> Column:
    name = F.lower(attribute)
    roles = F.array_compact(F.array(
        F.when(name.contains("title") | name.isin("name", "product name"), "title"),
        F.when(name.rlike("brand|manufacturer|maker"), "brand"),
        F.when(name.contains("model") | joined.rlike(MODEL), "model identifier"),
        F.when(name.contains("price") | joined.rlike(CURRENCY), "price"),
        F.when(name.contains("currency"), "currency"), F.when(name.rlike("description|features"), "description"),
        F.when(name.rlike("category|type"), "category"), F.when(joined.rlike(UNIT), "measurement"), F.when(joined.rlike(URL), "URL"),
    ))
    return F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("specification")))


def heterogeneity(profiles: DataFrame) -> DataFrame:
    """Mean Jaccard distance between the attribute sets of all pairs of sources: one row. Pairs of
    sources come from the sources' own short list, not from records."""
    sets = profiles.groupBy("source_id").agg(F.array_sort(F.collect_set(F.lower("attribute"))).alias("names"))
    both = sets.alias("a").join(sets.alias("b"), F.col("a.source_id") < F.col("b.source_id"))
    return both.agg(F.coalesce(F.avg(1 - jaccard(F.col("a.names"), F.col("b.names"))), F.lit(0.0)).alias("schema_heterogeneity"))


def fusion_conflicts(values: DataFrame) -> DataFrame:
    """(entity, attribute) groups with more than one distinct value, by lower case and trimmed."""
    seen = values.select("entity_id", F.lower("attribute").alias("attribute"), F.lower(F.trim("value")).alias("value")).filter("value <> ''")
    return seen.groupBy("entity_id", "attribute").agg(F.countDistinct("value").alias("values")).filter("values > 1")


def gold_summary(gold: DataFrame) -> DataFrame:
    """Entities, labelled records, positive pairs and the overlap score of an entity gold table."""
    sizes = gold.distinct().groupBy("entity_id").agg(F.count("*").alias("n"))
    pairs, shared = F.sum(F.expr("n * (n - 1) div 2")), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return sizes.agg(F.count("*").alias("entities"), F.sum("n").alias("labelled"), pairs.alias("positive_pairs"), safe_div(shared, F.sum("n")).alias("overlap_score"))


def selection_score(m: dict[str, Column]) -> Column:
    """Ten capped terms; keys as the metric names."""
    capped = lambda name, full, points: F.least(m[name] / full, F.lit(1.0)) * points
    return F.round(
        capped("source_count", 8, 10) + capped("record_count", 25000, 10) + capped("entity_count", 500, 15) + capped("positive_pairs", 500, 15)
        + capped("mediated_coverage", 8, 15) + m["schema_heterogeneity"] * 10 + m["overlap_score"] * 10 + m["model_number_coverage"] * 5
        + capped("title_signal_coverage", 1, 5) + capped("fusion_conflicts", 200, 5), 4,
    )


def gate(m: dict[str, Column]) -> Column:
    least = {"source_count": 3, "record_count": 1000, "mediated_coverage": 5, "entity_count": 200, "positive_pairs": 300, "fusion_conflicts": 100}
    out = F.lit(True)
    for name, n in least.items():
        out = out & (m[name] >= n)
    return out

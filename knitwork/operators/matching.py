"""Pair features, rule scores, the calibrated match model and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.functions.text import jaccard_of_sets, model_number, model_tokens, qgrams, text, tokens
from knitwork.functions.values import as_float, f1, price_similarity, safe_div

FEATURES = ("title_token_jaccard", "title_char_similarity", "brand_exact", "brand_conflict", "model_exact", "model_token_overlap", "model_conflict", "category_exact", "price_relative_similarity", "spec_key_jaccard", "blocking_rule_count", "same_source")
GRID = tuple(round(0.2 + 0.05 * i, 2) for i in range(15))


def pair_features(pairs: DataFrame, records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The twelve features. ``records``: uid, source_id, title, brand, model_number, category, price,
    spec_keys (array of the names of everything but core attributes). ``carry``: columns of the records
    that come along, as left_<name> and right_<name>.

    Tokens, 3-grams and canonical forms are made once a record, not once a pair, and a pair only
    compares them. Records are merged to the pairs by sorting: by the size of their file, a good
    deal less than that of their rows, they would be broadcast, and all go through the driver."""
    low = lambda c: F.lower(text(F.col(c)))
    model = model_number(F.col("model_number"))
    made = records.select(
        "uid", "source_id", F.array_distinct(tokens(F.col("title"))).alias("tokens"), F.array_distinct(qgrams(low("title"), 3)).alias("grams"), low("brand").alias("brand"),
        model.alias("model"), F.array_distinct(model_tokens(model)).alias("model_tokens"), low("category").alias("category"), as_float(F.col("price")).alias("price"),
        F.array_distinct("spec_keys").alias("spec_keys"), *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    side = lambda p: made.select(*[F.col(c).alias(f"{p}_{c}") for c in made.columns]).hint("merge")
    both = pairs.join(side("left"), "left_uid").join(side("right"), "right_uid")
    part = lambda f: (F.col(f"left_{f}"), F.col(f"right_{f}"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def same(ab: tuple[Column, Column]) -> Column:
        return flag((ab[0] != "") & (ab[0] == ab[1]))

    def clash(ab: tuple[Column, Column]) -> Column:
        return flag((ab[0] != "") & (ab[1] != "") & (ab[0] != ab[1]))

    brand, models, category = part("brand"), part("model"), part("category")
    return both.select(
        "left_uid", "right_uid", "rules", jaccard_of_sets(*part("tokens")).alias("title_token_jaccard"), jaccard_of_sets(*part("grams")).alias("title_char_similarity"),
        same(brand).alias("brand_exact"), clash(brand).alias("brand_conflict"), same(models).alias("model_exact"),
        jaccard_of_sets(*part("model_tokens")).alias("model_token_overlap"), clash(models).alias("model_conflict"), same(category).alias("category_exact"),
        price_similarity(*part("price")).alias("price_relative_similarity"), jaccard_of_sets(*part("spec_keys")).alias("spec_key_jaccard"),
        F.size("rules").cast("double").alias("blocking_rule_count"), flag(F.col("left_source_id") == F.col("right_source_id")).alias("same_source"),
        *[F.col(f"{p}_carried_{c}").alias(f"{p}_{c}") for c in carry for p in ("left", "right")],
    )


# The ladder's limits and scores, and their order.
def rule_score() -> Column:
    c = F.col
    mixed = c("title_token_jaccard") * 0.7 + c("spec_key_jaccard") * 0.2
    return (
        F.when((c("brand_conflict") > 0) | (c("model_conflict") > 0), 0.05)
        .when((c("model_exact") > 0) & ((c("brand_exact") > 0) | (c("title_token_jaccard") > 0.25)), 0.95)
        .when((c("brand_exact") > 0) & (c("title_token_jaccard") > 0.5), 0.8)
        .when((c("title_token_jaccard") > 0.65) & (c("spec_key_jaccard") > 0.2), 0.7)
        .otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.6), mixed)))
    )


def split_of(entity: Column, uid: Column, seed: int = 13) -> Column:
    """train, validation or test: labelled rows by a hash of seed and entity (60 / 20 / 20, an
    entity's rows together), others by thirds of a hash of the uid."""
    at = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), entity), 256), 1, 8), 16, 10).cast("long") % 100
    digit_sum = F.aggregate(F.split(F.sha2(uid, 256), ""), F.lit(0), lambda a, d: a + F.coalesce(F.conv(F.nullif(d, F.lit("")), 16, 10).cast("int"), F.lit(0)))
    other = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), digit_sum % 3 + 1)
    return F.when(entity.isNull(), other).when(at < 60, "train").when(at < 80, "validation").otherwise("test")


def pair_label(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int"))


def pair_split(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise("heldout_cross_split")


def shuffled_splits(entities: list[str], seed: int = 13) -> dict[str, str]:
    """The seeded shuffle of sorted ids, cut at 60 and 80 percent; for short gold lists."""
    import random

    order = sorted(entities)
    random.Random(seed).shuffle(order)
    a, b = int(len(order) * 0.6), int(len(order) * 0.8)
    return {e: "train" if i < a else "validation" if i < b else "test" for i, e in enumerate(order)}


def match_model(features: DataFrame, seed: int = 13) -> DataFrame:
    """match_probability = 0.8 model + 0.2 rule where the training rows hold both labels and at
    least four rows, else the rule score. ``features`` has label and split besides the features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = features.withColumn("rule_score", rule_score())
    train = scored.filter("split = 'train' and label is not null")
    seen = train.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), *[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES]).first()
    if seen.n < 4 or seen.classes < 2:
        return scored.withColumn("match_probability", F.col("rule_score")).withColumn("model_status", F.lit("rule_fallback"))
    z = lambda df: df.select("*", *[((F.col(f) - seen[f"{f}_m"]) / (seen[f"{f}_s"] or 1.0)).alias(f"z_{f}") for f in FEATURES])
    pack = VectorAssembler(inputCols=[f"z_{f}" for f in FEATURES], outputCol="vector")
    fit = LogisticRegression(featuresCol="vector", labelCol="label", regParam=1.0 / seen.n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
    model = fit.fit(pack.transform(z(train)))
    out = model.transform(pack.transform(z(scored))).withColumn("model_probability", vector_to_array("probability")[1])
    return out.select(*scored.columns, (0.8 * F.col("model_probability") + 0.2 * F.col("rule_score")).alias("match_probability"), F.lit("trained").alias("model_status"))


def calibrate(scored: DataFrame, default: float = 0.5, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(threshold, f1): the grid's lowest threshold of highest F1 on labelled validation rows; the
    default where there are none. The grid multiplies narrow aggregates, not the rows' columns."""
    rows = scored.filter("split = 'validation' and label is not null").select("match_probability", "label")
    tried = rows.select("label", "match_probability", F.explode(F.array(*map(F.lit, grid))).alias("threshold")).withColumn("hit", F.col("match_probability") >= F.col("threshold"))
    counts = tried.groupBy("threshold").agg(*[F.sum((c).cast("int")).alias(n) for n, c in {"tp": F.col("hit") & (F.col("label") == 1), "fp": F.col("hit") & (F.col("label") == 0), "fn": ~F.col("hit") & (F.col("label") == 1)}.items()])
    score = f1(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    best = counts.withColumn("f1", score).agg(F.min_by(F.struct("threshold", "f1"), F.struct((-F.col("f1")).alias("x"), "threshold")).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(default)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def classification_metrics(predicted: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 of (split, label, prediction), for all four splits."""
    spine = predicted.sparkSession.createDataFrame([("train",), ("validation",), ("test",), ("heldout_cross_split",)], "split string")
    cell = lambda l, p: F.coalesce(F.sum(((F.col("label") == l) & (F.col("prediction") == p)).cast("long")), F.lit(0))
    counts = spine.join(predicted.filter("label is not null"), "split", "left").groupBy("split").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("split", "tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))

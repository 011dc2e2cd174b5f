"""Candidate pairs from blocking keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.functions.text import informative_tokens, model_number, model_tokens, qgrams, text, tokens
from knitwork.functions.values import safe_div


#: The rules of ``blocking_keys``.
RULES = ("brand_model", "category_title_token", "character_signature", "rare_model_token", "rare_title_token", "spec_signature")


@dataclass(frozen=True)
class BlockingConfig:
    max_block_size: int = 250
    rare_token_max_frequency: int = 80
    title_token_limit: int = 6
    qgram_size: int = 3


def token_frequencies(records: DataFrame) -> DataFrame:
    return records.select(F.explode(informative_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _key(rule: str, key: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), key.alias("key"))


def blocking_keys(records: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """(uid, rule, key) by six rules. ``records``: uid, brand, model_number, title, category, screen,
    resolution. Title q-grams come from the sorted tokens, so that they are the same in every run."""
    brand, category, title = F.lower(text(F.col("brand"))), F.lower(text(F.col("category"))), text(F.col("title"))
    model = model_number(F.col("model_number"))
    one = lambda ok, k: F.when(ok, F.array(k))
    compact = F.array_join(F.array_sort(tokens(title)), "")
    screen, resolution = text(F.col("screen")), text(F.col("resolution"))
    direct = F.flatten(F.array_compact(F.array(
        one((brand != "") & (model != ""), _key("brand_model", F.concat_ws("|", brand, model))),
        F.transform(model_tokens(F.concat_ws(" ", text(F.col("model_number")), title)), lambda t: _key("rare_model_token", t)),
        F.transform(F.slice(qgrams(compact, config.qgram_size), 1, 4), lambda g: _key("character_signature", g)),
        one((brand != "") & (screen != ""), _key("spec_signature", F.concat_ws("|", brand, F.lit("screen"), screen))),
        one((brand != "") & (resolution != ""), _key("spec_signature", F.concat_ws("|", brand, F.lit("resolution"), resolution))),
    )))
    records = _dealt(records, "uid")
    # by uid already, so that repeated keys of one uid go without another exchange
    keys = records.select("uid", F.explode(direct).alias("k")).select("uid", "k.rule", "k.key").distinct()
    chosen = records.select("uid", category.alias("category"), F.explode(F.slice(informative_tokens(title), 1, config.title_token_limit)).alias("token"))
    rare = chosen.join(token_frequencies(records).filter(F.col("df") <= config.rare_token_max_frequency), "token")
    titled = rare.select("uid", F.lit("rare_title_token").alias("rule"), F.col("token").alias("key"))
    with_category = rare.filter("category <> ''").select("uid", F.lit("category_title_token").alias("rule"), F.concat_ws("|", "category", "token").alias("key"))
    return keys.unionByName(titled.distinct()).unionByName(with_category.distinct())


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt over all shuffle partitions, a fixed number that isn't merged again: a table of one or two row
    groups would be worked on in as many tasks, and rows that are short here grow manifold when exploded."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("rule", "key").agg(F.count("*").alias("block_size"))


def candidate_pairs(keys: DataFrame, config: BlockingConfig = BlockingConfig(), rules: tuple[str, ...] | None = None) -> DataFrame:
    """left_uid < right_uid with the sorted rules they share a block of. Sizes are counted before
    anything is paired: a block above the limit is skipped whole, as blocking defines it, so a
    key emits at most limit**2 / 2 pairs.

    No more than limit + 1 rows of a block leave a task, which is enough to know it as oversized, so
    vast blocks are neither exchanged nor sorted whole. Pairs are dealt by left uid: pairs of one
    fall together there, and its record can be joined where they are. ``rules``: names that the keys'
    rules are known to be among; they are then gathered as bits, which takes less memory than sets."""
    most = config.max_block_size
    place = F.row_number().over(Window.partitionBy("rule", "key").orderBy("uid"))
    few = keys.filter("rule is not null and key is not null").withColumn("place", place).filter(F.col("place") <= most + 1)
    blocks = few.groupBy("rule", "key").agg(F.count("*").alias("block_size"), F.array_sort(F.collect_list("uid")).alias("uids")).filter(F.col("block_size").between(2, most))
    left = blocks.select("rule", "uids", F.posexplode("uids").alias("at", "left_uid"))
    pairs = left.select("rule", "left_uid", F.explode(F.slice("uids", F.col("at") + 2, most)).alias("right_uid")).filter("left_uid < right_uid")
    pairs = _dealt(pairs, "left_uid").groupBy("left_uid", "right_uid")
    if rules is None:
        found = pairs.agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    else:
        names = sorted(rules)
        bit = F.raise_error(F.concat(F.lit("unknown rule "), "rule")).cast("long")
        for i, name in enumerate(names):
            bit = F.when(F.col("rule") == name, F.lit(1 << i).cast("long")).otherwise(bit)
        found = pairs.agg(F.bit_or(bit).alias("bits"))
        found = found.select("left_uid", "right_uid", F.array_compact(F.array(*[F.when(F.getbit("bits", F.lit(i)) == 1, F.lit(name)) for i, name in enumerate(names)])).alias("rules"))
    return found.withColumn("blocking_score", F.size("rules"))


def blocking_metrics(records: DataFrame, keys: DataFrame, pairs: DataFrame, entities: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """One row. ``entities``: uid, entity (null: none); records of one entity belong together. How many
    pairs that makes follows from the entities' sizes, and candidates are looked up by the entities
    of their two ends, so that the pairs that belong together are never written out."""
    n = records.agg(F.count("*").alias("records"))
    sizes = block_sizes(keys).agg(F.sum((F.col("block_size") > config.max_block_size).cast("long")).alias("oversized_blocks"))
    of = entities.filter("uid is not null and entity is not null").groupBy("entity", "uid").agg(F.count("*").alias("times"))
    true = of.groupBy("entity").agg(F.sum("times").alias("all"), F.sum(F.col("times") * F.col("times")).alias("own")).agg(F.coalesce(F.sum(F.expr("(all * all - own) div 2")), F.lit(0)).alias("true_pairs"))
    side = lambda s: of.select(F.col("uid").alias(f"{s}_uid"), "entity", F.col("times").alias(f"{s}_times"))
    met = pairs.select("left_uid", "right_uid").join(side("left"), "left_uid").join(side("right"), ["right_uid", "entity"])
    found = met.agg(F.coalesce(F.sum(F.col("left_times") * F.col("right_times")), F.lit(0)).alias("found_pairs"))
    count = pairs.agg(F.count("*").alias("candidate_pairs"), F.sum("blocking_score").alias("emitted"))
    row = n.join(sizes, F.lit(True)).join(true, F.lit(True)).join(found, F.lit(True)).join(count, F.lit(True))
    possible = F.expr("records * (records - 1) / 2")
    return row.select("records", "candidate_pairs", F.coalesce("oversized_blocks", F.lit(0)).alias("oversized_blocks"), safe_div(F.col("found_pairs"), F.col("true_pairs")).alias("pair_completeness"), (1 - safe_div(F.col("candidate_pairs"), possible)).alias("reduction_ratio"), safe_div(F.col("candidate_pairs"), F.col("records")).alias("candidates_per_record"), (1 - safe_div(F.col("candidate_pairs"), F.col("emitted"))).alias("duplicate_rate"))


def number_pairs(pairs: DataFrame) -> DataFrame:
    """pair_00000001 and on, in (left, right) order. Ranges are numbered on their own and offset by
    the counts of those before, so no task sorts all pairs."""
    from knitwork.session import cut_lineage

    ordered = cut_lineage(pairs.repartitionByRange("left_uid", "right_uid").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("part").orderBy("left_uid", "right_uid"))
    numbered = ordered.withColumn("at", at).join(F.broadcast(sizes.withColumn("before", before)), "part")
    return numbered.withColumn("pair_id", F.concat(F.lit("pair_"), F.lpad((F.col("before") + F.col("at")).cast("string"), 8, "0"))).drop("part", "at", "n", "before")

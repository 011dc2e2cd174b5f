"""Blocking on repeated and crowded records, and its plans."""

from pyspark.sql import functions as F

from knitwork.operators import blocking

SCHEMA = "uid string, brand string, model_number string, title string, category string, screen string, resolution string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_made_in_all_tasks(spark):
    rows = [("a", "x", "m100", "red lamp", "c", "5", ""), ("a", "x", "m100", "red lamp", "c", "5", ""), ("b", "x", "m100", "aaaaaaaa", "c", "", "7")]
    keys = blocking.blocking_keys(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    got = sorted(map(tuple, keys.collect()))
    assert len(got) == len(set(got)) and ("a", "rare_title_token", "lamp") in got and ("b", "character_signature", "aaa") in got
    # one task reads the table, but the rows are dealt before they are exploded into keys
    for part in plan(keys).split("Generate")[1:]:
        assert "REPARTITION_BY_NUM" in part


def test_pairs_of_crowded_blocks(spark):
    keys = [(f"u{i}", "brand_model", "k") for i in range(6)] + [(f"u{i}", "spec_signature", "s") for i in range(5)] + [(f"u{i}", "rare_model_token", "t") for i in range(3)] + [("u9", "rare_model_token", "alone"), (None, "brand_model", "n"), ("u1", "brand_model", "n")]
    keys = spark.createDataFrame(keys, "uid string, rule string, key string")
    want = {(f"u{i}", f"u{j}"): ("rare_model_token", "spec_signature") if j < 3 else ("spec_signature",) for i in range(5) for j in range(i + 1, 5)}
    for rules in (None, blocking.RULES):
        pairs = blocking.candidate_pairs(keys, blocking.BlockingConfig(max_block_size=5), rules)
        assert {(r.left_uid, r.right_uid): tuple(r.rules) for r in pairs.collect()} == want
        assert all(r.blocking_score == len(r.rules) for r in pairs.collect())
    # a crowded block is cut to one row beyond the limit before it is exchanged
    assert "WindowGroupLimit" in plan(pairs)


def test_metrics_count_pairs_of_an_entity_without_making_them(spark):
    # 40,000 records of one entity: 800 million pairs if they were made
    records = spark.range(40_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("uid"))
    keys = records.select("uid", F.lit("brand_model").alias("rule"), F.when(F.col("uid") < "000003", "k").otherwise(F.col("uid")).alias("key"))
    entities = records.select("uid", F.when(F.col("uid") != "000002", "e").alias("entity"))
    row = blocking.blocking_metrics(records, keys, blocking.candidate_pairs(keys), entities).first()
    assert (row.records, row.candidate_pairs, row.oversized_blocks) == (40_000, 3, 0)
    assert row.pair_completeness == 1 / (39_999 * 39_998 // 2)

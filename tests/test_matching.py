"""Pair features: plans and values of missing fields."""

from pyspark.sql import functions as F

from knitwork.functions import text as T
from knitwork.operators import matching
from knitwork.session import cut_lineage


def test_records_meet_their_pairs_without_a_broadcast(spark):
    rows = [("a", "s1", "Red lamp", "X", "m-100", "c", "10", ["k", "l"]), ("b", "s2", "red  LAMP", "x", "M100", "C", "5", ["k"]), ("c", "s1", None, None, None, None, None, None)]
    records = spark.createDataFrame(rows, "uid string, source_id string, title string, brand string, model_number string, category string, price string, spec_keys array<string>")
    pairs = spark.createDataFrame([("a", "b", ["r"]), ("a", "c", ["r", "q"])], "left_uid string, right_uid string, rules array<string>")
    features = matching.pair_features(pairs, cut_lineage(records), carry=("title",))
    assert "BroadcastExchange" not in features._jdf.queryExecution().executedPlan().toString()
    got = {r.right_uid: r for r in features.collect()}
    assert (got["b"].title_token_jaccard, got["b"].brand_exact, got["b"].model_exact, got["b"].price_relative_similarity, got["b"].spec_key_jaccard) == (1.0, 1.0, 1.0, 0.5, 0.5)
    assert (got["c"].title_token_jaccard, got["c"].brand_conflict, got["c"].spec_key_jaccard, got["c"].same_source, got["c"].blocking_rule_count) == (0.0, 0.0, 0.0, 1.0, 2.0)
    assert (got["b"].left_title, got["b"].right_title) == ("Red lamp", "red  LAMP")


def test_jaccard_of_sets_is_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], None), (["a", None], [None])], "a array<string>, b array<string>")
    rows = df.select(T.jaccard(F.col("a"), F.col("b")).alias("x"), T.jaccard_of_sets(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows]


def test_edges_of_constrained_clusters_are_made_once(spark):
    from knitwork.operators.clustering import constrained_clusters

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "left_uid string, right_uid string, match_probability double")
    records = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "uid string, source_id string").select("*", *[F.lit("").alias(c) for c in ("brand", "model_number", "screen", "resolution")])
    members, _ = constrained_clusters(records, edges.mapInPandas(count, edges.schema))
    assert {r.cluster_root for r in members.collect()} == {"a"}
    assert made.value == 2

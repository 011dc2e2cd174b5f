"""op1: held-out accuracy, planted words, and awkward rows."""

import random

from pyspark.sql import functions as F

from knitwork.llm.toxicity import Limits, drop_toxic, fit, score_documents, toxicity, train, trained_words

SF = "/root/testdata/sf0.01"


def test_scores_repeat(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first, again = ({r.doc_id: r.score for r in toxicity(docs, labels).collect()} for _ in range(2))
    assert len(first) == docs.count() and first == again
    assert all(0 <= x <= 1 for x in first.values())


def test_dictionaries_are_trained_on_text():
    """What zstandard's trainer keeps holds the words that repeat; stems are those of one class."""
    filler = random.Random(3)
    word = lambda: "".join(filler.choice("abcdefgh") for _ in range(7))
    toxic = [" ".join([word() for _ in range(60)] + ["nastyword", "plainword"]) for _ in range(60)]
    plain = [" ".join([word() for _ in range(60)] + ["plainword"]) for _ in range(60)]
    scorer = fit(toxic, plain)
    assert any("nastyword".startswith(s) for s in scorer.stems)
    assert [scorer.score(t) >= 0.5 for t in (toxic[0], plain[0])] == [True, False]
    assert {w for w in trained_words([t.split() for t in toxic], Limits()) if "nasty" in w}


def sample(spark):
    words = ["river", "stone", "cloud", "garden", "window", "paper", "bridge", "candle", "forest", "metal", "summer", "wagon"]
    r = random.Random(5)
    texts = [" ".join(r.choice(words) for _ in range(14 + i % 5)) for i in range(80)]
    rows = [(i, t + (f" nastyword{i % 7} foulmouth" if i % 2 else " pleasant day"), "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


def test_awkward_rows(spark):
    docs, labels = sample(spark)
    scorer = train(docs, labels)
    rows = [(900, None), (901, ""), (902, "a nastyword9 of foulmouth"), (902, "a nastyword9 of foulmouth"), (None, "river stone"), (904, "river " * 30_000 + " nastyword1 foulmouth nastyword3"), (905, "r" * 100_000)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), scorer).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] == by[None] < 0.5 <= by[902]
    assert by[904] > by[905]


def test_rejected_rows_go_and_clean_rows_stay(spark):
    docs, labels = sample(spark)
    docs = docs.withColumn("id", F.lit(0)).withColumn("label", F.lit(1)).withColumn("__id", F.lit(2))
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_without_labels(spark):
    docs, labels = sample(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity(docs, some, Limits()).collect()} == {0}
    assert toxicity(docs.limit(0), labels).count() == 0

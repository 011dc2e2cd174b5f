"""Each stage on its own input, against what its operator's brute force says."""

import os
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from knitwork.llm.toxicity import toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_near_texts import smallest  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        tables.append([r.asDict() for r in docs.collect()])
    toxic, exact, near, mixed, packed = tables
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = {r.doc_id: r.predicted for r in toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert {r["doc_id"] for r in toxic} == {i for i, p in verdicts.items() if p == 0}
    assert sum(r.toxic == 0 and verdicts[r.doc_id] == 1 for r in labels.collect()) <= 2
    missed = sum(r.toxic == 1 and verdicts[r.doc_id] == 0 for r in labels.collect())
    assert missed <= 3  # at most 2 is held as an expected failure in test_toxic_labels
    last = {}
    for r in toxic:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(last.values())
    stay = {r["doc_id"] for r in near}
    assert stay == smallest([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in mixed} == stay and len(mixed) <= 2 * len(near)
    assert {r["doc_id"] for r in packed} == stay
    pieces = [r for r in packed if r["piece"] == 0]
    assert len(pieces) == len(mixed)


CLASHES = ("bucket", "bitmap", "survives", "row", "row_", "gone", "mix_key", "mix_epoch", "mix_source", "id", "label", "text_row", "c0", "a.b", "length", "part")


def awkward(spark):
    """Nulls in every column, empty and repeated rows, and columns named as the stages name theirs."""
    rows = [(1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (None, None, None, None, None), (None, None, None, None, None), (4, "", "en", "b", 0), (5, "w " * 3_000, None, "a", 6), (6, "one two three four five six", "de", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(k))
    return docs


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        got = out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
        if k < 4:
            assert out.columns == docs.columns
            assert all(r["a.b"] == CLASHES.index("a.b") for r in got)
        # one row of a group: equal texts by the largest id, similar ones by the smallest; any id before none
        want = {0: [1, 1, 4, 5, 6, None, None], 1: [4, 5, 6], 2: [1, 4, 5], 3: None, 4: None}[k]
        if want is not None:
            assert sorted((r.doc_id for r in got), key=repr) == sorted(want, key=repr), corpus_pipeline.STAGES[k][0]
        else:
            assert {r.doc_id for r in got} == {1, 4, 5, 6, None}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

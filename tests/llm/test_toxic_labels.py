"""The pipeline's first stage, and the operator on held-out rows, against the labels themselves."""

import corpus_pipeline
import pytest

from knitwork.llm.toxicity import toxicity


def rates(rows):
    """recall, precision of (toxic, predicted)."""
    hit = sum(t and p for t, p in rows)
    return hit / sum(t for t, _ in rows), hit / sum(p for _, p in rows)


def tables(spark, sf):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def missed(spark):
    docs, labels = tables(spark, "sf0.01")
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    rows = [(r.toxic, int(r.doc_id not in kept)) for r in labels.collect()]
    assert rates(rows) > (0.9, 0.95)
    return sum(t > p for t, p in rows)


def test_labelled_toxic_rows_go(spark):
    assert missed(spark) <= 3


@pytest.mark.xfail(strict=True, reason="3 of 51 kept at sf0.01: one word or line over and over, without any word that marks other toxic rows")
def test_nearly_all_go(spark):
    assert missed(spark) <= 2


def test_held_out(spark):
    docs, labels = tables(spark, "sf0.1")
    rows = toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    recall, precision = rates([tuple(r) for r in rows])
    assert sum(r.toxic for r in rows) > 50 and recall >= 0.9 and precision >= 0.95

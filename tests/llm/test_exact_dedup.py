"""op5 against a dictionary of texts."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from knitwork.llm.exact_dedup import drop_exact_duplicates, duplicate_decisions

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small(spark):
    long = "word " * 20_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long + "x"), (7, long + "y"), (8, long), (8, long), (None, "a"), (None, "z"), (None, "z"), (9, "é"), (10, "e")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, keep_id int, bits string")
    assert sorted(map(tuple, duplicate_decisions(df, digest_all=True).collect()), key=repr) == brute(rows)
    sparse = {r.doc_id: r.text_sha256 for r in duplicate_decisions(df).collect()}
    assert sparse[9] is None and sparse[1] is not None
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 4, 6, 7, 8, None, 9, 10], key=repr)


def test_clashing_names(spark):
    rows = [(1, "a", 0, "x", {"k": 1}, 5), (2, "a", 1, "y", {"k": 2}, 6), (3, "b", 2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int, bitmap string, survives map<string,int>, `a.b` int").withColumn("SHA", F.lit(1)).withColumn("row", F.lit("r"))
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.bucket, r["a.b"]) for r in kept.collect()) == [(2, 1, 6), (3, 2, None)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert duplicate_decisions(df).count() == 0 and drop_exact_duplicates(df).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, duplicate_decisions(docs, digest_all=True).collect()), key=repr)
    assert got == brute(rows)
    assert drop_exact_duplicates(docs).count() == len({t or "" for _, t in rows})

"""op4: weights against closed forms and a plain bisection, quotas against what comes out."""

import math
from collections import Counter, defaultdict

import pytest

from knitwork.llm.mixing import mixed_documents, mixture, source_weights

SIZES = {"a": 4000, "b": 400, "c": 100, "d": 1}


def tokens(spark):
    return spark.createDataFrame(list(SIZES.items()), "source string, n_tokens long")


def alpha_of(spark, **k):
    return source_weights(tokens(spark), **({"max_repeats": None, "target_entropy": None, "budget": None} | k)).first().alpha


def weights(alpha):
    total = sum(SIZES.values())
    p = {s: (n / total) ** alpha for s, n in SIZES.items()}
    return {s: x / sum(p.values()) for s, x in p.items()}


def test_exponent(spark):
    # lossless: repeats of the smallest relative to the largest are (share ratio)**(1 - alpha)
    assert math.isclose(alpha_of(spark, max_repeats=2.0), 1 - math.log(2) / math.log(4000), abs_tol=2e-9)
    assert alpha_of(spark, max_repeats=1e9) == 0 and alpha_of(spark) == 1
    alpha = alpha_of(spark, target_entropy=1.0)
    assert math.isclose(-sum(w * math.log(w) for w in weights(alpha).values()), 1.0, abs_tol=1e-6)
    alpha = alpha_of(spark, max_repeats=3.0, budget=9000)
    assert math.isclose(max(weights(alpha)[s] * 9000 / n for s, n in SIZES.items()), 3.0, rel_tol=1e-6)


def documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), "big" if i % 10 else ("small" if i % 20 else "tiny"), 0) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")


@pytest.mark.parametrize("targets", [{"max_repeats": 2.0}, {"max_repeats": 3.0}, {"max_repeats": None, "target_entropy": 0.9}, {"max_repeats": 4.0, "budget": 6000}])
def test_realised(spark, targets):
    docs = documents(spark)
    rows = mixture(docs, **targets).collect()
    have, got, epochs = Counter(), Counter(), defaultdict(Counter)
    for r in docs.collect():
        have[r.source] += len(r.text.split())
    for r in rows:
        got[r.source] += r.n_tokens
        epochs[r.source][r.epoch] += r.n_tokens
    weight = {r.source: r.weight for r in rows}
    budget = targets.get("budget") or max(have[s] / weight[s] for s in have)
    for s in have:
        assert -0.5 <= got[s] - weight[s] * budget < 18  # the document at the quota comes whole
        *whole, last = [epochs[s][e] for e in sorted(epochs[s])]
        assert all(n == have[s] for n in whole)
        if targets.get("max_repeats"):
            assert len(epochs[s]) <= targets["max_repeats"]
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    if "budget" not in targets:
        assert {r.doc_id for r in rows if r.epoch == 0} == set(range(1000))
    out = mixed_documents(docs, **targets)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in rows)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "a b", None), (2, "a b", None), (None, "c", "x"), (3, "", "empty"), (4, "w " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture(df).collect()
    assert {(r.doc_id, r.source) for r in got} == {(1, "x"), (2, ""), (None, "x"), (3, "empty"), (4, "x")}
    assert Counter(r.doc_id for r in got if r.epoch == 0) == Counter([1, 2, 2, None, 3, 4])
    assert mixture(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0
    assert mixture(df.filter("source = 'empty'")).count() == 1


def test_many_sources(spark):
    """One pass a step: ten thousand sources of a hundred sizes."""
    rows = spark.range(10_000).selectExpr("cast(id as string) as source", "1 + id % 100 as n_tokens")
    got = source_weights(rows, 4.0, 8.0, None)
    assert got.count() == 10_000
    first = got.agg({"weight": "sum", "alpha": "max"}).first()
    assert math.isclose(first["sum(weight)"], 1.0, abs_tol=1e-9) and 0 < first["max(alpha)"] <= 1


def test_clashing_names(spark):
    docs = documents(spark).limit(50)
    for name in ("mix_source", "mix_key", "mix_epoch", "MIX_CUT", "whole", "key"):
        docs = docs.withColumn(name, docs.doc_id * 0 + 7)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.mix_key for r in out.collect()} == {7} and out.count() >= 50

"""op3: counts against a dictionary, the model against its own definition, gains on held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from knitwork.llm.class_ngrams import Shape, exchange, perplexity, score_documents

SF = "/root/testdata/sf0.001"
SMALL = Shape(table=50, top_items=16, groups=7, classes=4, sweeps=5)


def split(text):
    return (text or "").encode().lower().split()


def brute(rows):
    inside = [(i, t) for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    counts = Counter(w for _, t in inside for w in split(t))
    end = len(inside)
    n, v = sum(counts.values()) + end, len(counts) + (end > 0)
    out = {}
    for i, t in rows:
        words = split(t)
        c = [counts[w] for w in words] + [end]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


def check(spark, rows, shape):
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n long, word binary")
    got = score_documents(df, shape).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n_tokens, known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    return got


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One one ONE two"), (4, "É é zz"), (5, "w" * 50_000), (6, "a b " * 9_000), (7, "one two three"), (8, "unseen words only")]
    for shape in (SMALL, Shape()):
        check(spark, rows, shape)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(empty, SMALL).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = check(spark, [(alone, "a b")], SMALL)[0]
    assert got.train_tokens == 0 and got.base_score == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = score_documents(docs)
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], Shape())
    for r in perplexity(scored).collect():
        assert r.perplexity < r.base_perplexity


@pytest.mark.parametrize("shape", [SMALL, Shape(table=50, top_items=3, groups=5, classes=3, sweeps=5)])
def test_probabilities_sum_to_one(spark, shape):
    """All continuations of a text, by known words, an unseen word of each ending, and the end."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b a b", "c a d", "d d a", "a", "b c", "e", "f a b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    inside = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    known = sorted({w for t in inside for w in t.split()})
    from knitwork.llm.class_ngrams import score_texts, train

    model, vocabulary = train(df, shape, "doc_id", "text")
    # each class has one share for unseen words: sum over classes of transition x (known + one share)
    own = dict(zip([w.decode() for w in model.words], model.classes[: len(model.words)], strict=True))
    k = len(model.transition)
    for before in range(k):
        total = 0.0
        for c in range(k - 1):
            mass = sum(10 ** (model.counts[i] - model.emission[c]) for i, w in enumerate(model.words) if own[w.decode()] == c)
            total += 10 ** model.transition[before, c] * (mass + 10 ** -model.emission[c])
        total += 10 ** model.transition[before, k - 1]
        assert math.isclose(total, 1, rel_tol=1e-9)
    assert set(own) == set(known)
    assert score_texts(df, model, vocabulary, shape, "doc_id", "text").count() == len(rows)


def likelihood(table, own):
    k = own.max() + 1
    pairs = np.zeros((k, k))
    np.add.at(pairs, (own[:, None], own[None, :]), table)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))


def test_exchange_is_a_local_optimum():
    r = np.random.default_rng(3)
    table = r.poisson(3, (12, 12)).astype(float)
    own = exchange(table, 3, 50)
    best = likelihood(table, own)
    for w in range(11):
        for c in range(3):
            other = own.copy()
            other[w] = c
            assert likelihood(table, other) <= best + 1e-9


def test_words_beyond_the_items_are_exchanged_too(spark):
    """Two kinds of words that take turns, and endings that say nothing: every word finds its kind."""
    import random

    r = random.Random(4)
    kinds = [[f"a{r.randrange(10**6):06d}x" for _ in range(60)], [f"b{r.randrange(10**6):06d}x" for _ in range(60)]]
    texts = [" ".join(r.choice(kinds[i % 2]) for i in range(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from knitwork.llm.class_ngrams import train

    shape = Shape(table=200, top_items=40, groups=8, classes=2, sweeps=10)
    model, _ = train(df, shape, "doc_id", "text")
    of = [{int(c) for w, c in zip(model.words, model.classes, strict=False) if w[:1] == k} for k in (b"a", b"b")]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]
    better = score_documents(df, shape).agg({"score": "sum"}).first()[0]
    assert better > score_documents(df, Shape(table=40, top_items=40, groups=8, classes=2, sweeps=10)).agg({"score": "sum"}).first()[0]

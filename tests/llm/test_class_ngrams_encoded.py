"""Texts encoded once: every count is read from the indices, not from the words again."""

import numpy as np

from knitwork.llm.class_ngrams import Shape, count_bigrams, count_class_pairs, encode


def test_counts_of_encoded_texts(spark):
    texts = ["b a b", "", "a", "zzz a"] * 300
    shape = Shape(top_items=2, groups=2, classes=2)
    sent = spark.sparkContext.broadcast([b"a", b"b"])
    coded = encode(spark.createDataFrame([(t,) for t in texts], "text string"), sent, shape)
    items = np.array([0, 1, 2, 3])
    rows = [list(r["at"]) for r in coded.collect()]
    assert sorted(map(len, rows)) == sorted(len(t.split()) + 1 for t in texts) and all(r[-1] == -1 for r in rows)
    end, want = shape.items - 1, {}
    for r in rows:
        path = [end, *[int(items[i]) for i in r[:-1]], end]
        for x, y in zip(path, path[1:]):
            want[x * shape.items + y] = want.get(x * shape.items + y, 0) + 1
    assert {r.code: r.n for r in count_bigrams(coded, items, shape).collect()} == want
    assert count_class_pairs(coded, np.array([0, 1, 0, 1]), shape).sum() == sum(want.values())

"""op7 against all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from knitwork.llm.simhash import RADIUS, coordinates, fingerprint, forest, keep_one_of_each, links, near_duplicates, pivots
from knitwork.operators.components import connected_components

SF = "/root/testdata/sf0.01"


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints):
    """Smallest id of each row's component, over all pairs."""
    fps = np.array(sorted(set(prints.values())), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= RADIUS) + i + 1:
            parent[find(int(j))] = find(i)
    at = {int(f): find(i) for i, f in enumerate(fps)}
    least = {}
    for i, f in prints.items():
        least[at[f]] = min(least.get(at[f], i), i)
    return {i: least[at[f]] for i, f in prints.items()}


def test_fingerprint():
    r = random.Random(1)
    texts = ["", " \n", "One", "a b", "A b c", "É x\x85y é z", "w " * 5000] + [" ".join(r.choice("abcdefg") for _ in range(r.randrange(60))) for _ in range(50)]
    assert [fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = components(prints)
    got = near_duplicates(docs).collect()
    assert len(got) == len(prints)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id]
    kept = {r.doc_id for r in keep_one_of_each(docs).collect()}
    assert kept == set(want.values())


def test_rows(spark):
    rows = [(4, None), (2, ""), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (9, "A B c d e f g h"), (None, "zz yy xx"), (None, ""), (12, "x" * 50_000), (5, "other words altogether here")]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, fp int, key string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(4, 2), (2, 2), (7, 7), (7, 7), (9, 7), (None, None), (None, 2), (12, 12), (5, 5)], key=repr)
    assert keep_one_of_each(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [48, 512])
def test_crowded_keys_lose_no_link(spark, monkeypatch, tile):
    """Clusters around few centres: keys far above a tile, chains of links across tiles."""
    from knitwork.llm import simhash

    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(7)
    fps = set()
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(150):
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(200)}
    prints = dict(enumerate(sorted(fps)))
    signed = {i: int(np.uint64(f).astype(np.int64)) for i, f in prints.items()}
    found = dict(map(tuple, connected_components(links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"))).collect()))
    want, least = components(prints), {}
    for i, f in signed.items():
        least[found.get(f, f)] = min(least.get(found.get(f, f), i), i)
    assert {i: least[found.get(f, f)] for i, f in signed.items()} == want


def test_forest_spans():
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(5)]
    fps = np.array([b ^ (1 << r.randrange(8)) ^ (1 << r.randrange(8)) for b in base for _ in range(60)], np.uint64)
    edges = forest(fps, coordinates(fps, pivots()))
    assert len(edges) <= len(fps) - 1
    assert all(int(fps[a] ^ fps[b]).bit_count() <= RADIUS for a, b in edges)


def chain(spark):
    """Three texts whose fingerprints link only over the one in the middle."""
    r = random.Random(11)
    while True:
        words = [r.choice("abcdefghij") for _ in range(40)]
        texts = [" ".join(words)]
        for _ in range(2):
            words[r.randrange(40)] = r.choice("abcdefghij")
            texts.append(" ".join(words))
        a, b, c = (plain(t) for t in texts)
        if 0 < (a ^ b).bit_count() <= 3 and 0 < (b ^ c).bit_count() <= 3 < (a ^ c).bit_count():
            return texts


def test_bridges_without_an_id_and_repeated_ids(spark):
    a, b, c = chain(spark)
    rows = [(1, a), (None, b), (2, c), (9, a), (9, "some quite other words that link to nothing else here"), (10, "words of yet another kind entirely so to speak in full")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = lambda i, t: got[i, f"{plain(t):016x}"]
    assert of(1, a) == of(None, b) == of(2, c) == of(9, a) == 1
    assert of(9, rows[4][1]) == 9 and of(10, rows[5][1]) == 10


def test_hot_fingerprints(spark, monkeypatch):
    from knitwork.llm import simhash

    monkeypatch.setattr(simhash, "LEAST_HOT", 3)
    monkeypatch.setattr(simhash, "MOST_HOT", 20)
    rows = [(i, "the same words in all of these texts") for i in range(40, 90)] + [(i, f"text number {i} of its own " * 3) for i in range(10)] + [(None, None)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id and r.doc_id >= 40} == {40}
    assert {r.component_id for r in got if r.doc_id is None} == {None}


def test_clashing_names_and_repeated_rows(spark):
    rows = [(5, "a b c d e", 1, 2, 3), (5, "a b c d e", 1, 2, 4), (None, "q r s t", 0, 0, 0), (None, "q r s t", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, gone int, c0 int").withColumnRenamed("c0", "c.0")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q r s t"), (5, "a b c d e")]

"""The pipeline's near-dedup stage against the Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from knitwork.llm import near_texts
from knitwork.llm.exact_dedup import drop_exact_duplicates
from knitwork.llm.near_texts import keep_one_of_similar

SF = "/root/testdata/sf0.01"


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def smallest(rows):
    """Per component over all pairs, the smallest id."""
    found = {i: sets(t) for i, t in rows}
    parent = {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(found), 2):
        both = len(found[a] & found[b])
        if 5 * both >= 4 * (len(found[a]) + len(found[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {find(i) for i in found}


def test_stage_on_table(spark):
    docs = drop_exact_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    want = smallest([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and docs.count() - len(want) >= 5
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_chains_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "TILE", 16)
    r = random.Random(3)
    texts = []
    for _ in range(3):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            words = words[1:] + [f"w{r.randrange(5000)}"] if r.random() < 0.5 else words[:]
            words[r.randrange(120)] = f"w{r.randrange(5000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(r.sample(texts, len(texts))))
    got = keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in got) == sorted(smallest(rows))


def test_rows(spark):
    rows = [(4, None), (2, " "), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B c d e f"), (None, "zz yy"), (None, "zz yy"), (None, ""), (12, "x y"), (12, "other words")]
    df = spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, row int, key string")
    got = keep_one_of_similar(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(2, " "), (7, "a b c d e f"), (None, "zz yy"), (12, "x y"), (12, "other words")], key=repr)
    assert keep_one_of_similar(df.limit(0)).count() == 0


def brute_fingerprint(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def test_first_fingerprint_is_simhash():
    r = random.Random(5)
    for n in (1, 4, 254, 255, 256, 700):
        hashes = near_texts.shingles(" ".join(f"w{r.randrange(10**6)}" for _ in range(n + 4)))
        assert int(near_texts.fingerprints(near_texts.margins(hashes))[0]) == brute_fingerprint(hashes)


def test_least_similar_sets_share_keys():
    r = random.Random(6)
    for a, b, both in [(4, 5, 4), (8, 10, 8), (9, 9, 8), (18, 18, 16), (320, 400, 320)] * 20:
        drawn = near_texts.np.array([r.getrandbits(64) for _ in range(a + b - both)], "u8")
        x, y = near_texts.margins(drawn[:a]), near_texts.margins(drawn[a - both :])
        apart = sum(int(p ^ q).bit_count() for p, q in zip(*(near_texts.fingerprints(m[: near_texts.CHECKED]).tolist() for m in (x, y)), strict=True))
        assert set(near_texts.sure_keys(x, a).tolist()) & set(near_texts.sure_keys(y, b).tolist()) and apart <= near_texts.RADIUS


def test_stage_links_by_simhash(spark, monkeypatch):
    seen = []
    real = near_texts.simhash.links
    monkeypatch.setattr(near_texts.simhash, "links", lambda distinct: seen.append(distinct.columns) or real(distinct))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g "), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3] and seen


def family(n, words, changes, seed):
    """Copies of one text, each with a few words of its own."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = base[:]
        for _ in range(r.randrange(1, changes)):
            own[r.randrange(words)] = f"w{r.randrange(5000)}"
        yield " ".join(own)


def test_texts_of_a_large_family_are_gathered_few_times(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "TILE", 64)
    rows = list(enumerate([*family(300, 120, 6, 7), *family(60, 40, 8, 8), *family(40, 9, 3, 9)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gathered, real = [], type(docs).mapInArrow

    def counted(df, *args, **kwargs):
        if "key" in df.columns and "text" in df.columns:
            gathered.append(df.count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    got = keep_one_of_similar(docs)
    assert sorted(x.doc_id for x in got.collect()) == sorted(smallest(rows))
    assert 0 < sum(gathered) <= 8 * len(rows)


def test_rows_apart_in_a_crowded_group_meet(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "TILE", 4)
    rows = spark.createDataFrame([(k, r) for k in (1, 2) for r in range(40)], "key long, row long")
    for seed, chance in [(1, 0.0), (2, 0.5), (3, 0.9), (4, 1.0)]:
        r = random.Random(seed)
        part = [0 if r.random() < chance else i for i in range(40)]
        parts = spark.createDataFrame([(i, p) for i, p in enumerate(part) if p != i], "id long, component long")
        tiles = {}
        for x in near_texts.across(rows, parts).collect():
            tiles.setdefault(x.key, []).append(x.row)
        met = {p for t in tiles.values() for p in combinations(sorted(t), 2)}
        assert all((a, b) in met for a, b in combinations(range(40), 2) if part[a] != part[b])
        assert met or len(set(part)) == 1


def test_vast_components_go_by_key(spark, monkeypatch):
    rows = list(enumerate([*family(80, 120, 8, 10), *family(30, 30, 6, 11), *family(20, 8, 3, 12)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 40):
        monkeypatch.setattr(near_texts, "MOST", most)
        assert sorted(x.doc_id for x in keep_one_of_similar(docs).collect()) == sorted(smallest(rows))

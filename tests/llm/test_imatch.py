"""op9: edits and order against plain Python, likeness of near and of other documents."""

import hashlib
import random

from knitwork.llm.imatch import SEED, Band, fingerprint_with_edits, likeness, written

SF = "/root/testdata/sf0.01"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        out.append((i, n, hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(rows, got):
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute(rows)
    texts = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        texts.setdefault(r.doc_id, []).append(r.fingerprint)
    return texts


def test_edges(spark):
    rows = [(5, "é𝄞 a b c"), (1, None), (3, ""), (9, "x" * 60_000), (2, "same text here twice"), (4, "same text here twice"), (4, "same text here twice"), (None, "no id"), (7, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, following string, part int")
    prints = check(rows, fingerprint_with_edits(df).collect())
    assert prints[2] == prints[4][:1] and prints[1] == prints[3]
    one = fingerprint_with_edits(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprint_with_edits(df.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = fingerprint_with_edits(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    longer = [r for r in got if r.n_chars > 300]
    near, other = sum(r.near_edited for r in longer) / len(longer), sum(r.near_next for r in longer) / len(longer)
    assert near > 0.3 and other < 0.1
    assert sum(r.near_edited > r.near_next for r in longer) / len(longer) > 0.95


def plain_prints(texts, band):
    """The definition, word by word: sorted terms of each sub-lexicon, hashed together."""
    import math

    import xxhash

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = [{xxhash.xxh64_intdigest(w, SEED) for w in t.encode().lower().split()} for t in texts]
    df = {}
    for terms in words:
        for x in terms:
            df[x] = df.get(x, 0) + 1
    n = len(texts)
    lexicon = {x for x, c in df.items() if c >= 2 and band.low <= math.log(n / c) + 1e-12 and math.log(n / c) <= band.high + 1e-12}
    out = []
    for terms in words:
        known, parts = sorted(terms & lexicon), {}
        for mark, chosen, wanted in (("i", known, len(known) >= band.few), ("w", sorted(terms), len(known) < 2 * band.few)):
            if not wanted or not chosen:
                continue
            level = int(math.log2(len(chosen) / 0.75))
            for k in range(level, level + 3):
                cells = []
                for j in range(1, band.subsets + 1):
                    seed = mix(j * 0x9E3779B97F4A7C15 & mask)
                    inside = [x for x in chosen if k == 0 or mix(x ^ seed) >> (64 - k) == 0]
                    cells.append(max(xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in inside), SEED) >> 32, 1) if inside else 0)
                parts[f"{mark}{k}"] = b"".join(c.to_bytes(4, "little") for c in cells)
        out.append(parts)
    return out


def test_fingerprints_by_their_definition(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice((0, 3, 30, 200)))) for _ in range(60)]
    band = Band(low=0.5, high=3.0)
    got = {x.doc_id: x for x in fingerprint_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), band).collect()}
    want = plain_prints(texts, band)
    assert {k[0] for p in want for k in p} == {"i", "w"}
    for i, parts in enumerate(want):
        assert got[i].fingerprint == written(parts)
        assert got[i].near_next == likeness(parts, want[(i + 1) % len(want)])

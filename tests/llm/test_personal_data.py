"""op6 against Python's own regular expressions, on awkward texts and on the smallest table."""

import hashlib
import random
import re

import pytest

from knitwork.llm.personal_data import find_personal_data, personal_data_digest

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    d = [int(c) for c in text if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


VALID = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": luhn,
    "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15,
}


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if VALID[k](m.group(0))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, __text string")
    got = {r.doc_id: r for r in personal_data_digest(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (text, base, got[i].spans)
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(x.startswith(kind + ":") for x in base)
        assert set(base) <= set(got[i].spans.split(",")) or not base
    return got


def test_awkward_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x..y@z.co.uk. next@a.b-", "é𝄞 mail q@w.er 𝄞", "1.2.3.4.5.6.7.8", "256.1.1.1 010.020.030.040 1.2.3",
        "4539 1488 0343 6467 and 4539148803436467x", "4539148803436468", "+1 (555) 555-0100 +49 30 1234 5678 9012 345", "+1 . ( - 2", "@@a@b@c.d",
        "a" * 20_000, "9" * 5_000, "a.b" * 4_000 + "@x.y", "a@b" + ".c" * 6_000, "+1" + " " * 5_000, "GB82 WEST 1234 5698 7654 32 iban", "DE89370400440532013000", "DE89370400440532013001",
        "ssn 123-45-6789", "123-45-6789", "1 2-3 4 5-6",
    ]
    got = check(spark, [(i, t, "x", "y") for i, t in enumerate(texts)])
    assert got[17].n_iban == 1 and got[18].n_iban == 1 and got[19].n_iban == 0
    assert got[20].n_ssn == 1 and got[21].n_ssn == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    alphabet = ["a", "B", "1", "23", "255", "4539148803436467", ".", "@", "-", "+", " ", "(", ")", "%", "é", "\n", "1.2.3.4", "+1 "]
    check(spark, [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(40))), "", "") for i in range(400)])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = personal_data_digest(docs).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row.base_sha256 == hashlib.sha256(",".join(brute(texts[row.doc_id])).encode()).hexdigest()


def test_context_raises_the_score(spark):
    rows = [(1, "card 4539148803436467"), (2, "x 4539148803436467"), (None, "x 4539148803436467")]
    got = {r.doc_id: r.card[0].score for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > got[2] == got[None]


def test_empty_table(spark):
    assert personal_data_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_spans(spark):
    """Time in proportion to the spans: a hundred thousand of them in seconds."""
    import time

    text = " ".join(f"u{i}@x.io" for i in range(100_000))
    began = time.time()
    row = personal_data_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_email == 100_000 and row.base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert time.time() - began < 60


def test_secrets_need_context(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{key}" and more', f"commit {key} of the day", f"api_key: {key[:20]}", f"the secret {'a' * 40} here", f"password {key}-x_{key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data_digest(df).collect()}
    assert [got[i].n_secret for i in range(5)] == [1, 0, 0, 0, 1] and got[0].spans == "secret:9:49" and got[0].n_spans == 1

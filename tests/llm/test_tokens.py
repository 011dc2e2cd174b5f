"""op2 and op10: ids against the library, exact round trips, packings against their rules."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from knitwork.llm.packing import pack_best_fit, plan_best_fit
from knitwork.llm.token_store import Segment, from_planes, pack_segment, read_tokens, to_planes, token_round_trip, write_tokens
from knitwork.llm.tokens import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(tokenizer_path())
ENCODER = WordEncoder(tokenizer_path(), limit=40)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own(text):
    return np.frombuffer(ENCODER.encode_one(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aB1 .,'sdmlvret_-!\n\t<|>éßİΣ́ ‍²")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_are_the_library_s(text):
    assert own(text) == library(text)


@pytest.mark.parametrize("text", ["it's 'S we'd o'''s ... !!'re x_y__z '' 'd.", "<|endoftext|> a<|startoftext|>b", "don't ***'ll 's's", "A" * 3000, "a.b.C.,d,", "'.", "Ö. É, ÿ"])
def test_awkward_ids(text):
    assert own(text) == library(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]), st.integers(1, 70))
def test_segments_round_trip(ids, planes, block):
    ids = np.array(ids, "<u4")
    if len(ids):
        assert (from_planes(to_planes(ids, planes), len(ids), planes) == ids).all()
    cut = len(ids) // 3
    segment = Segment(pack_segment([None, -5, 2**62], [cut, 0, len(ids) - cut], ids, block, planes, 1))
    assert segment.doc_ids == [None, -5, 2**62] and segment.lengths.tolist() == [cut, 0, len(ids) - cut]
    assert (segment.ids() == ids).all()
    if len(ids) > block:
        assert (segment.block(1) == ids[block : 2 * block]).all()


def expected(rows, end):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library(t), end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


EDGE = [(3, "b"), (1, None), (2, ""), (9, "word " * 30_000), (9, "word"), (9, "word"), (None, "no id"), (-4, "é ß"), (5, "x" * 3_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in EDGE], "doc_id long, text string, start int, shard string")
    assert sorted(map(tuple, token_round_trip(df, tokenizer_path()).collect()), key=repr) == expected(EDGE, 2)
    path = f"{tmp_path}/small"
    write_tokens(df, path, tokenizer_path(), segment_ids=50, block_ids=16, planes="bit")
    back = read_tokens(spark, path).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back), key=repr) == expected(EDGE, 2)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in back)
    assert token_round_trip(df.limit(0), tokenizer_path()).count() == 0


def test_round_trip_of_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, token_round_trip(docs, tokenizer_path()).collect()), key=repr) == expected(rows, 2)


def check_packing(rows, got, capacity, end=0):
    want = []
    for i, t in rows:
        ids = np.array([*library(t), end], "<u4")
        want += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


def test_packing(spark):
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in EDGE], "doc_id long, text string, length int, piece string")
    check_packing(EDGE, pack_best_fit(df, tokenizer_path()).collect(), 2048)
    check_packing(EDGE, pack_best_fit(df, tokenizer_path(), capacity=7).collect(), 7)
    assert pack_best_fit(df.limit(0), tokenizer_path()).count() == 0


def test_packing_of_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, total = check_packing([(r.doc_id, r.text) for r in docs.collect()], pack_best_fit(docs, tokenizer_path()).collect(), 2048)
    assert n <= -(-total // 2048) * 1.01 + 1


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_best_fit_on_documents(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64])
    counts = {n: r.randrange(1, 40) for n in r.sample(range(1, capacity), r.randrange(1, capacity - 1))}
    slots, sequences = plan_best_fit(counts, capacity)
    used, ranks = {}, {}
    for length, first, number, sequence, offset in slots:
        for i in range(number):
            ranks.setdefault(length, set()).add(first + i)
            used.setdefault(sequence + i, []).append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == counts
    assert all(max(v) == counts[k] - 1 for k, v in ranks.items())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    spaces, best = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [s for s in spaces if s >= length]
            if fits:
                spaces.remove(min(fits))
                spaces.append(min(fits) - length)
            else:
                spaces.append(capacity - length)
    assert sequences == len(used) == len(spaces) + best

"""Brown class-based bigrams: exchange clustering, class transitions, word emissions.

log P(text) = sum over tokens of log P(class | previous class) + log P(word | class).

Exchange moves one word at a time to the class that most raises the likelihood of all training
bigrams. It runs in two steps. First over *items*: the ``top_items`` most frequent words, and all other
words in ``groups`` by their ending, on the item-by-item table of counts, with as many sweeps as it
takes. Then every other word of the table of frequent words, up to ``table`` of them, is exchanged
out of its group's class on its own: its neighbours are counted by class over all training texts, and
the step that finds its class is spread over the words. Words beyond the table, and unseen ones, keep
their group's class. Class bigrams are then counted once more, with the classes as they ended up.

Everything is counted over every training text. The vocabulary itself stays distributed: a scored text
asks for the counts of its rare words by a join on the word; only the counts and classes of the table's
words travel to the workers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import cut_lineage, give_back, held_out, scratch_path, whole_text, words_of
from knitwork.llm.tokens import BoundedCache

FOLDS, TEST_FOLD = 7, 2


@dataclass(frozen=True)
class Shape:
    """table: most frequent words whose counts the workers hold (of at most ``table_bytes`` bytes
    each); top_items + groups + 1 items are clustered together into classes + 1, the last for the
    end, the table's other words one by one."""

    table: int = 65_536
    table_bytes: int = 48
    top_items: int = 512
    groups: int = 255
    classes: int = 40
    sweeps: int = 12

    @property
    def items(self) -> int:
        return self.top_items + self.groups + 1


class Index:
    """Words to indices: below ``table`` the place of a frequent word, above it a group."""

    def __init__(self, words: list[bytes], shape: Shape):
        self.size = len(words)
        place = {w: i for i, w in enumerate(words)}
        groups, size = shape.groups, self.size
        self.items = np.array([i if i < shape.top_items else shape.top_items + zlib.crc32(w[-3:]) % groups for i, w in enumerate(words)] + [shape.top_items + g for g in range(groups)], np.int64)
        self._cache = BoundedCache(lambda w: p if (p := place.get(w)) is not None else size + zlib.crc32(w[-3:]) % groups, 250_000)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._cache.__getitem__, words), np.int64, len(words))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows: summed in each task first, flushed at a bounded size."""

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(words_of(text))
                if len(total) > 400_000:
                    yield flush()
        if total:
            yield flush()

    return texts.mapInArrow(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(texts: DataFrame, sent, shape: Shape) -> DataFrame:
    """The texts as indices, each with -1 for its end: written once, so that the words are looked up
    once for all counts that follow."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(sent.value, shape)
        for batch in batches:
            for at in range(0, len(batch), 500):
                found = [np.append(index(words_of(t)), -1) for t in batch.column(0).slice(at, 500).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))], ["at"])
        give_back()

    return cut_lineage(texts.mapInArrow(rows, "at array<int>"))


def runs(batches: Iterator) -> Iterator:
    """Indices of some texts on end, an end before the first: each text lies between two ends."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            yield np.r_[-1, batch.column(0).slice(at, 500).flatten().to_numpy()]


def count_bigrams(coded: DataFrame, items: np.ndarray, shape: Shape) -> DataFrame:
    """(code, n): code = item of the token before x items + item of the token."""
    m = shape.items
    of = np.r_[items, m - 1]

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(m * m, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if waiting:
                np.add(table, np.bincount(np.concatenate(waiting), minlength=m * m), out=table)
            waiting.clear()
            size = 0

        for run in runs(batches):
            own = of[run]
            waiting.append(own[:-1] * m + own[1:])
            size += len(run)
            if size > 1_000_000:
                settle()
        settle()
        found = np.flatnonzero(table)
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["code", "n"])

    return coded.mapInArrow(counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def take_out(pairs: np.ndarray, c: int, out: np.ndarray, into: np.ndarray, self_: float) -> np.ndarray:
    """Takes a word out of class c of ``pairs``, and what each class would gain by it. out and into: its
    neighbours after and before it by class, with the word itself; it is taken out of them too."""
    out[c] -= self_
    into[c] -= self_
    pairs[c] -= out
    pairs[:, c] -= into
    pairs[c, c] -= self_
    # the word's neighbours keep their own class wherever it goes
    left, right = pairs.sum(axis=1) + into, pairs.sum(axis=0) + out
    gain = (_xlogx(pairs + out) - _xlogx(pairs)).sum(axis=1) + (_xlogx(pairs + into[:, None]) - _xlogx(pairs)).sum(axis=0)
    d = np.diag(pairs)
    # on the diagonal both sums and the word's own pairs meet in one cell
    gain += _xlogx(d + out + into + self_) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    to, fro = out.sum() + self_, into.sum() + self_
    return gain - (_xlogx(left + to) - _xlogx(left) + _xlogx(right + fro) - _xlogx(right))


def exchange(table: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each item. The last item (the end) keeps a class of its own. Items start dealt out by
    frequency; each sweep takes every item out of its class and puts it where the bigram
    likelihood, sum of n(c,d) log n(c,d) less n(c) log n(c) on either side, is highest."""
    m = len(table)
    weight = table.sum(axis=1)
    order = np.argsort(-weight[: m - 1], kind="stable")
    own = np.zeros(m, np.int64)
    own[order] = np.arange(m - 1) % classes
    own[m - 1] = classes
    k = classes + 1
    one = np.eye(k)[own]
    pairs = one.T @ table @ one
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not weight[w]:
                continue
            out = np.bincount(own, table[w], k)
            into = np.bincount(own, table[:, w], k)
            self_ = table[w, w]
            c = own[w]
            gain = take_out(pairs, c, out, into, self_)
            best = int(np.argmax(gain[:classes]))
            moved += best != c
            own[w] = best
            pairs[best] += out
            pairs[:, best] += into
            pairs[best, best] += self_
        if not moved:
            break
    return own


@dataclass
class ClassModel:
    """classes: of each word of the table, then of each group."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    n: int
    v: int
    n_end: int


def count_neighbours(coded: DataFrame, words: int, classes: np.ndarray, shape: Shape) -> DataFrame:
    """(word, at, n) of the table's words from ``top_items`` on: at < k the class after it, then k + the
    class before it, then 2 k: itself right after itself."""
    k = shape.classes + 1

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        top, width = shape.top_items, 2 * k + 1
        of = np.r_[classes, k - 1]
        table = np.zeros((words - top) * width, np.int32)
        for run in runs(batches):
            own = of[run]
            rare = np.flatnonzero((run >= top) & (run < words))
            base = (run[rare].astype(np.int64) - top) * width
            np.add.at(table, base + own[rare + 1], 1)
            np.add.at(table, base + k + own[rare - 1], 1)
            np.add.at(table, base[run[rare + 1] == run[rare]] + 2 * k, 1)
        found = np.flatnonzero(table)
        for a in range(0, len(found), 50_000):
            part = found[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // width + top), pa.array(part % width), pa.array(table[part].astype(np.int64))], ["word", "at", "n"])
        del table
        give_back()

    return coded.mapInArrow(counts, "word long, at long, n long").groupBy("word", "at").agg(F.sum("n").alias("n"))


def exchange_each(neighbours: DataFrame, pairs: np.ndarray, classes: np.ndarray, shape: Shape) -> DataFrame:
    """(word, class): where each word goes when it alone is moved. A word has at most 2 k + 1 rows."""
    k = shape.classes + 1

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for word, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.zeros(2 * k + 1)
                for cell in cells:
                    row[cell["at"]] = cell["n"]
                gain = take_out(pairs.copy(), int(classes[word]), row[:k].copy(), row[k : 2 * k].copy(), row[2 * k])
                found.append(int(np.argmax(gain[: k - 1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["word", "class"])

    gathered = neighbours.groupBy("word").agg(F.collect_list(F.struct("at", "n")).alias("cells"))
    return gathered.mapInArrow(best, "word long, class long")


def count_class_pairs(coded: DataFrame, classes: np.ndarray, shape: Shape) -> np.ndarray:
    k = shape.classes + 1

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, table = np.r_[classes, k - 1], np.zeros(k * k, np.int64)
        for run in runs(batches):
            own = of[run]
            table += np.bincount(own[:-1] * k + own[1:], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(table)], ["code", "n"])
        give_back()

    out = np.zeros(k * k)
    for r in coded.mapInArrow(counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # k x k rows
        out[r.code] = r.n
    return out.reshape(k, k)


def model_of(top: list[tuple[bytes, int]], classes: np.ndarray, pairs: np.ndarray, distinct: np.ndarray, n: int, v: int, n_end: int) -> ClassModel:
    """distinct: known words of each class. Transitions are interpolated with class frequencies; each
    class keeps one count's share for words unseen in training, so emissions sum to one."""
    k = len(pairs)
    into = pairs.sum(axis=0)
    prior = (into + 1) / (into.sum() + k)
    transition = np.log10((pairs + k * prior) / (pairs.sum(axis=1, keepdims=True) + k))
    emission = np.log10(into + distinct + 1)
    return ClassModel([w for w, _ in top], np.log10(np.array([c for _, c in top], float) + 1), classes, transition, emission, n, v, n_end)


def most_frequent(vocabulary: DataFrame, shape: Shape) -> list[tuple[bytes, int]]:
    """The words above the least count that at most ``table`` words reach, found on a histogram of
    counts in steps of a 32nd of an octave, so that no task sends more than goes into the table."""
    short = vocabulary.filter(F.octet_length("word") <= shape.table_bytes).withColumn("step", F.floor(F.log2("n") * 32))
    room, cut = shape.table, None
    for step, words in sorted(map(tuple, short.groupBy("step").agg(F.count("*")).collect()), reverse=True):
        room -= words
        if room < 0:
            break
        cut = step
    if cut is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in short.filter(F.col("step") >= cut).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))


def train(docs: DataFrame, shape: Shape, id_col: str, text_col: str) -> tuple[ClassModel, DataFrame]:
    """The model and the vocabulary (word, n), which stays a table in the shared folder."""
    spark = docs.sparkSession
    texts = docs.filter(~held_out(id_col, FOLDS, TEST_FOLD)).select(whole_text(text_col).alias("text"))
    path = scratch_path(spark, "vocabulary")
    count_words(texts).write.parquet(path)
    vocabulary = spark.read.schema("word binary, n long").parquet(path)
    n_end = texts.count()
    top = most_frequent(vocabulary, shape)
    sent = spark.sparkContext.broadcast([w for w, _ in top])
    index = Index(sent.value, shape)
    coded = encode(texts, sent, shape)
    m = shape.items
    table = np.zeros(m * m, np.int64)
    for r in count_bigrams(coded, index.items, shape).collect():  # at most items x items rows
        table[r.code] = r.n
    own = exchange(table.reshape(m, m).astype(float), shape.classes, shape.sweeps)
    classes = own[index.items]
    k, one = shape.classes + 1, np.eye(shape.classes + 1)[own]
    pairs = one.T @ table.reshape(m, m) @ one
    group_classes = classes[index.size :].copy()
    if index.size > shape.top_items:
        neighbours = cut_lineage(count_neighbours(coded, index.size, classes, shape))
        moved = exchange_each(neighbours, pairs, classes, shape).toArrow()  # a row for each word of the table
        classes[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
        pairs = count_class_pairs(coded, classes, shape)
    group = F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")), F.lit(shape.groups))
    rows = vocabulary.groupBy(group.alias("g")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    known = np.zeros(shape.groups)
    for r in rows:
        known[r.g] = r.v
    for w, _ in top:  # the table's words have classes of their own
        known[zlib.crc32(w[-3:]) % shape.groups] -= 1
    distinct = np.bincount(group_classes, known, k) + np.bincount(classes[: index.size], minlength=k)
    n, v = sum(r.n for r in rows) + n_end, sum(r.v for r in rows) + (n_end > 0)
    return model_of(top, classes, pairs, distinct, n, v, n_end), vocabulary


def score_texts(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, shape: Shape, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        own = sent.value
        index = Index(own.words, shape)
        counts = np.r_[own.counts, np.zeros(shape.groups)]
        classes, end = own.classes, shape.classes
        base, serial = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            found: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                at = index(words)
                path = np.full(len(words) + 2, end, np.int64)
                path[1:-1] = classes[at]
                frequent = at < index.size
                rare = Counter(words[i] for i in np.flatnonzero(~frequent).tolist())
                structure = own.transition[path[:-1], path[1:]].sum() - own.emission[path[1:-1]].sum()
                found.append((base + serial, doc, len(words) + 1, int(frequent.sum()) + (own.n_end > 0), float(structure), float(counts[at].sum()), list(rare), list(rare.values())))
                serial += 1
                if len(found) >= 1000:
                    yield to_batch(pa, found)
                    found = []
            if found:
                yield to_batch(pa, found)

    def to_batch(pa, found):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        names = ["row", "doc_id", "n_tokens", "known", "structure", "counted", "words", "times"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    path = scratch_path(spark, "scored")
    schema = "row long, doc_id long, n_tokens long, known long, structure double, counted double, words array<binary>, times array<long>"
    docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(rows, schema).write.parquet(path)
    local = spark.read.schema(schema).parquet(path)
    asked = local.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    answered = asked.join(vocabulary, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_counted"), F.sum("times").alias("more_known"))
    joined = local.drop("words", "times").join(answered, "row", "left")
    counted = F.col("counted") + F.coalesce("more_counted", F.lit(0.0))
    n, v = model.n, model.v
    end_count = float(np.log10(model.n_end + 1))
    return joined.select(
        "doc_id",
        held_out("doc_id", FOLDS, TEST_FOLD).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (counted + F.lit(end_count) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("structure") + counted).alias("score"),
    )


def score_documents(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. A null or empty text is its end alone; null ids (of the fold their empty
    text falls in) and repeated rows are rows like any other; without training texts every
    count is zero; an empty table gives no rows; other columns are ignored."""
    model, vocabulary = train(docs, shape, id_col, text_col)
    return score_texts(docs, model, vocabulary, shape, id_col, text_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold: perplexity of the class model and of the unigram base."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))

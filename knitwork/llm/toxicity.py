"""Toxicity by compression distance.

zstandard trains two dictionaries, one on windows of toxic and one on windows of ordinary text. Every
window of a text is compressed with either: where the toxic dictionary makes it shorter by a calibrated
threshold, the window counts as toxic. A text's score is a logistic function of how many windows do
and of the bytes they save, fitted on the training rows.

Used as they are the two dictionaries tell little: a match costs the compressor several bytes, more
than a short insult saves, and most of what they hold is in both classes. So each is reduced to the
*stems* (beginnings of words in its content) that its class has far more often than chance, with a
further part that both share, and both the dictionaries and the windows are written in codes: eight
bytes for a word that begins with a stem, two for any other. A match is then worth a whole stem or
nothing, and what is compared is still the compressor's output.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from knitwork.llm.common import give_back, held_out, own_columns, whole_text
from knitwork.llm.tokens import BoundedCache

FOLDS, TEST_FOLD = 5, 0
#: Frames every window: the compressor starts no match in the last bytes, and stores a block that
#: it can hardly shorten, which would hide a lone match.
TAIL = bytes(48)
#: Bytes saved from which a window may count as toxic; calibration picks one.
THRESHOLDS = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0)


@dataclass(frozen=True)
class Limits:
    """per_class: labelled rows of each class that are learnt from, chosen by a hash of their id;
    sample_bytes: longer texts are not learnt from (they are scored like any other). Together they
    bound what the driver holds."""

    per_class: int = 1_500
    sample_bytes: int = 16_384
    #: bytes of each trained dictionary; characters of a training window
    trained_bytes: int = 65_536
    window_chars: int = 80
    least_stem: int = 4
    most_stem: int = 10
    #: uses of a stem in one text that count; texts that must have it; ln of the ratio of rates
    per_text: int = 5
    min_docs: int = 3
    log_odds: float = 2.0
    window_words: int = 24
    shared: int = 256


_WORD = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def _distinct(texts: list[str]) -> list[list[str]]:
    """The words of each text. Near copies count once: a copy's own words would look like marks of
    its class."""
    seen: set = set()
    out = []
    for text in texts:
        words = letters_of(text)
        shingles = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
        sketch = [(k, min(xxh64_intdigest(s, k) for s in shingles)) for k in range(6)]
        if sum(x in seen for x in sketch) < 2:
            seen.update(sketch)
            out.append(words)
    return out


def trained_words(texts: list[list[str]], limits: Limits) -> set[str]:
    """The words, whole or cut, in the dictionary that zstandard trains on windows of the texts.
    Where there is too little text for its trainer the text itself is the dictionary."""
    import zstandard

    windows = []
    for words in texts:
        joined = " ".join(words)
        windows += [f" {joined[i : i + limits.window_chars]} ".encode() for i in range(0, len(joined), limits.window_chars)]
    windows = [w for w in windows if len(w) >= 8]
    try:
        content = zstandard.train_dictionary(limits.trained_bytes, windows, k=16, d=6, steps=1).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(windows)[-limits.trained_bytes :]
    return {w.decode(errors="ignore") for w in content.split(b" ")}


def _stems(words: list[str], limits: Limits) -> Counter:
    """Beginnings of the words, each counted up to ``per_text`` times."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for k in range(limits.least_stem, min(len(w), limits.most_stem) + 1):
            out[w[:k]] += n
    return Counter({s: min(n, limits.per_text) for s, n in out.items()})


def telling_stems(words: set[str], own: Counter, other: Counter, docs: Counter, limits: Limits) -> list[str]:
    """Stems of a dictionary's words that its class uses more than chance explains, for all of them
    together. Of nested ones the one with the most evidence stays."""
    n, m = sum(own.values()), sum(other.values())
    share = n / max(n + m, 1)
    candidates = {w[:k] for w in words for k in range(limits.least_stem, min(len(w), limits.most_stem) + 1)}
    candidates = {s for s in candidates if docs[s] >= limits.min_docs}
    chance = math.log(max(len(candidates), 1)) + 1
    evidence = {}
    for s in candidates:
        a, b = own[s], other[s]
        p = a / (a + b)
        nats = a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0) if p > share else 0
        if nats >= chance and math.log((a + 0.5) / n / ((b + 0.5) / max(m, 1))) >= limits.log_odds:
            evidence[s] = nats
    out: list[str] = []
    for s in sorted(evidence, key=lambda s: (-evidence[s], -len(s), s)):
        if not any(s.startswith(x) or x.startswith(s) for x in out):
            out.append(s)
    return out


def _code(stem: str) -> bytes:
    return xxh64_digest(stem.encode(), 7)


class Scorer:
    """Dictionaries, threshold and weights; plain values, so that it can be sent to executors."""

    def __init__(self, toxic: list[str], ordinary: list[str], shared: list[str], limits: Limits):
        self.limits = limits
        self.stems = frozenset([*toxic, *ordinary, *shared])
        base = b"".join(map(_code, shared))
        size = 8 * max(len(toxic), len(ordinary))
        # the same length, so that offsets to the shared part cost the same
        filler = b"".join(xxh64_digest(str(i).encode(), 11) for i in range(size // 8))
        parts = [b"".join(map(_code, x)) for x in (toxic, ordinary)]
        # the compressor finds no match that begins in a dictionary's last bytes
        end = b"".join(xxh64_digest(bytes([i]), 13) for i in range(2))
        self.dictionaries = [base + filler[: size - len(p)] + p + end for p in parts]
        self.threshold, self.weights = 4.0, np.array([-3.0, 1.0, 1.0, 1.0])
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            import zstandard as z

            made = []
            for content in self.dictionaries:
                d = z.ZstdCompressionDict(content or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
                p = z.ZstdCompressionParameters.from_level(5, window_log=14, hash_log=12, chain_log=12, search_log=4, strategy=z.STRATEGY_GREEDY, min_match=6, write_content_size=0, write_checksum=0, write_dict_id=0)
                d.precompute_compress(compression_params=p)
                made.append(z.ZstdCompressor(dict_data=d, compression_params=p))
            stems, shortest, longest = self.stems, self.limits.least_stem, self.limits.most_stem

            def write(word: str) -> bytes:
                for n in range(min(len(word), longest), shortest - 1, -1):
                    if word[:n] in stems:
                        return _code(word[:n])
                return xxh64_digest(word.encode(), 3)[:2]

            self._ready = (*made, BoundedCache(write, 80_000))
        return self._ready

    def differences(self, words: list[str]) -> np.ndarray:
        """Per window: bytes with the ordinary dictionary less bytes with the toxic one."""
        toxic, ordinary, codes = self._compressors()
        step = self.limits.window_words
        written = list(map(codes.__getitem__, words))
        windows = [TAIL[:16] + b"".join(written[i : i + step]) + TAIL for i in range(0, len(written), step)]
        return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows], float)

    def features(self, differences: np.ndarray) -> np.ndarray:
        over = differences >= self.threshold
        n = max(len(differences), 1)
        return np.array([1.0, math.log1p(over.sum()), math.sqrt(over.sum() / n), math.log1p(differences[over].sum() / n)])

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.features(self.differences(letters_of(text))) @ self.weights)))))

    def calibrate(self, toxic: list[list[str]], ordinary: list[list[str]]) -> None:
        """The threshold and weights with the least logistic loss on the training rows; each class
        weighs as much as it has rows, and the weights are ridge-penalised (Newton's method)."""
        if not toxic or not ordinary:
            return
        windows = [self.differences(t) for t in [*toxic, *ordinary]]
        y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
        least = math.inf
        for threshold in THRESHOLDS:
            tried, self.threshold = self.threshold, threshold
            x = np.array([self.features(d) for d in windows]).reshape(len(y), 4)
            w = np.zeros(4)
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(4), x.T @ (y - p) - 0.05 * w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
            loss = -float(y @ np.log(p) + (1 - y) @ np.log(1 - p))
            if loss < least:
                least, self.weights = loss, w
            else:
                self.threshold = tried


def fit(toxic: list[str], ordinary: list[str], limits: Limits = Limits()) -> Scorer:
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    counted = []
    for texts in (toxic, ordinary):
        uses, docs = Counter(), Counter()
        for words in texts:
            stems = _stems(words, limits)
            uses.update(stems)
            docs.update(stems.keys())
        counted.append((uses, docs))
    (ct, dt), (co, do) = counted
    own = telling_stems(trained_words(toxic, limits), ct, co, dt, limits)
    other = telling_stems(trained_words(ordinary, limits), co, ct, do, limits)
    # what both classes share: frequent stems that tell nothing
    both = [s for s, _ in (dt + do).most_common(20 * limits.shared) if not any(s.startswith(x) or x.startswith(s) for x in [*own, *other])][: limits.shared]
    scorer = Scorer(own, other, both, limits)
    scorer.calibrate(toxic, ordinary)
    return scorer


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Learns from labelled rows outside the test fold only. Null labels are left out. With rows of
    one class, or none, every score is that of a text without evidence."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col, FOLDS, TEST_FOLD)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    sample = usable.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(limits.per_class).union(usable.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(limits.per_class))
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).filter(F.octet_length("text").between(1, limits.sample_bytes))
    # at most 2 x per_class narrow rows are broadcast
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.id, r.label))
    return fit([r.text for r in rows if r.label == 1], [r.text for r in rows if r.label == 0], limits)


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score for every row; whole texts. A null or empty text has the score of no
    evidence; null ids and repeated rows are rows like any other; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = copy(sent.value)  # its caches go with the task
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).alias("text")).mapInArrow(rows, f"`{id_col}` long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``: null and empty texts score as
    texts without evidence, null ids (of the fold their empty text falls in) and repeated rows are
    rows like any other, an empty table gives no rows, other columns are not read. Labels that are
    null, repeat or have no document teach nothing more."""
    scored = score_documents(docs, train(docs, labels, limits))
    return scored.select("doc_id", held_out("doc_id", FOLDS, TEST_FOLD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows scored under one half, all columns, whatever their ids: the verdict travels with
    the row, so no join is needed and no column name can clash. Null and empty texts stay; repeated
    rows stay or go together; an empty table gives no rows."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels, limits))
    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(docs))])

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = copy(sent.value)  # its caches go with the task
        for batch in batches:
            keep = [own.score(t or "") < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return plain.mapInArrow(rows, plain.schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

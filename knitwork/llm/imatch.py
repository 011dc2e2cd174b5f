"""I-Match document fingerprints.

The lexicon holds the terms whose inverse document frequency lies in a band: common words say
nothing, rare ones are often slips. A document's distinct lexicon terms are sorted, and for each of
``subsets`` random sub-lexicons those of them that are in it are hashed together, in that order. An edit changes the hashes of
those sub-lexicons that contain a changed term and no others, so the share of equal hashes tells how
alike two documents are.

A sub-lexicon that takes a fixed share of the lexicon would hold hundreds of a long document's terms
and none of a short one's. Sub-lexicons are therefore nested: at level L each keeps one term in 2**L,
and a fingerprint has the three levels from that at which its document has about one term in each.
Levels of documents of like size overlap, and only hashes of one level are compared. Documents with few
lexicon terms are fingerprinted by all their words, under a mark of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from knitwork.llm.common import in_id_order, scratch_path, whole_text, words_of
from knitwork.llm.tokens import BoundedCache

SEED = 9


@dataclass(frozen=True)
class Band:
    """Terms with ``low`` <= ln(N / df) <= ``high`` and df >= 2. A term has a df of at least
    N * exp(-high), so the lexicon has at most exp(high) x (distinct terms of a mean document)
    entries of eight bytes, whatever the number of documents: that is what is broadcast."""

    low: float = math.log(20)
    high: float = math.log(2000)
    subsets: int = 32
    few: int = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Fingerprinter:
    def __init__(self, lexicon: np.ndarray, band: Band):
        self.lexicon, self.band = lexicon, band
        self._hash = BoundedCache(lambda w: xxh64_intdigest(w, SEED), 250_000)
        self._seeds = _mix(np.arange(1, band.subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _level(self, sorted_terms: np.ndarray, level: int, draws: np.ndarray) -> np.ndarray:
        """Per sub-lexicon the XXH64 of its terms, in order, cut to 32 bits; zero: none is in it."""
        inside = (draws >> np.uint64(64 - level) == 0) if level else np.ones(draws.shape, bool)
        subset, term = np.nonzero(inside.T)
        ends = np.cumsum(np.bincount(subset, minlength=self.band.subsets)) * 8
        joined, out, begin = sorted_terms[term].tobytes(), [], 0
        for end in ends.tolist():
            out.append(max(xxh64_intdigest(joined[begin:end], SEED) >> 32, 1) if end > begin else 0)
            begin = end
        return np.array(out, "<u4")

    def _parts(self, mark: str, terms: np.ndarray) -> list[tuple[str, bytes]]:
        if not len(terms):
            return []
        draws = _mix(terms[:, None] ^ self._seeds[None, :])
        level = int(math.log2(len(terms) / 0.75))
        return [(f"{mark}{k}", self._level(terms, k, draws).tobytes()) for k in range(level, level + 3)]

    def __call__(self, text: str) -> dict[str, bytes]:
        """Level name to one 32-bit hash per sub-lexicon; zero: the document has no term in it."""
        words = set(words_of(text))
        terms = np.unique(np.fromiter(map(self._hash.__getitem__, words), np.uint64, len(words)))
        at = np.minimum(np.searchsorted(self.lexicon, terms), max(len(self.lexicon) - 1, 0))
        known = terms[self.lexicon[at] == terms] if len(self.lexicon) else terms[:0]
        out = self._parts("i", known) if len(known) >= self.band.few else []
        if len(known) < 2 * self.band.few:
            out += self._parts("w", terms)
        return dict(out)


def written(parts: dict[str, bytes]) -> str:
    return ";".join(f"{k}:{v.hex()}" for k, v in parts.items())


def likeness(a: dict[str, bytes], b: dict[str, bytes]) -> float:
    """Share of equal hashes among sub-lexicons in which either document has a term, over the levels
    both have; by the lexicon's levels if they share any. Without such: 1 if equal, else 0."""
    for mark in "iw":
        shared = [k for k in a if k[0] == mark and k in b]
        if shared:
            x, y = (np.concatenate([np.frombuffer(p[k], "<u4") for k in shared]) for p in (a, b))
            used = (x != 0) | (y != 0)
            if used.any():
                return float((x == y)[used].mean())
    return float(a == b)


def lexicon(docs: DataFrame, band: Band, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the band's terms, from the document frequencies over all rows."""

    def frequencies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in total), np.uint64, len(total))
            out = pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(total.values()), pa.int64())], ["term", "df"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(set(words_of(text)))
                if len(total) > 400_000:
                    yield flush()
        if total:
            yield flush()

    n = docs.count()
    df = docs.select(whole_text(text_col)).mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    least, most = max(2.0, n * math.exp(-band.high)), n * math.exp(-band.low)
    found = df.filter(F.col("df").between(least, most)).select("term").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) else np.empty(0, np.uint64)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(own: Fingerprinter, doc: int | None, text: str, parts: dict[str, bytes], following: str, after: dict[str, bytes]) -> tuple:
    import hashlib

    n = len(text)
    edited = text[: n - n // 4] + following[: n // 4]
    changed = own(edited)
    return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(parts), written(changed), likeness(parts, changed), likeness(parts, after)


def fingerprint_with_edits(docs: DataFrame, band: Band = Band(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses.

    The next document is by ascending id, then the text's MD5 (null ids first, null texts empty),
    the first after the last; a single row is its own next. Repeated rows follow one another. An empty table
    gives no rows; other columns are ignored. Ids ascend over range partitions, each read as a
    stream; the last row of a partition meets the first one of the next in a second, small step."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, band, text_col))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [press(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "tie", "packed"])

    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        unpack = zstandard.ZstdDecompressor().decompress
        part, own, held, head, out = TaskContext.get().partitionId(), Fingerprinter(terms.value, band), None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return batch

        schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), *[(n, t) for n, t in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))]])
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = unpack(packed).decode("utf-8", "surrogatepass")
                parts = own(text)
                if held is None:
                    head = text
                else:
                    doc_, text_, parts_ = held
                    out.append(dict(zip(("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), _row(own, doc_, text_, parts_, text, parts), strict=True)) | {"part": part, "kind": "done"})
                    if len(out) >= 1000:
                        yield flush()
                held = doc, text, parts
        if held is not None:
            out += [{"part": part, "kind": "first", "text": head}, {"part": part, "kind": "last", "doc_id": held[0], "text": held[1]}]
        if out:
            yield flush()

    path = scratch_path(spark, "fingerprints")
    schema = f"part int, kind string, doc_id long, text string, {RESULT.split(', ', 1)[1]}"
    # texts cross the shuffle compressed, as the frequencies' shuffle is still on disk then
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(whole_text(text_col).cast("binary")).alias("tie"), whole_text(text_col).alias("text"))
    ordered = in_id_order(rows.mapInArrow(pack, "id long, tie string, packed binary"), "id", "tie")
    ordered.mapInArrow(stream, schema).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    done = stored.filter("kind = 'done'").select(*[x.split()[0] for x in RESULT.split(", ")])
    # one number for each partition that has rows
    parts = sorted(r.part for r in stored.filter("kind = 'first'").select("part").collect())
    if not parts:
        return done
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next int")
    first = stored.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    seams = stored.filter("kind = 'last'").select("part", "doc_id", "text").join(after, "part").join(first, "next").select("doc_id", "text", "following")

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Fingerprinter(terms.value, band)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            rows = [_row(own, d, t, own(t), f, own(f)) for d, t, f in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return done.union(seams.mapInArrow(close, RESULT))

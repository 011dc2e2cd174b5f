"""Token ids in a bit-plane shuffled binary format.

A corpus is a table of *segments*. A segment is one self-contained binary blob of whole documents:

    magic ``KWT1`` | header length uint32 | header JSON | chunk index | planes

Its ids are cut into blocks of ``block_ids``. A block is transposed into byte planes (plane k holds
byte k of every id) or bit planes (plane k holds bit k), and each plane is compressed on its own
with zstandard; constant planes shrink to a few bytes. The chunk index has a uint32 length for each
plane of each block, so one block can be read without the others.

Segments are rows written by Spark's own Parquet writer: the files land through the cluster's
committer in whatever store the session uses, and a task that is lost is simply run again.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.llm.common import in_id_order, scratch_path, whole_text
from knitwork.llm.tokens import grouped, shared_encoder

MAGIC = b"KWT1"
SEGMENT_SCHEMA = "shard int, seq int, first_id long, n_docs long, n_ids long, blob binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """One block of uint32 ids as 4 byte planes or 32 bit planes."""
    table = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [table[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        table = np.empty((n, 4), np.uint8)
        for k, part in enumerate(parts):
            table[:, k] = np.frombuffer(part, np.uint8)
        return table.reshape(-1).view("<u4")
    bits = np.empty((n, 32), np.uint8)
    for k, part in enumerate(parts):
        bits[:, k] = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little", count=n)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block_ids: int, planes: str, level: int) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    table = [press.compress(x) for x in (np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), nulls)]
    parts = [press.compress(p) for at in range(0, len(ids), block_ids) for p in to_planes(ids[at : at + block_ids], planes)]
    header = json.dumps({"n_docs": len(doc_ids), "n_ids": len(ids), "block_ids": block_ids, "planes": planes, "table": [len(x) for x in table], "parts": len(parts)}).encode()
    index = np.array([len(p) for p in parts], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, index, *table, *parts])


class Segment:
    """Reads a blob: the document table at once, blocks of ids as asked for."""

    def __init__(self, blob: bytes):
        import zstandard

        if blob[:4] != MAGIC:
            raise ValueError("not a token segment")
        self._open = zstandard.ZstdDecompressor()
        (size,) = struct.unpack_from("<I", blob, 4)
        self.header = json.loads(blob[8 : 8 + size])
        at = 8 + size
        sizes = np.frombuffer(blob, "<u4", self.header["parts"], at).astype(np.int64)
        at += 4 * len(sizes)
        raw = []
        for n in self.header["table"]:
            raw.append(self._open.decompress(blob[at : at + n]))
            at += n
        n = self.header["n_docs"]
        null = np.unpackbits(np.frombuffer(raw[2], np.uint8), count=n) if n else []
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(raw[0], "<i8"), null, strict=True)]
        self.lengths = np.frombuffer(raw[1], "<i8")
        self._blob = blob
        self._ends = at + np.cumsum(sizes)
        self._sizes = sizes

    def block(self, i: int) -> np.ndarray:
        per = 4 if self.header["planes"] == "byte" else 32
        n = min(self.header["block_ids"], self.header["n_ids"] - i * self.header["block_ids"])
        spans = [(self._ends[k] - self._sizes[k], self._ends[k]) for k in range(i * per, (i + 1) * per)]
        return from_planes([self._open.decompress(self._blob[a:b]) for a, b in spans], n, self.header["planes"])

    def ids(self) -> np.ndarray:
        blocks = -(-self.header["n_ids"] // self.header["block_ids"])
        return np.concatenate([self.block(i) for i in range(blocks)]) if blocks else np.empty(0, "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 65_536, segment_ids: int = 1 << 20, planes: str = "byte", level: int = 1) -> None:
    """Tokenise every whole text (null: empty), append ``end_id`` to each document, and write
    segments of about ``segment_ids`` ids in ascending id order (null ids first, repeated rows next
    to each other). A shard is one range of ids; a segment holds whole documents, so one of a very
    long document is larger."""

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), shared_encoder(tokenizer), struct.pack("<I", end_id)
        seq = first = size = 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first, size
            blob = pack_segment(doc_ids, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"), block_ids, planes, level)
            row = {"shard": [shard], "seq": [seq], "first_id": [first], "n_docs": [len(parts)], "n_ids": [size], "blob": [blob]}
            seq, first, size = seq + 1, first + size, 0
            doc_ids.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            own, at = batch.column(0).to_pylist(), 0
            for group in grouped(batch.column(1).to_pylist()):
                for ids in encoder.encode(group):
                    doc_ids.append(own[at])
                    parts.append(ids + end)
                    size += len(ids) // 4 + 1
                    at += 1
                    if size >= segment_ids:
                        yield flush()
        if parts:
            yield flush()

    ordered = in_id_order(docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")), "id", "text")
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "none").mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked
    for, ids as little-endian uint32 bytes; otherwise those never leave the worker. Only the totals of the shards, one number for each write task,
    pass through the driver."""
    stored = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, at = {}, 0
    for row in totals:
        base[row.shard], at = at, at + row.n

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, first, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                segment = Segment(blob)
                raw = segment.ids().tobytes()
                ends = np.cumsum(segment.lengths)
                spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), segment.lengths.tolist(), strict=True)]
                columns = {"doc_id": pa.array(segment.doc_ids, pa.int64()), "start": pa.array(base[shard] + first + ends - segment.lengths, pa.int64()), "n_tokens": pa.array(segment.lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in spans], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(spans, pa.binary())} if with_ids else {}))

    return stored.select("shard", "first_id", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, **options) -> DataFrame:
    """Write and read back; the digest of each document from the files. Nulls, empty texts and tables and
    repeated rows as in ``write_tokens``; other columns are not read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **options)
    return read_tokens(spark, path, with_ids=False)

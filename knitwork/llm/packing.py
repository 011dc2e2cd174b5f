"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs over (length, count) pairs instead of documents, so the plan's work depends
on the sequence length and not on the corpus: at most ``capacity`` lengths, each touching a bounded
number of open groups of equal sequences. Every planned slot is then an interval of ranks within
one length; pieces get a rank within their length and take the slot that has it, by an equi-join on
(length, rank), whose keys are unique.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knitwork.llm.common import cut_lineage, give_back, whole_text
from knitwork.llm.tokens import grouped, shared_encoder

#: A length, which may hold a third of all rows, is ranked in parts: up to ``LEAST_PARTS`` of at least
#: ``LEAST_ROWS`` pieces, more where they would exceed ``MOST_ROWS``.
LEAST_PARTS, LEAST_ROWS, MOST_ROWS = 32, 64, 200_000
#: Rows of part offsets up to which they are broadcast; there is one for each part.
MOST_BROADCAST = 500_000
#: Words a packing worker caches. It shares its executor with what earlier stages left in memory, so its
#: caches are smaller than those of tokenisation alone and go with the task.
CACHED_WORDS = 120_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, number, first sequence, offset) and the number of sequences:
    rank ``first rank + i`` of a length goes to sequence ``first sequence + i`` at ``offset``.
    Lengths from the largest; each goes to the fullest open sequences that still hold it."""
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, number)
    spaces: list[int] = []
    sequences = 0

    def put(space: int, first: int, number: int) -> None:
        if space:
            if space not in open_:
                bisect.insort(spaces, space)
                open_[space] = []
            open_[space].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, number = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(k)
                used = min(left, number)
                if used < number:
                    put(space, first + used, number - used)
            else:
                space, first, used = capacity, sequences, -(-left // (capacity // length))
                sequences += used
            slots.append((length, rank, used, first, capacity - space))
            put(space - length, first, used)
            rank, left = rank + used, left - used
    return slots, sequences


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the ids themselves stay where they
    are made. Only documents longer than ``capacity`` are cut."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, end, step = shared_encoder(tokenizer, CACHED_WORDS), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            own, at = batch.column(0).to_pylist(), 0
            for group in grouped(batch.column(1).to_pylist()):
                rows = []
                for ids in encoder.encode(group):
                    ids += end
                    rows += [(own[at], k // step, k // 4, len(part := ids[k : k + step]) // 4, zlib.crc32(part)) for k in range(0, len(ids), step)]
                    at += 1
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A null text is empty and makes a piece of the end id alone; null ids and repeated rows are
    pieces like any other; an empty table gives no rows; other columns are not read. Pieces are
    written once; ranks follow a total order of their columns, so they are the same when the tasks
    of a lost executor run again."""
    spark = docs.sparkSession
    made = cut_lineage(cut_pieces(docs, tokenizer, end_id, capacity, id_col, text_col))
    # at most ``capacity`` rows, whatever the input
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_best_fit(counts, capacity)
    parts_of = lambda n: max(-(-n // MOST_ROWS), min(LEAST_PARTS, -(-n // LEAST_ROWS)))
    parts = spark.createDataFrame([(length, parts_of(n)) for length, n in counts.items()], "length long, parts int")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).cast("int")
    dealt = made.join(F.broadcast(parts), "length").withColumn("part", part).drop("parts")
    sizes = cut_lineage(dealt.groupBy("length", "part").agg(F.count("*").alias("n")))
    # a length has few parts: 32, or one to 200,000 pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if sizes.count() <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1)
    placed = ranked.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    plan = spark.createDataFrame(slots, "length long, first_rank long, number long, first_sequence long, offset long")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)).alias("i")
    # slots of millions of ranks are first cut into runs, so that no task makes them all
    run = 100_000
    runs = plan.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("number") - 1) / run))))
    runs = runs.select("length", (F.col("first_rank") + F.col("run") * run).alias("first_rank"), F.least(F.lit(run).cast("long"), F.col("number") - F.col("run") * run).alias("number"), (F.col("first_sequence") + F.col("run") * run).alias("first_sequence"), "offset").repartition("length", "first_rank")
    slot = runs.select("length", "first_rank", "first_sequence", "offset", step).select("length", (F.col("first_rank") + F.col("i")).alias("rank"), (F.col("first_sequence") + F.col("i")).alias("sequence_id"), "offset")
    # as many slots as pieces: never broadcast, whatever the planner thinks of the exploded plan
    return placed.join(slot.hint("merge"), ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

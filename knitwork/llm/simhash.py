"""SimHash near-duplicates, linked through pivot distance tables.

The pivot table is made once: for every distinct fingerprint its Hamming distances to ``PIVOTS`` fixed
reference fingerprints, one byte each. By the triangle inequality two fingerprints whose coordinates
differ by more than ``RADIUS`` anywhere can't link, so in every group of candidates the largest
coordinate difference discards pairs first, and the distance itself verifies the survivors.

Coordinates of 64 near-random bits lie within a few units of 32: cells of them that overlap enough to
lose no link copy rows as fast as they split them. What brings candidates together is therefore that
fingerprints at most ``RADIUS`` bits apart agree in full on some two of ``BLOCKS`` bit blocks: each goes
into ten groups keyed by two blocks, and no link can be lost. From each group only the edges of a
spanning forest come out, never all pairs, and one with very many fingerprints is cut into tiles that
meet pairwise. Nodes are the fingerprints themselves, so rows without an id link like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import cut_lineage, fresh, give_back, own_columns, whole_text, words_of
from knitwork.operators.components import connected_components

SEED = 42
RADIUS = 3
#: Bits of each block, from the lowest.
BLOCK_BITS = (13, 13, 13, 13, 12)
PIVOTS = 16
#: Fingerprints of more rows than either are hot; there are at most ``MOST_HOT`` of them.
LEAST_HOT, MOST_HOT = 500, 1_024
#: Rows of a tile; keys with more are cut into tiles, each pair of which meets in one group.
TILE = 4_096


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by the splitmix64 rule."""
    out, state = [], 0
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is 1 where it is set in over half the shingles' XXH64; no words: zero."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = bit_counts(np.array(hashes, np.uint64))
    return int(np.bitwise_or.reduce(np.where(2 * counts > len(hashes), np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: each byte's table of values, then bits of the values."""
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.empty(64, np.int64)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for k in range(8):
        out[8 * k : 8 * k + 8] = np.bincount(octets[:, k], minlength=256) @ bits
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(rows, "doc_id long, fp long")


def table_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: table number above the bits of two blocks."""
    ends = np.cumsum(BLOCK_BITS).tolist()
    blocks = [F.shiftrightunsigned(fp, e - b).bitwiseAND(F.lit((1 << b) - 1)) for e, b in zip(ends, BLOCK_BITS, strict=True)]
    return F.array(*[F.shiftleft(blocks[i], 13).bitwiseOR(blocks[j]).bitwiseOR(F.lit(t << 26)) for t, (i, j) in enumerate(combinations(range(len(blocks)), 2))])


def coordinates(fps: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: the distance of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ reference[None, :]).astype(np.int8)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``distinct``'s fp with its coordinates, ``PIVOTS`` bytes."""
    reference = pivots()

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            flat = coordinates(fps.view(np.uint64), reference).tobytes()
            at = pa.array(np.arange(0, len(flat) + 1, PIVOTS, dtype=np.int32)).buffers()[1]
            table = pa.Array.from_buffers(pa.binary(), len(fps), [None, at, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column(0), table], ["fp", "pivots"])

    return distinct.select("fp").mapInArrow(rows, "fp long, pivots binary")


def near(fps: np.ndarray, table: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that link to x: by coordinates first, survivors by distance."""
    others = others[np.abs(table[others] - table[x]).max(axis=1) <= RADIUS]
    return others[np.bitwise_count(fps[others] ^ fps[x]) <= RADIUS]


def forest(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that span each group of fingerprints linked within ``RADIUS``: breadth-first,
    each row compared with those not reached yet. Rows are sorted by the first coordinate, of which
    only a window can link; the other coordinates discard most of that."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)
    low, high = np.searchsorted(first, first - RADIUS), np.searchsorted(first, first + RADIUS, "right")
    unreached = np.ones(len(fps), bool)
    edges = []
    for root in range(len(fps)):
        if not unreached[root]:
            continue
        unreached[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            found = near(fps, table, x, low[x] + np.flatnonzero(unreached[low[x] : high[x]]))
            unreached[found] = False
            edges += [(x, y) for y in found.tolist()]
            queue += found.tolist()
    return [(int(order[a]), int(order[b])) for a, b in edges]


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst) of fingerprints, spanning all links between the distinct ``fp`` of a table.
    Groups are read from sorted partitions, one at a time."""
    table = cut_lineage(pivot_table(distinct))
    keyed = table.select("fp", "pivots", F.explode(table_keys(F.col("fp"))).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("crowded"), "n")
    parts = F.when(F.col("n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("n") / (TILE / 2)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiled = keyed.join(crowded, keyed["key"] == crowded["crowded"], "left").withColumn("parts", parts).withColumn("own", own)
    tiles = tiled.select("key", "fp", "pivots", F.explode(F.expr("transform(sequence(0, parts - 1), j -> struct(least(own, j) as a, greatest(own, j) as b))")).alias("tile"))
    dealt = tiles.select("key", "tile.a", "tile.b", "fp", "pivots").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def edges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rest: tuple[np.ndarray, ...] | None = None

        def groups(columns: tuple[np.ndarray, ...], last: bool):
            key, a, b, fp, table = columns
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            done = len(starts) if last else len(starts) - 1
            sizes = (ends - starts)[:done]
            found = []
            # groups of two, all at once: coordinates first, then distance
            two = starts[:done][sizes == 2]
            two = two[np.abs(table[two] - table[two + 1]).max(axis=1) <= RADIUS] if len(two) else two
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
            found += [(int(fp[s]), int(fp[s + 1])) for s in two]
            for s, e in zip(starts[:done][sizes > 2].tolist(), ends[:done][sizes > 2].tolist(), strict=True):
                found += [(int(fp[s + x]), int(fp[s + y])) for x, y in forest(fp[s:e], table[s:e])]
            ends_ = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends_[:, 0]), pa.array(ends_[:, 1])], ["src", "dst"]), int(starts[done]) if done < len(starts) else len(key)

        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            own[3] = own[3].view(np.uint64)
            own.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int8).reshape(-1, PIVOTS))
            rest = tuple(own) if rest is None else tuple(np.concatenate(x) for x in zip(rest, own, strict=True))
            if len(rest[0]):
                out, used = groups(rest, False)
                rest = tuple(x[used:] for x in rest)
                yield out
        if rest is not None and len(rest[0]):
            yield groups(rest, True)[0]
        rest = None
        give_back()

    return dealt.mapInArrow(edges, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Null counts as an empty text, whose fingerprint is zero and links like any other. Links are
    between fingerprints: a row with a null id takes part in them, also as a bridge between others,
    and where a component has no ids its component_id is null; a repeated id with different texts
    joins nothing. Repeated rows give repeated results; an empty table none; other columns are not
    read. Rows of fingerprints that very many share get their component by a broadcast of at most
    ``MOST_HOT`` rows, the others by a join whose keys then are not hot."""
    return components(cut_lineage(fingerprints(docs, id_col, text_col, width)))


def components(prints: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates``, of a table of doc_id and fp."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = connected_components(links(distinct)).select(F.col("id").alias("fp"), "component")
    linked = cut_lineage(distinct.join(found, "fp"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = linked.join(least, "component").select("fp", "component_id")
    labels = cut_lineage(distinct.join(labels.withColumn("in", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")))
    rows = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = max(LEAST_HOT, rows // MOST_HOT)
    heavy = labels.filter(F.col("n") > hot).select("fp", F.struct("component_id").alias("of_hot"))
    light = labels.filter(F.col("n") <= hot).select(F.col("fp").alias("light_fp"), "component_id")
    left = prints.join(F.broadcast(heavy), "fp", "left")
    # rows that have their component join nothing: null keys, spread by a random part of the join
    key = F.when(F.col("of_hot").isNull(), F.col("fp"))
    spread = F.when(F.col("of_hot").isNotNull(), F.floor(F.rand(7) * 4_096)).otherwise(0)
    joined = left.withColumn("key", key).withColumn("spread", spread).join(light.withColumn("zero", F.lit(0).cast("long")).hint("merge"), (F.col("key") == F.col("light_fp")) & (F.col("spread") == F.col("zero")), "left")
    component = F.when(F.col("of_hot").isNotNull(), F.col("of_hot.component_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each component: that with its smallest id; all columns, whatever their names.

    Rows are told apart by their place, not by id: of those that share the smallest id, or have
    none, the first one stays. Null counts as an empty text; an empty table gives no rows."""
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    rows = cut_lineage(docs.select(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(docs))], F.monotonically_increasing_id().alias(row)))
    names = docs.columns
    at = {name: f"c{i}" for i, name in enumerate(names)}
    # the row number takes the id's place: components of all rows, then the best row of each
    found = near_duplicates(rows, row, at[text_col], width)
    ids = rows.select(F.col(row).alias("doc_id"), F.col(at[id_col]).alias("id"))
    best = found.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"))
    stays = best.select(F.col("first.doc_id").alias(gone))
    return rows.join(stays, rows[row] == stays[gone], "left_semi").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

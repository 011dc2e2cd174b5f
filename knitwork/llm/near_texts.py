"""Near copies by SimHash and the similarity of their texts: five-word Jaccard of 0.8 or more.

A text has ``WORDS`` SimHash fingerprints of 64 bits over its distinct five-word shingles; the first is
that of XXH64 itself. Candidates come in two steps, and each is verified on its whole set of shingles.

First op7's operator: components of first fingerprints at most three bits apart, by tables that lose
no link and the pivot distance table.

Texts of similarity 0.8 differ in ten of 64 bits on average and often in more; there the triangle
inequality discards nothing, and block tables hold chance pairs without number. But bits whose counts
are far from half hardly ever differ. So each fingerprint gives its two surest bits, and two
neighbouring fingerprints three keys: both first ones, and either first with the other's second.
Texts that share a key, are of sizes that allow 0.8 and differ in at most ``RADIUS`` of the bits of
``CHECKED`` fingerprints are candidates, unless they are linked as such already. At 0.8, the least,
simulated pairs shared no key in 2 of 10^6 cases for sets of four and five shingles and in none for
others; the radius is over five standard deviations above their mean distance.

Candidate pairs are never listed and a text is not gathered once for each key it shares: what they
link are components, and each is verified whole, with every text read once. One above ``TILE`` rows
is dealt into tiles; after that only rows that are still apart meet, tile by tile. One above ``MOST``
rows is rather a chain of chance pairs; there the groups of each key are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.llm import simhash
from knitwork.llm.common import cut_lineage, fresh, give_back, own_columns, whole_text, words_of
from knitwork.operators.components import connected_components

SEED = 42
WIDTH = 5
#: Fingerprints of a text; bits of the first ``CHECKED`` ones that candidates may differ in.
WORDS, CHECKED, RADIUS = 32, 3, 66
#: Fingerprints whose keys link candidates first.
FIRST = 2
#: Jaccard of at least 4 / 5, in whole numbers.
LEAST = (4, 5)
#: Rows of a tile of texts and of one of fingerprints; groups with more are cut into tiles, each pair
#: of which meets in one group.
TILE, WIDE_TILE = 1_024, 8_192
#: Rows of a component of candidates that is verified whole; larger ones are verified key by key.
MOST = 8_192
#: Narrow rows that are broadcast at most.
MOST_SENT = 500_000
#: What makes the fingerprints' hashes of the shingles'.
MASKS, ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, WORDS), np.uint64)
ODD |= np.uint64(1)
LOWEST = np.uint64(0x0101010101010101)


def shingles(text: str) -> np.ndarray:
    """The distinct XXH64 of runs of ``WIDTH`` words; shorter texts are one shingle."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WIDTH].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)], np.uint64))


def margins(hashes: np.ndarray) -> np.ndarray:
    """Per fingerprint and bit, in how many more hashes it is set than not; above 0 the bit is 1."""
    counts = np.zeros((WORDS, 8, 8), np.int64)
    for at in range(0, len(hashes), 255):  # a byte counts that far
        part = hashes[at : at + 255, None]
        mixed = (part ^ MASKS) * ODD
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed[:, 0] = part[:, 0]
        for k in range(8):  # the k-th bit of each byte
            counts[:, :, k] += (mixed >> np.uint64(k) & LOWEST).sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(WORDS, 8)
    return (2 * counts - len(hashes)).reshape(WORDS, 64)


def fingerprints(margin: np.ndarray) -> np.ndarray:
    return np.packbits(margin > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def sure_keys(margin: np.ndarray, n: int) -> np.ndarray:
    """Three keys for each two neighbouring fingerprints: their number and the surest bits. What the
    next fingerprints have at a bit's place decides between bits that are equally sure."""
    sure = margin.astype(np.float32)
    share = sure / np.float32(2 * n + 2)
    for k in range(1, 6):
        sure += np.roll(share, k, axis=0)
        share *= np.float32(0.5)
    row, left = np.arange(WORDS), np.abs(sure)
    first = left.argmax(axis=1)
    left[row, first] = -1
    second = left.argmax(axis=1)
    first, second = (2 * bit + (sure[row, bit] > 0) for bit in (first, second))
    keys = [row << 14 | x << 7 | np.roll(y, -1) for x, y in ((first, first), (first, second), (second, first))]
    return np.concatenate(keys).astype(np.int32)


def prints(texts: DataFrame) -> DataFrame:
    """row, n (distinct shingles), f0, f1, f2 (the checked fingerprints) and keys, of row and text."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, words, keys = [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py())
                margin = margins(hashes)
                sizes.append(len(hashes))
                words.append(fingerprints(margin[:CHECKED]).astype(np.int64))
                keys.append(sure_keys(margin, len(hashes)))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int32)
            ends = np.arange(0, len(flat) + 1, 3 * WORDS, dtype=np.int32)
            f = np.array(words, np.int64).reshape(-1, CHECKED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *[pa.array(f[:, k]) for k in range(CHECKED)], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["row", "n", "f0", "f1", "f2", "keys"])
        give_back()

    return texts.mapInArrow(made, "row long, n int, f0 long, f1 long, f2 long, keys array<int>")


def tiled(keyed: DataFrame, most: int) -> DataFrame:
    """``keyed`` with the rows of a key that has more than ``most`` under keys of tiles instead."""
    rest = [c for c in keyed.columns if c != "key"]
    crowded = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("key").alias("crowded"), F.ceil(F.col("n") / (most / 2)).cast("int").alias("parts")))
    if crowded.isEmpty():
        return keyed
    dealt = keyed.join(crowded, keyed["key"] == crowded["crowded"], "left").withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    tiles = F.expr("if(parts is null, array(cast(key as long)), transform(sequence(0, parts - 1), j -> xxhash64(key, least(own, j), greatest(own, j))))")
    return dealt.select(F.explode(tiles).alias("key"), *rest)


def candidates(key: np.ndarray, part: np.ndarray, n: np.ndarray, prints: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """``label``, the place of a row that each is grouped with, after candidate pairs have joined the
    groups. Rows are sorted by key and n; those of the same part are linked already."""
    at, step = np.arange(len(key)), 0
    up, down = LEAST
    while True:
        step += 1
        at = at[at + step < len(key)]
        # sizes ascend: a row too far off in size ends the search of the row before it
        at = at[(key[at] == key[at + step]) & (up * n[at + step] <= down * n[at])]
        if not len(at):
            return label
        near = at[(part[at] != part[at + step]) & (label[at] != label[at + step])]
        near = near[sum(np.bitwise_count(f[near] ^ f[near + step]).astype(np.int64) for f in prints) <= RADIUS]
        while len(near := near[label[near] != label[near + step]]):
            a, b = label[near], label[near + step]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]


def joined_parts(key: np.ndarray, part: np.ndarray, n: np.ndarray, *prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of parts, each once, that span what candidate pairs link in each key."""
    order = np.lexsort((part, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])]
    first = np.empty(len(key), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    label = candidates(key, part, n, list(prints), first)
    at = order[new]
    least = part.copy()
    np.minimum.at(least, label[at], part[at])
    pairs = np.stack([part[at], least[label[at]]])
    return tuple(np.unique(pairs[:, pairs[0] != pairs[1]], axis=1))


def named_groups(key: np.ndarray, part: np.ndarray, n: np.ndarray, *prints_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, row) of rows that candidate pairs link, a group's name being made of its rows."""
    *prints, row = prints_row
    row = row.view(np.int64)
    label = candidates(key, part, n, prints, np.arange(len(key)))
    sizes = np.bincount(label, minlength=len(key))
    found = np.flatnonzero(sizes[label] > 1)
    mixed = (row[found].view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    names = np.zeros(len(key), np.uint64)
    np.add.at(names, label[found], mixed ^ mixed >> np.uint64(32))
    return names[label[found]].view(np.int64), row[found]


def by_keys(made: DataFrame, parts: DataFrame, wanted: str, settle: Callable, names: tuple[str, str], *more: str) -> DataFrame:
    """Two long columns that ``settle`` makes of the rows of each key, of those keys for which
    ``wanted`` holds. parts: (id, component) linked already."""
    linked = made.join(parts.select(F.col("id").alias("linked"), "component"), F.col("row") == F.col("linked"), "left")
    rows = cut_lineage(linked.select("row", F.coalesce("component", "row").alias("part"), "n", "f0", "f1", "f2", F.expr(f"filter(keys, k -> {wanted})").alias("keys")))
    keyed = rows.select(F.explode("keys").alias("key"), "row", "part", "n", "f0", "f1", "f2")
    dealt = tiled(keyed, WIDE_TILE).select("key", "part", "n", "f0", "f1", "f2", *more).repartition("key").sortWithinPartitions("key", "n")

    def grouped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def settled(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, part, n, *f = columns
            found = settle(key, part, n.astype(np.int64), *[x.view(np.uint64) for x in f])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], list(names))

        rest: list[np.ndarray] | None = None
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            # the last key may go on in the next batch
            done = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
            if done:
                yield settled([x[:done] for x in rest])
                rest = [x[done:] for x in rest]
        if rest is not None and len(rest[0]):
            yield settled(rest)
        rest = None
        give_back()

    return cut_lineage(dealt.mapInArrow(grouped, ", ".join(f"{x} long" for x in names)).distinct())


def candidate_components(made: DataFrame, close: DataFrame) -> DataFrame:
    """(id, component) of the rows that candidate pairs link, over all keys; close: (id, component) of
    op7's. The keys of the first fingerprints go before the others, to which most is linked then."""
    early = FIRST << 14
    found = cut_lineage(close.filter("id <> component"))
    for wanted in (f"k < {early}", f"k >= {early}"):
        pairs = by_keys(made, found, wanted, joined_parts, ("src", "dst"))
        found = cut_lineage(connected_components(found.select(F.col("id").alias("src"), F.col("component").alias("dst")).union(pairs)))
    return found


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs that span each group of sets linked by similarity: breadth-first, each set
    compared with all that are not reached yet."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(ids.max() + 1, bool)
    unreached = np.ones(len(sets), bool)
    edges = []
    for root in range(len(sets)):
        if not unreached[root]:
            continue
        unreached[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            if not unreached.any():
                break
            mine = ids[starts[x] : starts[x] + sizes[x]]
            marked[mine] = True
            both = np.add.reduceat(marked[ids].astype(np.int32), starts)
            marked[mine] = False
            up, down = LEAST
            near = np.flatnonzero(unreached & (down * both >= up * (sizes + sizes[x] - both)))
            unreached[near] = False
            edges += [(x, y) for y in near.tolist()]
            queue += near.tolist()
    return edges


def sent(rows: DataFrame) -> DataFrame:
    """Narrow rows that go to where the texts are, if they are at most ``MOST_SENT``; else both move."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def compared(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) of row numbers, spanning the links between similar texts of each group (key, row)."""
    gathered = sent(groups).join(texts.withColumnRenamed("row", "text_row"), F.col("row") == F.col("text_row")).select("key", "row", "text")
    grouped = gathered.repartition("key").sortWithinPartitions("key")

    def edges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, numbers, sets = None, [], []

        def settle() -> list[tuple[int, int]]:
            return [(numbers[x], numbers[y]) for x, y in forest(sets)] if len(sets) > 1 else []

        for batch in batches:
            found = []
            key, row, text = (batch.column(k) for k in range(3))
            for group, number, t in zip(key.to_pylist(), row.to_pylist(), text, strict=True):
                if group != at:
                    found += settle()
                    at, numbers, sets = group, [], []
                numbers.append(number)
                sets.append(shingles(t.as_py()))
            yield to_batch(pa, found)
        yield to_batch(pa, settle())
        numbers, sets = [], []
        give_back()

    def to_batch(pa, found):
        src, dst = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return cut_lineage(grouped.mapInArrow(edges, "src long, dst long"))


def tiles_of(n: Column) -> Column:
    return F.ceil(n / (TILE / 2)).cast("int")


def across(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups (key, row) of about ``TILE`` rows in which any two rows of a key meet that are not of one
    part. Those of a key's largest part are dealt once, as they need not meet each other."""
    linked = groups.join(parts.select(F.col("id").alias("linked"), "component"), F.col("row") == F.col("linked"), "left")
    rows = cut_lineage(linked.select("key", "row", F.coalesce("component", "row").alias("part")))
    counted = rows.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
    several = cut_lineage(counted.filter("all > most.n").select(F.col("key").alias("several"), F.col("most.part").alias("main"), tiles_of(F.col("most.n")).alias("mains"), tiles_of(F.col("all") - F.col("most.n")).alias("others")))
    dealt = rows.join(several, F.col("key") == F.col("several")).withColumn("own", F.expr("cast(pmod(xxhash64(row), if(part = main, mains, others)) as int)"))
    of_main = "transform(sequence(0, others - 1), j -> xxhash64(key, 0, j, own))"
    to_main = "transform(sequence(0, mains - 1), j -> xxhash64(key, 0, own, j))"
    to_others = "transform(filter(sequence(0, others - 1), j -> j <> own), j -> xxhash64(key, 1, least(own, j), greatest(own, j)))"
    return dealt.select(F.explode(F.expr(f"if(part = main, {of_main}, concat({to_main}, {to_others}))")).alias("key"), "row")


def verified(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``compared``, with groups above ``TILE`` rows in two steps: dealt into tiles that don't meet,
    which links most of what is alike; then what is still apart meets."""
    crowded = cut_lineage(groups.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("crowded"), tiles_of(F.col("n")).alias("tiles")))
    if crowded.isEmpty():
        return compared(groups, texts)
    dealt = groups.join(crowded, groups["key"] == crowded["crowded"], "left")
    first = compared(dealt.select(F.expr("if(tiles is null, key, xxhash64(key, pmod(xxhash64(row), tiles)))").alias("key"), "row"), texts)
    again = groups.join(crowded, groups["key"] == crowded["crowded"], "left_semi")
    return first.union(compared(across(again, connected_components(first)), texts))


def links(rows: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """(src, dst) of row numbers, spanning all links between similar texts."""
    texts = rows.select(F.col(row_col).alias("row"), whole_text(text_col).alias("text"))
    made = cut_lineage(prints(texts))
    close = cut_lineage(simhash.components(made.select(F.col("row").alias("doc_id"), F.col("f0").alias("fp"))).select(F.col("doc_id").alias("id"), F.col("component_id").alias("component")))
    groups = cut_lineage(candidate_components(made, close).select(F.col("component").alias("key"), F.col("id").alias("row")))
    vast = cut_lineage(groups.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select(F.col("key").alias("vast")))
    if vast.isEmpty():
        return verified(groups, texts)
    whole = verified(groups.join(vast, groups["key"] == vast["vast"], "left_anti"), texts)
    return whole.union(links_by_key(groups.join(vast, groups["key"] == vast["vast"], "left_semi").select(F.col("row").alias("own")), made, close, texts))


def links_by_key(own: DataFrame, made: DataFrame, close: DataFrame, texts: DataFrame) -> DataFrame:
    """``links`` between the rows of ``own``: op7's groups first, then those of each key."""
    near = cut_lineage(close.join(own, close["id"] == own["own"], "left_semi").select(F.col("component").alias("key"), F.col("id").alias("row")))
    several = near.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("several"))
    first = verified(near.join(several, near["key"] == several["several"], "left_semi"), texts)
    groups = by_keys(made.join(own, made["row"] == own["own"], "left_semi"), connected_components(first), "true", named_groups, ("key", "row"), "row")
    return first.union(verified(groups, texts))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar texts: that with the smallest id; all columns.

    Rows are told apart by their place, not by id: of copies that share an id, or have none, one
    stays as well (any id goes before none). Null counts as an empty text; texts without words are
    similar to each other only; an empty table gives no rows."""
    names, row = docs.columns, fresh(docs, "row")
    rows = cut_lineage(docs.select(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(docs))], F.monotonically_increasing_id().alias(row)))
    at = {name: f"c{i}" for i, name in enumerate(names)}
    found = cut_lineage(connected_components(links(rows, row, at[text_col])))
    ids = rows.select(F.col(row).alias("id"), F.col(at[id_col]).alias("doc"))
    stays = found.join(ids, "id").groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "id")).alias("first")).select("first.id")
    gone = sent(found.select("id").join(stays, "id", "left_anti"))
    return rows.join(gone, rows[row] == gone["id"], "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

"""Exact duplicates by progressive refinement, in DataFrame operations only.

1. Length and prefix: every row gives its byte length and a hash of its first bytes; groups of one
   are settled. The keys of the others are marked in a bitmap, built by Spark's bitmap aggregate,
   which is what gets broadcast. It has 16 bits for each of those keys, as they are counted, and
   at most 2**MOST_BITS (32 MiB). A collision in it only sends a row on to the next step needlessly.
2. Full hash: SHA-256 of the whole text, computed for the surviving rows alone.
3. Groups by full hash, pre-aggregated before the shuffle, give the row that stays.

For decisions rows get their group back in two joins. Groups above a 1,024th of all grouped rows number
at most 1,024 and are broadcast, so the rows of a hot group stay where they are; the rest are
shuffled by their hash, and none of those keys is hot. For the rows that stay no join is needed:
rows settled early pass straight through, and of each other group one row comes out of an aggregate
that every task begins on its own rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import cut_lineage, fresh, own_columns, whole_text

#: Bits of the bitmap, as powers of two: 32 KiB at least, 32 MiB at most.
LEAST_BITS, MOST_BITS = 18, 28
PREFIX_BYTES = 256
#: Groups of more rows than either are hot; there are at most ``MOST_HOT`` of them.
LEAST_HOT, MOST_HOT = 500, 1_024


def _survivors(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a flag of its own name: the text may have an equal one."""
    text = whole_text(f"`{text_col}`")
    length, head = F.octet_length(text), F.xxhash64(F.substring(text.cast("binary"), 1, PREFIX_BYTES))
    keys = docs.select(length.alias("length"), head.alias("head")).groupBy("length", "head").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(keys.select("length", "head"))
    count = shared.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(count, 1)))))
    slot_of = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(1 << bits))
    slot = slot_of(F.col("length"), F.col("head"))
    bucket, bitmap = fresh(docs, "bucket"), fresh(docs, "bitmap")
    bitmaps = shared.groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bitmap))
    own = slot_of(length, head)
    # at most 2**MOST_BITS bits, in bitmaps of 4 KiB
    probed = docs.withColumn(bucket, F.bitmap_bucket_number(own)).join(F.broadcast(cut_lineage(bitmaps)), bucket, "left")
    position = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flag = fresh(docs, "survives")
    marked = F.coalesce(F.getbit(F.coalesce(byte, F.lit(0)), F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))
    return probed.select(*own_columns(docs), marked.alias(flag)), flag


def duplicate_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the row with
    the largest id stays (of repeated ids, which are ties, each is kept; a null id stays only where
    all ids of the group are null). text_sha256 is null for rows settled by length and prefix,
    unless ``digest_all`` asks for it. An empty table gives no rows; other columns are ignored."""
    narrow = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    marked, flag = _survivors(narrow, "text")
    survives = F.col(flag)
    hashed = marked.select("id", survives.alias("survives"), F.when(F.lit(digest_all) | survives, F.sha2("text", 256)).alias("text_sha256"))
    counted = hashed.filter("survives").groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut_lineage(counted.filter("group_size > 1"))
    grouped_rows = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = max(LEAST_HOT, grouped_rows // MOST_HOT)
    # rows settled early, or by the broadcast, join nothing: their own key spreads them out
    own_key = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("-"), F.rand(7).cast("string"))
    heavy = groups.filter(F.col("group_size") > hot).select(F.col("text_sha256").alias("key"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    light = groups.filter(F.col("group_size") <= hot).select(F.col("text_sha256").alias("key"), "keep_id", "group_size")
    left = hashed.withColumn("key", F.when(F.col("survives"), F.col("text_sha256")).otherwise(own_key)).join(F.broadcast(heavy), "key", "left")
    joined = left.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("key")).otherwise(own_key)).join(light.hint("merge"), "key", "left")
    joined = joined.withColumn("keep_id", F.coalesce("hot_keep", "keep_id")).withColumn("group_size", F.coalesce("hot_size", "group_size")).withColumn("grouped", F.col("group_size").isNotNull())
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns, whatever their names.

    It is the row with the largest id. Null counts as empty; any id goes before none; of rows that
    share the largest id, or all have none, one stays. An empty table gives no rows."""
    marked, flag = _survivors(docs, text_col)
    columns = own_columns(docs)
    survives = F.col(flag)
    single = marked.filter(~survives).select(*columns)
    order = F.struct(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    # maps can't be grouped by, but they can be carried
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    chosen = marked.filter(survives).groupBy(F.sha2(whole_text(f"`{text_col}`"), 256).alias("sha")).agg(F.max_by(whole, order).alias("row"))
    return single.union(chosen.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(docs.columns)]))


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g using (text)
"""

"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knitwork.session import cut_lineage, read_table, scratch_path

__all__ = ["cut_lineage", "read_table", "scratch_path", "documents", "whole_text", "in_id_order", "held_out", "words_of", "give_back", "fresh", "own_columns"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def whole_text(text: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def in_id_order(docs: DataFrame, id_col: str, *tie: str) -> DataFrame:
    """Range-partitioned and sorted by id: partition numbers ascend with the ids (nulls first)."""
    return docs.repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), *tie)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``docs`` has (names differ by more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names hold: dots and blanks too."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def words_of(text: str) -> list[bytes]:
    """Lower-cased A-Z; words are runs outside U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def give_back() -> None:
    """At the end of a task: memory that the worker process holds but no longer uses goes back to the
    system. Workers live on from stage to stage, and an executor's limit counts all of them."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)

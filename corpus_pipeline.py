"""Stages that turn raw documents into packed training sequences.

Each stage takes the rows its predecessor kept. Toxic documents go, then all but one of each group of
exact copies and of each component of near copies (five-word Jaccard of 0.8 or more); what is left is mixed so that small sources weigh
more (none is repeated more than twice, none loses a document), and packed into sequences. No SQL can
express the learnt, fingerprinting and tokenising stages, so the run is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knitwork.llm.common import documents, read_table, scratch_path
from knitwork.llm.exact_dedup import drop_exact_duplicates
from knitwork.llm.mixing import mixed_documents
from knitwork.llm.near_texts import keep_one_of_similar
from knitwork.llm.packing import pack_best_fit
from knitwork.llm.tokens import tokenizer_path
from knitwork.llm.toxicity import drop_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_best_fit(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("temperature mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

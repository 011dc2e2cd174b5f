"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knitwork.llm.common import documents, read_table
from knitwork.llm import class_ngrams, exact_dedup, imatch, mixing
from knitwork.llm.html_text import extract_pages
from knitwork.llm.packing import pack_best_fit
from knitwork.llm.personal_data import personal_data_digest
from knitwork.llm.simhash import near_duplicates
from knitwork.llm.token_store import token_round_trip
from knitwork.llm.tokens import tokenizer_path
from knitwork.llm.toxicity import toxicity


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(documents(spark, sf_dir), tokenizer_path(), end_id=2)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), max_repeats=2.0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_decisions(documents(spark, sf_dir), digest_all=True)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_with_edits(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir), tokenizer_path(), end_id=0, capacity=2048)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.score_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op3_class_ngrams": op3_class_ngrams,
    "op2_token_planes": op2_token_planes,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_html_text": op8_html_text,
    "op9_imatch": op9_imatch,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_temperature_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
}

"""Corpus pipeline: documents without toxic ones, near copies and benchmark leaks, mixed and written as token ids.

Every stage takes all rows of the one before it. Null texts count as empty; an empty table gives an empty table with the
same columns; rows are told apart by id and text, so rows of one id, or of none, are decided one by one, but for
decontamination, where all rows of an id go if one of them holds an item; columns other than doc_id, text, source and
n_chars pass as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, near_dup, token_files, toxicity
from lectern.llm.queries import tokenizer_path
from lectern.llm.scratch import keep, ship, table

#: No stage but the mixing can be said in SQL in full: learned scores, signatures and tokenizers are checked by tests.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go: from 0.5 on. Empty texts stay; repeated rows go or stay together."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least id stays, null ids last, ties by the text's hash. Empty texts
    are copies of one another; of repeated rows one stays."""
    ship(spark)
    return near_dup.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's shingles go, by id, those without an id by text. Texts and items of
    fewer than five words match nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row per document and epoch, with the words taken. Null is a source of its own;
    documents of which nothing is taken, empty ones among them, have no row."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids in files of Simple-8b blocks; returns per document what the written files hold, in ascending
    doc_id, null ids first, repeated rows as often as they are."""
    ship(spark)
    return token_files.read_documents(token_files.write_blocks(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", leaks),
    ("mixing", mix),
    ("token-ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

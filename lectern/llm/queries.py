"""The numbered queries of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, knn, licenses, lm, mixing, near_dup, site_style, token_files, toxicity, url_filter, whitening, winnowing
from .scratch import ship, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules and, without one, by its path template."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken_words(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the unigram and the mixed model."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return site_style.main_texts(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("x")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as Simple-8b blocks and read back."""
    return token_files.read_documents(token_files.write_blocks(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's collocations in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses."""
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in (op1_url_filter, op2_decontamination, op3_topk, op4_mixing, op5_lm_scoring, op6_near_dup, op7_html_extraction, op8_toxicity, op9_token_ids, op10_licenses, op11_collocations, op12_fingerprints, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.ORACLE, "op3_topk": knn.ORACLE, "op4_mixing": mixing.ORACLE, "op11_collocations": collocations.ORACLE}

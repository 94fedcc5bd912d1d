"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe as op8
from . import decontaminate as op7
from . import embedding_dedup as op10
from . import html_main as op9
from . import licenses as op5
from . import ngram_join as op1
from . import quality as op3
from . import resampling as op12
from . import substring_dedup as op6
from . import token_counts as op13
from . import toxicity as op4
from . import url_filter as op2
from . import whitening as op11
from .shared import read_table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 4-word shingles with a Jaccard similarity of at least 0.85."""
    return op1.ngram_join(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs judged by rules and, where none fits, by two character language models."""
    return op2.filter_urls(read_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by an additive model with pairs."""
    return op3.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a factorization machine."""
    return op4.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices in all documents."""
    return op5.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that stand in an earlier one."""
    return op6.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return op7.digests(op7.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of all documents and the texts decoded from them, as digests."""
    return op8.tokenize(read_table(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), digests=True)


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return op9.extract_main(read_table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors linked within their label by a cosine of at least 0.93."""
    return op10.near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened on their 32 leading principal components."""
    return op11.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents in a hundred, drawn to be distributed as the benchmark is."""
    return op12.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Number of tokens of all documents."""
    return op13.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary or default_vocabulary())


def default_vocabulary() -> str:
    """The byte-level vocabulary among the public tokenizers of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_url_filter, op3_quality, op4_toxicity, op5_license_scan, op6_substring_dedup, op7_decontamination,
        op8_bpe, op9_html_main, op10_embedding_dedup, op11_whitening, op12_importance_resampling, op13_token_counts,
    )
}
ORACLE_SQL = {"op2_url_filter": op2.ORACLE, "op5_license_scan": op5.ORACLE}

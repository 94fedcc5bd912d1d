"""A training corpus from raw documents: stages that each apply one operator to what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import bpe, decontaminate, quality
from tallyglass.llm.ngram_join import ngram_join
from tallyglass.llm.queries import default_vocabulary
from tallyglass.llm.shared import read_table, row_ids, ship, spread, store
from tallyglass.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier accepts; documents of null go with the empty ones."""
    rows = row_ids(docs, "doc_id")
    scored = quality.classify(rows, read_table(spark, sf_dir, "labels"), keep=("_row",))
    rejected = scored.where("predicted = 0").select("_row")
    return rows.join(spread(rejected), "_row", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles at 0.8.

    Of rows with one id, or none, each is a document of its own; one with an id goes before them.
    """
    ship(spark)
    rows = row_ids(docs, "doc_id")
    linked = ngram_join(rows, id_col="_row", n=5, num=4, den=5)
    copies = linked.where("component_id < doc_id").select(F.col("doc_id").alias("_row"))
    return rows.join(spread(copies), "_row", "left_anti").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document; n_chars follows the text."""
    ship(spark)
    cut = dedup_substrings(docs)
    return cut.withColumn("n_chars", _chars(cut)).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark windows; n_chars follows the text."""
    rows = row_ids(docs, "doc_id")
    found = decontaminate.find_contamination(rows, read_table(spark, sf_dir, "benchmark"), id_col="_row").where("size(starts) > 0")
    spans = found.select(F.col("doc_id").alias("_row"), "starts", "ends")
    joined = rows.join(spread(spans), "_row", "left").select("text", "starts", "ends", "doc_id", "lang", "source", "n_chars")
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("text", "doc_id", "lang", "source", "n_chars"))
    cut = joined.mapInArrow(decontaminate.cut_batches, kinds)
    return cut.withColumn("n_chars", _chars(cut)).select(COLUMNS)


def _chars(docs: DataFrame):
    return F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the text decoded from them."""
    ship(spark)
    return bpe.tokenize(docs, default_vocabulary(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: The stages learn models and cut texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxframe.llm import compression, jaccard, language, packing
from fluxframe.llm.queries import byte_bpe
from fluxframe.session import settle

#: A document stays if its language is this much more likely than the others together.
LEAST_CERTAIN = 0.5
#: Near copies share this percentage of their shingles of so many words; the values of op9 hold for op9 only.
COPY_PERCENT, COPY_WORDS = 80, 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays in doubt.

    Where no row can be learned from, no language is in doubt, and only texts
    without a letter go.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside their compression band.

    NULL and empty texts have no words and go; a row is judged by its text alone,
    so that equal texts stay or go together.
    """
    return compression.judge(docs, carry=True).where("kept").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Repeated rows are copies: one stays. Texts without a word are linked with
    nothing, and rows without a doc_id stay.
    """
    return jaccard.one_of_each(docs, COPY_PERCENT, COPY_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; a NULL or empty text is the closing token alone."""
    return packing.pack(docs, *byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language), ("quality", good_quality), ("near_copies", without_near_copies),
    ("packing", packed)]

#: Models, compression and tokens are beyond SQL; a test runs the stages by plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written before the next one reads it.

    Texts are taken whole, whatever their length. All stages but the last keep
    the columns of documents as they are, whatever their names; an empty table
    stays empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

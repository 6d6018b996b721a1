"""The numbered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxframe.llm import (
    bpe, compression, factorisation, hard_negatives, hnsw, jaccard, language, licences, lm, packing, sharding, simhash,
    spelling,
)
from fluxframe.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function
    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe() -> tuple[str, str]:
    """The vocabulary file and split pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@query()
def op1_compression_bands(spark, folder):
    return compression.judge(read(spark, folder, "documents"))


@query()
def op2_packing(spark, folder):
    return packing.pack(read(spark, folder, "documents"), *byte_bpe())


@query()
def op3_factorisation_machine(spark, folder):
    docs = read(spark, folder, "documents")
    return factorisation.score(docs, factorisation.fit(docs, read(spark, folder, "labels")))


@query()
def op4_small_world_shards(spark, folder):
    return hnsw.nearest(read(spark, folder, "embeddings"))


@query(licences.scan_sql())
def op5_license_digests(spark, folder):
    return licences.scan(read(spark, folder, "documents"), licences.digests(spark))


def word_bpe() -> str:
    """The vocabulary file of the public lower-casing word tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_pair_index_bpe(spark, folder):
    ids = bpe.encode(read(spark, folder, "documents"), word_bpe()).withColumn("ids_sha256", F.sha2("ids", 256))
    texts = bpe.decode(ids, word_bpe())
    return texts.select("doc_id", "n_tokens", "ids_sha256",
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


TREE = sharding.layout(16)
WIDER = sharding.grown(TREE)


@query()
def op7_weighted_tree(spark, folder):
    return sharding.shard_documents(read(spark, folder, "documents"), TREE, WIDER)


@query()
def op8_word_backoff(spark, folder):
    docs = read(spark, folder, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query()
def op9_set_relations(spark, folder):
    return jaccard.components(read(spark, folder, "documents"))


@query()
def op10_cross_entropy_difference(spark, folder):
    """The target are the documents labelled good and not toxic, the background is the whole corpus."""
    good = read(spark, folder, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return lm.cross_entropy_difference(read(spark, folder, "documents"), good)


@query()
def op11_pigeonring(spark, folder):
    return simhash.components(read(spark, folder, "documents"))


@query()
def op12_bit_sliced(spark, folder):
    return spelling.variants(read(spark, folder, "documents"))


@query(hard_negatives.SQL)
def op13_rtree_negatives(spark, folder):
    return hard_negatives.mine(read(spark, folder, "embeddings"))

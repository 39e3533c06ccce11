"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, cover_tree, langid, minhash, oracles, packing, secrets, token_counts, token_files, toxicity, vptree


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.identified(documents.select("doc_id", "text"), langid.trained_on_documents(documents))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.shared_vocabulary(spark, tokenizer("byte_bpe_50k.json"))
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=1.0)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.trained_on_labels(documents, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.shared_vocabulary(spark, tokenizer("byte_bpe_50k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary, limit=1024)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.shared_vocabulary(spark, tokenizer("byte_bpe_50k.json"))
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary, end_id=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.shared_vocabulary(spark, tokenizer("word_bpe_49k.json"))
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary, capacity=4096, end_id=1)


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_secrets that SQL has: everything but the spans of the Markov models."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cover_tree, op2_secrets, op3_language, op4_bpe_codec, op5_vptree, op6_minhash, op7_toxicity, op8_token_counts, op9_token_files, op10_packing, base_spans, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": oracles.OP1, "op5_vptree": oracles.OP5, "op6_minhash": oracles.OP6, "base_spans": oracles.BASE_SPANS}

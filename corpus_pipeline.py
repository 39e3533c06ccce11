"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  Rows with null or empty texts have no toxic word;
the language stage then rejects them, since no language can be told.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escarp.llm import bpe_codec, langid, minhash, packing, secrets, toxicity
from escarp.llm.queries import table, tokenizer
from escarp.llm.store import dropped, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels of these documents, calls toxic go.  Without any
    labelled document, or any toxic one among them, all stay."""
    return toxicity.without(docs, toxicity.trained_on_labels(docs, table(spark, sf_dir, "labels")))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language that the labelled ones teach go."""
    try:
        model = langid.train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    except ValueError:  # nothing is labelled, so nothing can be identified
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of the least id stays."""
    return minhash.deduplicated(docs, words=5, percent=80)


def hidden_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows the text."""
    out = secrets.redacted(docs, secrets.train(secrets.samples(spark)))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences of 4096 as can be."""
    return packing.packed(docs, bpe_codec.shared_vocabulary(spark, tokenizer("word_bpe_49k.json")), capacity=4096, end_id=1)


STAGES = [("toxicity", toxic_documents), ("language", languages), ("near_duplicates", near_duplicates), ("secrets", hidden_secrets), ("packing", packed_sequences)]

#: Classifiers, components and packing are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs

"""Operator 4: byte-pair encoding and decoding of text columns by speculation and verification (see bpe.py)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Coder, Vocabulary

_coders: dict[str, Coder] = {}


def shared_vocabulary(spark: SparkSession, path: str):
    """A broadcast Vocabulary.  Its size is bounded by the file's (some 8 MB for 50,000 tokens)."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def coder(vocabulary) -> Coder:
    """This worker's Coder over a broadcast vocabulary, with the words it has met."""
    v = vocabulary.value
    if v.key not in _coders:
        _coders.clear()
        _coders[v.key] = Coder(v)
    return _coders[v.key]


def rows_of(batch: pa.RecordBatch, vocabulary) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every text in column `text`."""
    for first, ids, counts in coder(vocabulary).encode_column(batch.column("text")):
        end = np.cumsum(counts)
        for i, (a, b) in enumerate(zip((end - counts).tolist(), end.tolist(), strict=True)):
            yield first + i, ids[a:b]


def encode(df: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): every whole text's tokens; a null or empty text has none."""

    def run(batches):
        for batch in batches:
            for first, ids, counts in coder(vocabulary).encode_column(batch.column("text")):
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(counts)), column], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): token ids back to text; null ids give an empty text, ids outside the vocabulary nothing, bytes
    that are no UTF-8 the replacement character."""

    def run(batches):
        pieces = vocabulary.value.bytes
        for batch in batches:
            texts = [decoded(pieces, [i for i in x or () if 0 <= i < len(pieces)]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def decoded(pieces: list[bytes], ids) -> str:
    return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def round_trip(df: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and their ids decoded, in one pass, so that the ids
    of all documents need not leave the worker.  Nulls count as empty texts, repeated ids give repeated rows."""

    def run(batches):
        pieces = vocabulary.value.bytes
        names = [str(i).encode() for i in range(len(pieces))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, ids in rows_of(batch, vocabulary):
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join([names[i] for i in ids])).hexdigest())
                text_sha.append(hashlib.sha256(decoded(pieces, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

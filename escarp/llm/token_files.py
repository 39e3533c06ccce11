"""Operator 9: token ids of whole documents in flat binary files, with 64-bit document offsets.

A data set is a folder of shards.  Shard k has `<name>.ids` (unsigned little-endian integers, 2 bytes each if all ids
fit, else 4), `<name>.offsets` (int64, one more than documents, counted from the shard's start) and `<name>.docs`
(int64 document ids; the first `nulls` documents have none).  `manifest.json` lists the shards in order, each with its
base: how many tokens and documents stand before it, the prefix sums over shards.  Position p of the whole stream is
therefore found by two searches, and shards on a local or mounted disk are memory-mapped; others are read by ranges.

Texts are encoded where they lie, and what is shuffled and sorted are their ids, as bytes in the files' own format.
The number of shards follows the bytes of the texts, and the borders between shards a sample of ids and text hashes, so
that rows that share an id are spread too.  Each task writes files under names of its own and reports them in
its result row, so that of repeated or speculative attempts only the one whose row Spark keeps is in the manifest.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import coder
from .store import cleaned, dropped, new_path, written

#: Bytes of ids that a shard has about, and shards at most (beyond, they grow); documents and ids read at once.
SHARD_BYTES, SHARDS, READ_DOCS, READ_IDS = 16 << 20, 10_000, 20_000, 4 << 20


def file_system(uri: str):
    """(Arrow file system, path) of a folder."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


class Borders:
    """Places of rows (id, tie) among the borders of shards; rows without an id come first."""

    def __init__(self, rows: list[tuple[int | None, int]], shards: int):
        rows = sorted((i is not None, i or 0, t) for i, t in rows)
        picked = sorted({rows[k * len(rows) // shards] for k in range(1, shards)} if rows else set())
        self.keys = [np.array([r[k] for r in picked], dtype=np.int64) for k in range(3)]

    def shard(self, ids: pa.Array, tie: np.ndarray) -> np.ndarray:
        row = [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), tie]
        present, number, hash_ = (np.concatenate((a, b)) for a, b in zip(self.keys, row, strict=True))
        own = np.arange(len(present)) >= len(self.keys[0])
        order = np.lexsort((own, hash_, number, present))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(~own[order])
        return before[len(self.keys[0]) :].astype(np.int32)


def encoded(df: DataFrame, vocabulary, borders, end_id: int | None) -> DataFrame:
    """(shard, id, tie, ids): the ids of every text (id, tie, text) as bytes in the files' format."""
    kind = id_type(vocabulary)

    def run(batches):
        for batch in batches:
            shard = pa.array(borders.value.shard(batch.column("id"), batch.column("tie").to_numpy()))
            for row, ids, counts in coder(vocabulary).encode_column(batch.column("text")):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                ends = np.concatenate(([0], np.cumsum(counts * kind.itemsize))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([*(x.slice(row, len(counts)) for x in (shard, batch.column("id"), batch.column("tie"))), raw], ["shard", "id", "tie", "ids"])

    return df.mapInArrow(run, "shard int, id bigint, tie bigint, ids binary")


def id_type(vocabulary) -> np.dtype:
    return np.dtype("<u4" if vocabulary.value.size > 1 << 16 else "<u2")


def write(df: DataFrame, vocabulary, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Writes the ids of all texts in ascending id order and returns the manifest's shards.

    A null text is empty (it has the end id alone, if there is one); rows without an id come first.  Rows of one id
    are ordered by their text's hash, then their ids.  An empty table gives a manifest without shards."""
    spark, kind = df.sparkSession, id_type(vocabulary)
    schema = "shard int, name string, docs bigint, tokens bigint, nulls bigint"

    def run(batches):
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        now, outs, done = None, {}, [0, 0, 0]

        def closed():
            for out in outs.values():
                out.close()
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "name", "docs", "tokens", "nulls"), (*now, *done), strict=True))], pa.schema([("shard", pa.int32()), ("name", pa.string()), *((x, pa.int64()) for x in ("docs", "tokens", "nulls"))]))

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now is None or now[0] != shards[a]:
                    if now:
                        yield closed()
                    now, done = (int(shards[a]), f"part-{shards[a]:06d}-{uuid4().hex[:12]}"), [0, 0, 0]
                    outs = {x: files.open_output_stream(f"{path}/{now[1]}.{x}") for x in ("ids", "offsets", "docs")}
                    outs["offsets"].write(np.zeros(1, "<i8").tobytes())
                docs, column_ = batch.column("id").slice(a, b - a), batch.column("ids").slice(a, b - a)
                wide = np.int64 if pa.types.is_large_binary(column_.type) else np.int32
                ends = np.frombuffer(column_.buffers()[1], wide)[column_.offset : column_.offset + b - a + 1].astype(np.int64)
                if ends[-1] > ends[0]:
                    outs["ids"].write(memoryview(column_.buffers()[2])[ends[0] : ends[-1]])
                outs["offsets"].write((done[1] + (ends[1:] - ends[0]) // kind.itemsize).astype("<i8").tobytes())
                outs["docs"].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                done = [done[0] + b - a, done[1] + int(ends[-1] - ends[0]) // kind.itemsize, done[2] + docs.null_count]
        if now:
            yield closed()

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("bigint"))).first()
    # Some 2 bytes of ids for each of a text, and at least the end ids.
    shards = min(SHARDS, max(1, -(-((size or 0) + n) // shard_bytes)))
    drawn = rows.select("id", "tie").sample(min(1.0, 50 * shards / max(1, n)), 1) if shards > 1 else rows.select("id", "tie").limit(0)
    borders = spark.sparkContext.broadcast(Borders([tuple(r) for r in drawn.collect()], shards))  # some 50 rows a shard
    dealt = encoded(rows, vocabulary, borders, end_id).repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "tie", "ids").select("shard", "id", "ids")
    report = written(dealt.mapInArrow(run, schema), "shards")
    manifest, docs, tokens = [], 0, 0
    for r in report.orderBy("shard").collect():  # a row for each shard, SHARDS at most
        manifest.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "nulls": r["nulls"], "first_doc": docs, "base": tokens})
        docs, tokens = docs + r["docs"], tokens + r["tokens"]
    dropped(report)
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"ids": kind.str, "tokens": tokens, "docs": docs, "shards": manifest}).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    files, path = file_system(folder)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def column(folder: str, name: str, kind: str, first: int, count: int) -> np.ndarray:
    """So many values of one file of a shard; memory-mapped where it can be, else that range alone is read."""
    files, path = file_system(folder)
    full, size = f"{path}/{name}", np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    if os.path.exists(full):
        return np.memmap(full, dtype=kind, mode="r", offset=first * size, shape=(count,))
    with files.open_input_file(full) as f:
        f.seek(first * size)
        return np.frombuffer(f.read(count * size), kind)


def window(folder: str, start: int, length: int) -> np.ndarray:
    """Tokens start..start+length-1 of the whole stream, across shards (fewer at its end)."""
    manifest = read_manifest(folder)
    found = []
    for s in manifest["shards"]:
        a, b = max(start, s["base"]), min(start + length, s["base"] + s["tokens"])
        if a < b:
            found.append(np.array(column(folder, s["name"] + ".ids", manifest["ids"], a - s["base"], b - a)))
    return np.concatenate(found) if found else np.zeros(0, manifest["ids"])


def documents(folder: str, shard: dict, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, offsets in the shard, ids) of a shard, some documents at a time."""
    at = 0
    while at < shard["docs"]:
        offsets = np.array(column(folder, f"{shard['name']}.offsets", "<i8", at, min(READ_DOCS, shard["docs"] - at) + 1))
        n = max(1, int(np.searchsorted(offsets, offsets[0] + READ_IDS, side="right")) - 1)
        offsets = offsets[: n + 1]
        n = len(offsets) - 1
        docs = np.array(column(folder, f"{shard['name']}.docs", "<i8", at, n))
        yield docs, offsets, column(folder, f"{shard['name']}.ids", kind, int(offsets[0]), int(offsets[-1] - offsets[0]))
        at += n


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, one task for each shard."""
    manifest = read_manifest(folder)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s["name"], s["base"], s["docs"], s["nulls"]) for s in manifest["shards"]], "name string, base bigint, docs bigint, nulls bigint").repartition(len(manifest["shards"]))
    kind = manifest["ids"]

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                at = 0
                for docs, offsets, ids in documents(folder, shard, kind):
                    o = (offsets - offsets[0]).tolist()
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1], o[1:], strict=True)]
                    none = np.arange(at, at + len(docs)) < shard["nulls"]
                    at += len(docs)
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=none), pa.array(shard["base"] + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, schema)


@cleaned
def round_trip(df: DataFrame, vocabulary, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files written to a folder of their own in the shared folder, and read back; the folder goes afterwards."""
    folder = new_path(df.sparkSession, "tokens")
    write(df, vocabulary, folder, end_id, id_col, text_col)
    return read(df.sparkSession, folder)

"""Operator 10: packing of documents into sequences of at most `capacity` tokens.

Which lengths go together is decided on the histogram of lengths alone, whose size is bounded by the capacity however
many documents there are:

1. Configuration LP: as few sequences as possible, so many of each *configuration* (a multiset of lengths that fits)
   that every length's demand is covered.  Every length is a class of its own.
2. Multiplicative weights: a length's weight falls exponentially with the share of its demand that is covered; each
   round adds the configuration of the largest total weight, found by knapsack dynamic programming.  The average of
   the rounds, scaled so that half the covered lengths' demands are met, is nearly a fractional solution; the average
   of the weights, scaled so that no configuration is worth more than 1, is a solution of the dual, and so its worth a
   bound that no packing beats; sizes themselves and rounded sizes are tried as prices too.
3. Rounding: configurations are used a whole number of times, as far as lengths are left, and what is left goes,
   longest first, to the open sequence with the least room that suffices, or a new one.  This too works on groups of
   equal sequences, not on single documents.
4. Where the rounded plan needs more sequences than best fit on the whole histogram does, that one is used.

Documents are then dealt to the places by their rank among those of equal length.  Ranks are counted in hash buckets,
so that a length that a third of all documents share is spread over all tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import coder
from .store import cleaned, written


#: Rounds of the weights, the share of a demand that one covers at most, and the least worth of a configuration beside
#: the best.
ROUNDS, SHARE, GOOD = 500, 0.25, 0.97


def pieces(df: DataFrame, vocabulary, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids with the end id; only longer ones than `capacity`
    are cut.  A null text is empty; a document without ids has no piece."""

    def run(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for first, ids, counts in coder(vocabulary).encode_column(batch.column("text")):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                raw, end = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                for i, (a, b) in enumerate(zip((end - counts).tolist(), end.tolist(), strict=True)):
                    for k, x in enumerate(range(a, b, capacity)):
                        y = min(b, x + capacity)
                        for column, value in zip(rows, (first + i, k, x - a, y - x, zlib.crc32(raw[4 * x : 4 * y])), strict=True):
                            column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[0], pa.int32())), *(pa.array(x, k) for x, k in zip(rows[1:], (kinds[0], kinds[1], kinds[2], kinds[3]), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of sizes (index: copies) of the largest total value that fits, by dynamic programming.

    Sizes ascend.  Only sizes worth more than every smaller one can be needed; each is offered 1, 2, 4, ... times."""
    before = np.concatenate(([0.0], np.maximum.accumulate(values)[:-1]))
    best, offers = np.zeros(capacity + 1), []
    for k in np.flatnonzero(values > before).tolist():
        copies = 1
        while copies * sizes[k] <= capacity:
            w = int(copies * sizes[k])
            total = best[:-w] + copies * values[k]
            better = total > best[w:]
            best[w:][better] = total[better]
            offers.append((k, copies, w, better))
            copies *= 2
    out: dict[int, int] = {}
    c = int(best.argmax())
    for k, copies, w, better in reversed(offers):
        if c >= w and better[c - w]:
            out[k] = out.get(k, 0) + copies
            c -= w
    return out


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """((uses, configuration) of the LP by multiplicative weights, the dual's bound); `sizes` ascend.

    Configurations that the average weights, as prices of the dual, show to be poor are left out, and fuller ones come
    first."""
    covered, uses, prices = np.zeros(len(sizes)), {}, np.zeros(len(sizes))
    for _ in range(rounds):
        weights = np.exp(-rate * (covered - covered.min())) / demand
        shape = knapsack(sizes, weights, capacity)
        value = sum(weights[k] * a for k, a in shape.items())
        prices += weights / value
        step = SHARE * min(demand[k] / a for k, a in shape.items())
        for k, a in shape.items():
            covered[k] += step * a / demand[k]
        key = tuple(sorted(shape.items()))
        uses[key] = uses.get(key, 0.0) + step
    bound = 0.0
    steps = [np.where((k + 1) * sizes % capacity == 0, sizes / capacity, (k + 1) * sizes // capacity / k) for k in range(1, 11)]
    for price in (prices, sizes / capacity, *steps):
        dear = knapsack(sizes, price, capacity)
        bound = max(bound, float(price @ demand) / max(sum(price[k] * a for k, a in dear.items()), 1e-300))
    worth = {key: sum(prices[k] * a for k, a in key) for key in uses}
    best = max(worth.values(), default=0.0)
    good = [key for key in uses if worth[key] >= GOOD * best]
    covers = np.zeros(len(sizes))
    for key in good:
        for k, a in key:
            covers[k] += uses[key] * a / demand[k]
    scale = float(np.median(covers[covers > 0])) if good else 1.0
    good.sort(key=lambda key: (-sum(sizes[k] * a for k, a in key), -worth[key], key))
    return [(uses[key] / scale, dict(key)) for key in good], bound


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = 2.0) -> tuple[list[tuple[int, list[int]]], int]:
    """((how many sequences, the lengths in each), a bound): groups that hold every length of the histogram as often
    as it occurs, never more sequences than best fit needs, and the least number that any packing needs."""
    left = {x: n for x, n in histogram.items() if n > 0}
    assert all(0 < x <= capacity for x in left)
    if not left:
        return [], 0
    plain = best_fit([], dict(left), capacity)
    lengths = sorted(left)
    sizes, demand = np.array(lengths, dtype=np.int64), np.array([left[x] for x in lengths], dtype=float)
    found, bound = fractional(sizes, demand, capacity, rounds, rate)
    groups: list[tuple[int, list[int]]] = []
    for uses, shape in found:
        times = min([int(uses + 0.5), *(left[lengths[k]] // copies for k, copies in shape.items())])
        if times > 0:
            for k, copies in shape.items():
                left[lengths[k]] -= copies * times
            groups.append((times, [lengths[k] for k, copies in shape.items() for _ in range(copies)]))
    groups = best_fit(groups, left, capacity)
    if sequences(plain) < sequences(groups):
        groups = plain
    return groups, max(1, int(np.ceil(bound * (1 - 1e-9) - 1e-6)))


def sequences(groups: list[tuple[int, list[int]]]) -> int:
    return sum(times for times, _ in groups)


def best_fit(groups: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Adds what is left, longest first, each to the groups with the least room that suffices."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms = 0  # bit r is set if some group has room r
    for times, filled in groups:
        room = capacity - sum(filled)
        by_room.setdefault(room, []).append((times, filled))
        rooms |= 1 << room
    for x in sorted(left, reverse=True):
        n = left[x]
        while n > 0:
            fitting = rooms >> x
            if fitting:
                room = x + (fitting & -fitting).bit_length() - 1
                times, filled = by_room[room].pop()
                used, copies = min(times, n), 1
                if n >= times:  # as many copies in each as fit and are there
                    copies = max(1, min(room // x, n // times))
                if times > used:
                    by_room[room].append((times - used, filled))
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                copies = min(capacity // x, n)
                used, filled, room = max(1, n // copies), [], capacity
            n -= used * copies
            room -= copies * x
            by_room.setdefault(room, []).append((used, filled + [x] * copies))
            rooms |= 1 << room
    return [g for room in sorted(by_room) for g in by_room[room]]


class Places:
    """Where the r-th document of a length goes: arrays over (length, rank) runs, found by one binary search.

    Runs are bounded by the configurations times the lengths in one, not by the documents."""

    def __init__(self, groups: list[tuple[int, list[int]]]):
        rows, used, sequence = [], {}, 0
        for times, filled in groups:
            offset = 0
            for x in sorted(set(filled), reverse=True):
                copies = filled.count(x)
                rank = used.get(x, 0)
                rows.append((x, rank, sequence, copies, offset))
                used[x] = rank + copies * times
                offset += copies * x
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.rank, self.sequence, self.copies, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))
        self.key = self.length << 48 | self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        k = rank - self.rank[run]
        return self.sequence[run] + k // self.copies[run], self.offset[run] + k % self.copies[run] * length


#: Documents of one length and bucket are ranked by one task.
BUCKET_ROWS = 10_000_000


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with (doc_id, piece, length); `cut` is read three times."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)[0]))
    buckets = max(1024, sum(histogram.values()) // BUCKET_ROWS)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(within)).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    columns = cut.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(x).to_numpy().astype(np.int64) for x in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


@cleaned
def packed(df: DataFrame, vocabulary, capacity: int, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document's pieces.  Equal rows are
    packed as often as they occur; an empty table gives no row."""
    return pack(written(pieces(df, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)

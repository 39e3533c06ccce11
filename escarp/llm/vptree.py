"""Operator 5: approximate nearest neighbours with vantage-point trees, one for each shard; exact at factor 1.

Nearness is the inner product.  Vectors get one more component, the root of the largest squared norm less their own,
and queries a zero; then the Euclidean order from a query is the order of inner products, and the triangle inequality
holds.  A node keeps a vantage point and the median distance to it, and a subtree is pruned for a query if
factor * (distance to the median sphere) exceeds the distance of its k-th best so far: factor 1 loses nothing, larger
factors visit less.  All queries of a block walk a tree together.

Shards are the leaves of one tree over a bounded sample, which every row descends; a crowded leaf is cut by a hash of
the id.  A query first searches the leaf that it would be in.  The distance of its k-th best there bounds its second
descent, which visits only the leaves whose shells it meets.

Where components are huge or tiny, all vectors are divided by one power of two, which keeps sums of squares finite and
changes no rounding.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cleaned, written
from .vectors import matrix, usable

#: Rows of a shard, rows of a tree's leaf, queries of a block, rows of the sample from which shards are made.
SHARD, LEAF, BLOCK, SAMPLE = 8192, 256, 8192, 20_000


class VantageTree:
    """Nodes are (place of the vantage point, median distance, inner, outer), leaves arrays of places."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaves: list[np.ndarray] = []
        self.root = self.build(np.arange(len(points)), 0, leaf)

    def build(self, rows: np.ndarray, vantage: int, leaf: int):
        if len(rows) > leaf:
            d = np.sqrt(((self.points[rows] - self.points[rows[vantage]]) ** 2).sum(axis=1))
            middle = float(np.median(d))
            inside = d <= middle
            if not inside.all():  # else too many at one distance to be told apart
                inner, outer = rows[inside], rows[~inside]
                # The next vantage points are far from this one.
                return int(rows[vantage]), middle, self.build(inner, int(d[inside].argmax()), leaf), self.build(outer, int(d[~inside].argmax()), leaf)
        self.leaves.append(rows)
        return len(self.leaves) - 1


class Search:
    """The k best of one tree's points for many queries; `ids` of points that equal a query's are left out, and points
    below a query's `least` score may be."""

    def __init__(self, tree: VantageTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, factor: float):
        self.tree, self.vectors, self.ids, self.queries, self.own, self.least, self.k, self.factor = tree, vectors, ids, queries, own, least, k, factor
        n = len(queries)
        self.extended = extended(queries, None)
        self.largest = float((tree.points**2).sum(axis=1).max(initial=0))
        self.norms = (queries**2).sum(axis=1)
        self.score, self.best = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.visit(tree.root, np.arange(n))

    def worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.least[q])

    def visit(self, node, q: np.ndarray) -> None:
        if not q.size:
            return
        if not isinstance(node, tuple):
            self.scan(self.tree.leaves[node], q)
            return
        vantage, middle, inner, outer = node
        d = np.sqrt(((self.extended[q] - self.tree.points[vantage]) ** 2).sum(axis=1))
        into = d <= middle
        self.visit(inner, q[into])
        self.visit(outer, q[~into])
        go = meets(d, middle, reach(self.largest, self.norms[q], self.worst(q)), self.factor)
        self.visit(outer, q[into & go])
        self.visit(inner, q[~into & go])

    def scan(self, rows: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(q), 1024):
            part = q[a : a + 1024]
            rough = self.queries[part] @ self.vectors[rows].T
            worst = self.worst(part)
            slack = 1e-9 * (1 + np.abs(worst))
            slack[~np.isfinite(slack)] = 0
            x, y = np.nonzero(rough >= (worst - slack)[:, None])
            keep = self.ids[rows[y]] != self.own[part[x]]
            x, y = x[keep], y[keep]
            # Decided by a product whose order of summation is the same for every pair, so that equal vectors tie.
            exact = (self.queries[part[x]] * self.vectors[rows[y]]).sum(axis=1)
            k, n = self.k, len(part)
            who = np.concatenate((np.repeat(np.arange(n), k), x))
            score = np.concatenate((self.score[part].ravel(), exact))
            ids = np.concatenate((self.best[part].ravel(), self.ids[rows[y]]))
            order = np.lexsort((ids, -score, who))
            first = np.searchsorted(who[order], np.arange(n))
            take = order[(first[:, None] + np.arange(k)).ravel()]
            self.score[part], self.best[part] = score[take].reshape(n, k), ids[take].reshape(n, k)


def extended(vectors: np.ndarray, largest: float | None) -> np.ndarray:
    """Rows with the component that makes all their norms the largest; queries (None) get a zero."""
    more = np.zeros(len(vectors)) if largest is None else np.sqrt(np.maximum(0, largest - (vectors**2).sum(axis=1)))
    return np.hstack([vectors, more[:, None]])


def reach(largest: float, norms: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The distance from a query at which a row has that score."""
    return np.sqrt(np.maximum(0, largest + norms - 2 * score))


def meets(d: np.ndarray, middle: float, bound: np.ndarray, factor: float) -> np.ndarray:
    """Whether balls of radius `bound`, relaxed by the factor, meet the sphere that they are not within."""
    return factor * np.abs(d - middle) - 1e-9 * (1 + middle) <= bound


class Shards:
    """The leaves of a tree over sampled rows of one length."""

    def __init__(self, sample: np.ndarray, largest: float, leaves: int):
        self.largest = largest
        self.tree = VantageTree(extended(sample, largest), max(1, -(-len(sample) // leaves)))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each extended point descends to."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.tree.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, tuple):
                out[rows] = node
            elif rows.size:
                vantage, middle, inner, outer = node
                into = np.sqrt(((points[rows] - self.tree.points[vantage]) ** 2).sum(axis=1)) <= middle
                todo += [(inner, rows[into]), (outer, rows[~into])]
        return out

    def met(self, queries: np.ndarray, score: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves that may hold a row with at least that score."""
        points = extended(queries, None)
        bound = reach(self.largest, (queries**2).sum(axis=1), score)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(self.tree.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, tuple):
                found.append((rows, np.full(len(rows), node, np.int32)))
            elif rows.size:
                vantage, middle, inner, outer = node
                d = np.sqrt(((points[rows] - self.tree.points[vantage]) ** 2).sum(axis=1))
                go = meets(d, middle, bound[rows], factor)
                todo += [(inner, rows[(d <= middle) | go]), (outer, rows[(d > middle) | go])]
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


ROWS = "vec_id bigint, dim int, x array<double>"


@cleaned
def nearest(df: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, ties to the smaller id.

    `df` and `queries` have (vec_id, embedding).  A query's own id is no candidate.  Vectors that are null, zero or
    hold null or non-finite components, or have no id, take no part; candidates of other lengths than the query's
    aren't compared with it.  Equal rows count once; of queries that share an id the least vector counts.  Queries
    without candidates have no row.  A score beyond the range of doubles is infinite, its rank right nevertheless; in
    a table with components beyond 2**500, products of components below 2**-300 count as zero."""
    spark = df.sparkSession
    clean = lambda x: x.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("x"))
    top = max([r[0] or 0.0 for x in (df, queries) for r in clean(x).agg(F.max(F.array_max(F.transform("x", F.abs)))).collect()])
    size = math.frexp(top)[1]
    unit = 2.0 ** (max(0, size - 500) + min(0, size + 500))
    scaled = lambda x: clean(x).withColumn("x", F.transform("x", lambda v: v / F.lit(unit)))
    rows = written(scaled(df).distinct(), "vectors")
    asked = written(scaled(queries).groupBy("vec_id").agg(F.min(F.struct("x", "dim")).alias("v")).select("vec_id", "v.dim", "v.x"), "queries")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    n, largest = rows.agg(F.count("*"), F.max(square)).first()
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("vec_id").limit(2 * sample).toArrow()  # the sample
    dims, made = picked.column("dim").to_numpy(), {}
    for dim in np.unique(dims).tolist():
        x = matrix(picked.column("x").take(pa.array(np.flatnonzero(dims == dim))))
        made[dim] = Shards(x, largest, max(1, int(len(x) / share) // shard))
    shards = spark.sparkContext.broadcast(made)  # bounded by the sample

    def place(batches, asks: bool):
        for batch in batches:
            dim, leaf = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in set(dim.tolist()) & set(shards.value):
                at = np.flatnonzero(dim == d)
                leaf[at] = shards.value[d].home(extended(matrix(batch.column("x").take(pa.array(at))), None if asks else largest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "dim", "x", "leaf"])

    placed = written(rows.mapInArrow(lambda b: place(b, False), ROWS + ", leaf int"), "placed")
    parts = written(placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("parts")), "parts")
    placed = placed.join(parts, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int")).drop("parts")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        asks, ids, x, least = table.column("asks").to_numpy(zero_copy_only=False), table.column("vec_id").to_numpy(), matrix(table.column("x")), table.column("least").to_numpy()
        v = x[~asks]
        longer = extended(v, float((v**2).sum(axis=1).max(initial=0)))
        found = Search(VantageTree(longer), v, ids[~asks], x[asks], ids[asks], least[asks], k, factor)
        real = np.isfinite(found.score)
        who = np.repeat(ids[asks], real.sum(axis=1))
        return pa.table({"query_id": who, "vec_id": found.best[real], "score": found.score[real]})

    def searched(pairs: DataFrame) -> DataFrame:
        """The best rows of each (query, leaf, part)."""
        key = ["dim", "leaf", "part"]
        blocks = pairs.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        left = placed.join(blocks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "vec_id", "x", F.lit(0.0).alias("least"))
        right = pairs.join(blocks, key).select(*key, F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"), "vec_id", "x", "least")
        return left.union(right).groupBy(*key, "block").applyInArrow(search, "query_id bigint, vec_id bigint, score double")

    homes = asked.mapInArrow(lambda b: place(b, True), ROWS + ", leaf int").withColumn("part", F.lit(0)).withColumn("least", F.lit(float("-inf")))
    homes = written(homes, "homes")
    first = written(searched(homes), "first")
    full = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    known = asked.join(full.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def route(batches):
        for batch in batches:
            dim, least = batch.column("dim").to_numpy(), batch.column("least").to_numpy()
            for d in set(dim.tolist()):
                at = np.flatnonzero(dim == d)
                x = batch.column("x").take(pa.array(at))
                who, leaf = shards.value[d].met(matrix(x), least[at], factor) if d in shards.value else (np.arange(len(at)), np.zeros(len(at), np.int32))
                for a in range(0, len(who), 10_000):
                    w, f = who[a : a + 10_000], leaf[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at[w])), pa.array(np.full(len(w), d, np.int32)), pa.array(f), pa.array(least[at[w]])], ["vec_id", "dim", "leaf", "least"])

    met = known.select("vec_id", "dim", "x", "least").mapInArrow(route, "vec_id bigint, dim int, leaf int, least double")
    met = met.join(parts, ["dim", "leaf"]).select("vec_id", "dim", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "least")
    done = homes.select("vec_id", "dim", "leaf", "part")
    rest = written(met.join(done, ["vec_id", "dim", "leaf", "part"], "left_anti"), "met")
    second = searched(rest.join(asked.select("vec_id", "x"), "vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = first.union(second).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", (F.col("score") * F.lit(unit) * F.lit(unit)).alias("score"))

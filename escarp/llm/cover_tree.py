"""Operator 1: near-duplicate embeddings by dual traversal of cover trees, exact.

Unit vectors of one label are cut into blocks.  Where a label has more rows than a block holds, its blocks follow
pivots, a net over a bounded sample, so that a block is a ball with a centre and a covering radius; a crowded ball is
cut further by a hash of the id.  The blocks are the top level of the trees: pairs of blocks never meet whose centres
are further apart than both radii and the limit.  For each pair that remains, a task builds a cover tree over either block (levels of
halving radii, each node with its covering radius) and walks both: a pair of nodes is dropped if the distance of the
centres exceeds the radii plus the limit, counted as a whole if the centres' distance plus the radii is within it,
else its children are paired, all by all in one matrix product.  Only pairs of single points are decided by the cosine.

Links are never listed: a task returns, for each vector, how many links it has in that pair of blocks, and a forest
that connects what links.  Any number of pairs of distinct labels costs nothing.  What is quadratic, as in every exact
method, are vectors that lie so evenly that no ball is far from any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, joined
from .store import cleaned, written
from .vectors import matrix, usable

#: Rows that a block holds about, rows of the sample from which pivots are chosen, rows compared with all pivots at once.
BLOCK, SAMPLE, ASSIGNED = 1024, 20_000, 256
#: Bounds are used with this slack, so that rounding never decides; cosines decide alone.
SLACK = 1e-6


class CoverTree:
    """Nested levels over unit vectors: every node covers its points within half its parent's radius."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        todo = [(self.add(0, np.arange(len(points))), 2.0)]
        while todo:
            node, reach = todo.pop()
            if self.radius[node] == 0:
                continue  # one point, or copies of one
            while reach >= self.radius[node]:
                reach /= 2
            kids, left = [], self.members[node]
            centre = self.centre[node]
            while left.size:
                near = distances(points[centre : centre + 1], points[left])[0] <= reach
                near |= left == centre
                kids.append(self.add(centre, left[near]))
                left = left[~near]
                centre = int(left[0]) if left.size else -1
            self.children[node] = np.array(kids)
            todo += [(k, reach) for k in kids]

    def add(self, centre: int, members: np.ndarray) -> int:
        far = np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1)).max()
        self.centre.append(centre)
        self.radius.append(float(far))
        self.members.append(members)
        self.children.append(None)
        return len(self.centre) - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def walk(a: CoverTree, b: CoverTree, cosine: float, same: bool):
    """(links of each point of a, of each of b, pairs of positions that connect what links; those of b come after a's).
    With `same`, b is a, and no point links with itself."""
    limit = np.sqrt(2 - 2 * cosine)
    count_a, count_b = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64)
    shift = 0 if same else len(a.points)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    whole: set[tuple[bool, int]] = set()

    def connect(tree: CoverTree, node: int, right: bool) -> None:
        if (right, node) not in whole:
            whole.add((right, node))
            at = shift * right
            edges.append((tree.members[node] + at, np.full(len(tree.members[node]), tree.centre[node] + at)))

    radius_a, radius_b = np.array(a.radius), np.array(b.radius)
    centre_a, centre_b = np.array(a.centre), np.array(b.centre)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        left = a.children[i] if a.children[i] is not None else np.array([i])
        right = b.children[j] if b.children[j] is not None else np.array([j])
        x, y = a.points[centre_a[left]], b.points[centre_b[right]]
        dot = x @ y.T
        far = np.sqrt(np.maximum(0, 2 - 2 * dot))
        reach = radius_a[left][:, None] + radius_b[right][None, :]
        single = reach == 0
        rows, cols = np.nonzero(np.where(single, far <= limit + SLACK, far <= reach + limit + SLACK))
        for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
            m, n = int(left[r]), int(right[c])
            if single[r, c]:
                own = same and m == n
                if own or float((x[r] * y[c]).sum()) >= cosine:
                    hit = True
                else:
                    continue
            else:
                own = same and m == n
                hit = far[r, c] + reach[r, c] <= limit - SLACK
            if not hit:
                todo.append((m, n))
                continue
            count_a[a.members[m]] += len(b.members[n]) - own
            if not same:
                count_b[b.members[n]] += len(a.members[m])
            connect(a, m, False)
            connect(b, n, not same)
            edges.append((np.array([a.centre[m]]), np.array([b.centre[n] + shift])))
    return count_a, count_b, edges


def pivots_of(rows: DataFrame, counts: dict, block: int, sample: int) -> dict:
    """Pivots of the large groups: a net (farthest first) over each one's share of the sample."""
    if not counts:
        return {}
    share = min(1.0, sample / sum(counts.values()))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    names = rows.sparkSession.createDataFrame([(*k,) for k in counts], "label string, dim int")
    sampled = picked.join(F.broadcast(names), ["label", "dim"]).select("label", "dim", "vec_id", "unit").orderBy("vec_id").limit(2 * sample).toArrow()
    by, out = {}, {}
    for i, key in enumerate(zip(sampled.column("label").to_pylist(), sampled.column("dim").to_pylist(), strict=True)):
        by.setdefault(key, []).append(i)
    for key, at in by.items():
        x = matrix(sampled.column("unit").take(pa.array(at)))
        chosen, least = [0], distances(x[:1], x)[0]
        while len(chosen) < min(len(x), -(-counts[key] // block)) and least.max() > 0:
            chosen.append(int(least.argmax()))
            least = np.minimum(least, distances(x[chosen[-1:]], x)[0])
        out[key] = x[chosen]
    return out


@cleaned
def near_duplicates(df: DataFrame, cosine: float = 0.98, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine is at least `cosine`; vectors that are null,
    zero or hold null or non-finite components, vectors of other lengths and rows without an id link with nothing.
    Rows that share an id are one vertex: their links add up."""
    spark = df.sparkSession
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rows = df.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    # Scaled by the largest component first: squares neither overflow nor vanish.
    rows = rows.withColumn("top", F.array_max(F.transform("x", F.abs))).withColumn("x", F.transform("x", lambda v: v / F.col("top"))).withColumn("norm", norm)
    units = written(rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda v: v / F.col("norm")).alias("unit")), "units")
    # Groups too small for a row of the sample have no pivots; so `sample` groups at most are collected.
    least = max(block, units.count() // sample)
    counts = {(r["label"], r["dim"]): r["n"] for r in units.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()}
    pivots = spark.sparkContext.broadcast(pivots_of(units, counts, block, sample))

    def assign(batches):
        for batch in batches:
            label, dim = np.array(batch.column("label").to_pylist(), dtype=object), batch.column("dim").to_numpy()
            cell, far = np.zeros(len(label), np.int32), np.full(len(label), 2.0)
            for key in set(zip(label.tolist(), dim.tolist(), strict=True)) & set(pivots.value):
                every = np.flatnonzero((label == key[0]) & (dim == key[1]))
                for at in np.split(every, range(ASSIGNED, len(every), ASSIGNED)):
                    d = distances(matrix(batch.column("unit").take(pa.array(at))), pivots.value[key])
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "dim", "unit")] + [pa.array(cell), pa.array(far)], ["vec_id", "label", "dim", "unit", "cell", "far"])

    celled = written(units.mapInArrow(assign, "vec_id bigint, label string, dim int, unit array<double>, cell int, far double"), "cells")
    sizes = celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    parts = written(sizes.select("label", "dim", "cell", "radius", F.ceil(F.col("n") / block).cast("int").alias("parts")), "parts")
    radii = {key: np.zeros(len(x)) for key, x in pivots.value.items()}
    for r in parts.where(F.col("radius") < 2.0).select("label", "dim", "cell", "radius").toLocalIterator():  # a row for each pivot
        if (r["label"], r["dim"]) in radii:
            radii[r["label"], r["dim"]][r["cell"]] = r["radius"]
    kept = written(parts.mapInArrow(lambda batches: near_cells(batches, pivots, radii, cosine), "label string, dim int, cell int, parts int, other int"), "near")
    other = parts.select("label", "dim", F.col("cell").alias("other"), F.col("parts").alias("other_parts"))
    near = kept.join(other, ["label", "dim", "other"])
    # A pair of blocks is named by its two blocks; each block goes to every pair that it is in.
    left = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    right = F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))
    pairs = near.select("*", left.alias("part")).select("*", right.alias("other_part")).where("cell < other or part <= other_part")
    pairs = pairs.select("label", "dim", F.struct("cell", "part").alias("p"), F.struct(F.col("other").alias("cell"), F.col("other_part").alias("part")).alias("q"))
    name = F.concat_ws(":", "label", "dim", "p.cell", "p.part", "q.cell", "q.part")
    pairs = pairs.withColumn("pair", name)
    ends = pairs.select("pair", "label", "dim", "p.*", F.lit(0).alias("side")).union(pairs.where("p <> q").select("pair", "label", "dim", "q.*", F.lit(1).alias("side")))
    ends = written(ends, "pairs")
    placed = celled.join(parts.select("label", "dim", "cell", "parts"), ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    met = placed.select("label", "dim", "cell", "part", "vec_id", "unit").join(ends, ["label", "dim", "cell", "part"]).select("pair", "side", "vec_id", "unit")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("vec_id", "ascending")])
        ids, side, x = table.column("vec_id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("unit"))
        n = int((side == 0).sum())
        same = n == len(ids)
        a = CoverTree(x[:n])
        b = a if same else CoverTree(x[n:])
        count_a, count_b, edges = walk(a, b, cosine, same) if n else (np.zeros(0), np.zeros(len(ids)), [])
        links = count_a if same else np.concatenate((count_a, count_b))
        root = np.arange(len(ids))
        if edges:
            v, least = joined(*(np.concatenate([e[i] for e in edges]) for i in (0, 1)))
            root[v] = least
        keep = links > 0
        return pa.table({"vec_id": ids[keep], "links": links[keep].astype(np.int64), "root": ids[root][keep]})

    found = written(met.groupBy("pair").applyInArrow(meet, "vec_id bigint, links bigint, root bigint"), "links")
    links = written(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "counts")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    every = df.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = every.join(links, "vec_id", "left").join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def near_cells(batches, pivots, radii: dict, cosine: float):
    """For each cell, the cells from itself on that its ball may link with."""
    limit = np.sqrt(2 - 2 * cosine)
    for batch in batches:
        rows = []
        for label, dim, cell, parts, radius in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cell", "parts", "radius")), strict=True):
            centres = pivots.value.get((label, dim))
            others = [cell]
            if centres is not None:
                # A vector of the other cell is nearer to that cell's pivot than to this one.
                d = distances(centres[cell : cell + 1], centres)[0]
                near = (d / 2 <= radius + limit + SLACK) & (d <= radius + radii[label, dim] + limit + SLACK)
                others += [k for k in np.flatnonzero(near).tolist() if k > cell]
            rows += [(label, dim, cell, parts, k) for k in others]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["label", "dim", "cell", "parts", "other"])

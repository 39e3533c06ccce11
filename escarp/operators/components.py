"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cleaned, dropped, written

#: With at most so many links left, one task joins them; more are contracted by all tasks.
ONE_TASK = 100_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of some links."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(ids))
    x, y = ends[: len(a)], ends[len(a) :]
    while x.size:
        low = np.minimum(x, y)
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new != new[new]).any():
            new = new[new]
        root = new[root]
        x, y = new[x], new[y]
        go = x != y
        x, y = x[go], y[go]
    return ids, ids[root]


def in_tasks(links: DataFrame) -> DataFrame:
    """Each task's own forest of its links, as stars around the least vertex; connects what the links connect."""

    def run(batches):
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = joined(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint")


@cleaned
def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the least id that links (a, b) of bigints reach, for every id in them; both ways, nulls and
    loops dropped.

    Rounds of contraction: each vertex takes the first of its neighbours and itself (by id and by hash in turn, so
    that stars and long paths both shrink fast), links are renamed by it, and loops and repeats go.  Aggregations
    combine before they shuffle, and joins on a vertex with very many links can be split by the planner."""
    spark = links.sparkSession
    left = written(in_tasks(links.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))), "links")
    found, turn = None, 0
    while (n := left.count()) > one_task:
        key = F.struct(F.xxhash64("p") if turn % 2 else F.lit(0), "p")
        ends = [left.select(F.col(x).alias("id"), F.col(y).alias("p")) for x, y in ("ab", "ba", "aa", "bb")]
        both = ends[0].union(ends[1]).union(ends[2]).union(ends[3])
        step = written(both.groupBy("id").agg(F.min(key)["p"].alias("p")), "step")
        renamed = left.join(step.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        next_left = written(in_tasks(renamed.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()), "links")
        before, found = found, follow(found, step)
        dropped(left, *([before, step] if before is not None else []))
        left, turn = next_left, turn + 1
    if n:
        last = in_tasks(left.coalesce(1)).select(F.col("a").alias("id"), F.col("b").alias("p"))
        last = written(last, "last")
        last = written(last.union(last.select(F.col("p").alias("id"), "p").distinct()), "step")
    else:
        last = spark.createDataFrame([], "id bigint, p bigint")
    found = follow(found, last)
    least = found.groupBy("p").agg(F.min("id").alias("component"))
    return found.join(least, "p").select("id", "component")


def follow(found: DataFrame | None, step: DataFrame) -> DataFrame:
    """Where every vertex stands after one more step."""
    if found is None:
        return step
    then = step.select(F.col("id").alias("p"), F.col("p").alias("q"))
    return written(found.join(then, "p", "left").select("id", F.coalesce("q", "p").alias("p")), "found")

"""The road graph: node degrees, links between ways, and chains of linked ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cleaned
from .components import components


def node_degrees(ways: DataFrame) -> DataFrame:
    """(node_id, degree): how often ways refer to each node; every occurrence counts."""
    return ways.select(F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count("*").cast("int").alias("degree"))


def with_degrees(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    degrees = node_degrees(ways).withColumnRenamed("node_id", "id")
    return nodes.drop("degree").join(degrees, "id", "left")


def degree_histogram(degrees: DataFrame) -> DataFrame:
    return degrees.where("degree is not null").groupBy("degree").agg(F.count("*").alias("n_nodes"))


def endpoints(ways: DataFrame) -> DataFrame:
    """(id, highway, node_id): two rows for each way, both its own if it closes."""
    ends = F.explode(F.array(F.get("nodes", F.lit(0)), F.try_element_at("nodes", F.lit(-1))))
    return ways.select("id", "highway", ends.alias("node_id")).where("node_id is not null")


def link_nodes(ways: DataFrame) -> DataFrame:
    """(node_id, highway) at which exactly two ends of ways of that highway meet."""
    return endpoints(ways).groupBy("node_id", "highway").agg(F.count("*").alias("ends")).where("ends = 2").select("node_id", "highway")


def chain_edges(ways: DataFrame) -> DataFrame:
    """(a, b) with a < b: ways that follow one another.  One aggregation instead of a join of ends with ends."""
    at = endpoints(ways).groupBy("node_id", "highway").agg(F.count("*").alias("ends"), F.min("id").alias("a"), F.max("id").alias("b"))
    return at.where("ends = 2 and a < b").select("a", "b").distinct()


@cleaned
def chain_labels(ways: DataFrame) -> DataFrame:
    """(id, chain_id): the least way id of each way's chain."""
    labels = components(chain_edges(ways))
    return ways.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("chain_id"))


def chain_info(labels: DataFrame) -> DataFrame:
    """(n_ways, n_chains): how many chains have so many ways."""
    return labels.groupBy("chain_id").agg(F.count("*").alias("n_ways")).groupBy("n_ways").agg(F.count("*").alias("n_chains"))


def walk(ids: list[int], nodes: list[list[int]]) -> list[int]:
    """The places of a chain's ways in riding order: from the least way with an end that no other way has, away from
    that end, else (a cycle) from the least way by its last node, along shared ends."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    at: dict[int, list[int]] = {}
    for i in order:
        for end in {nodes[i][0], nodes[i][-1]}:
            at.setdefault(end, []).append(i)
    now, leave = order[0], nodes[order[0]][-1]
    for i in order:
        first, last = nodes[i][0], nodes[i][-1]
        if len(at[first]) == 1 or len(at[last]) == 1:
            now, leave = i, last if len(at[first]) == 1 else first
            break
    out, seen = [now], {now}
    while (now := next((j for j in at[leave] if j not in seen), None)) is not None:
        out.append(now)
        seen.add(now)
        leave = nodes[now][-1] if nodes[now][0] == leave else nodes[now][0]
    return out


def path(order: list[int], nodes: list[list[int]]) -> list[tuple[int, int]] | None:
    """(place of the way, node) along a walk, ways turned to join and shared nodes once; None if it doesn't join."""
    out: list[tuple[int, int]] = []
    for k, i in enumerate(order):
        part = list(nodes[i])
        if out:
            if part[0] != out[-1][1]:
                part.reverse()
            if part[0] != out[-1][1]:
                return None
            part = part[1:]
        elif len(order) > 1:
            ends = {nodes[order[1]][0], nodes[order[1]][-1]}
            if part[0] in ends and part[-1] not in ends:
                part.reverse()
        out += [(i, x) for x in part]
    return out


def chain_paths(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """(chain_id, highway, bidirectional, way_id, node_id, pos): the nodes of every chain in order.  Chains that don't
    join, or whose ways have no node, have no row.  A chain, a few ways, is one row; a batch of them is one call, and only
    chains of several ways are walked."""

    lists = pa.list_(pa.int64())
    schema = pa.schema([("chain_id", pa.int64()), ("highway", pa.string()), ("bidirectional", pa.bool_()), ("ways", lists), ("nodes", lists)])

    def alone(batch):
        """Chains of one way: its nodes as they are."""
        own = batch.column("nodes").flatten()
        size = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        ways = np.repeat(batch.column("id").flatten().to_numpy(), size)
        columns = [batch.column("chain_id"), batch.column("highway").flatten(), batch.column("bidirectional").flatten(), pa.ListArray.from_arrays(offsets, pa.array(ways, pa.int64())), pa.ListArray.from_arrays(offsets, own.flatten())]
        return pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(size > 0))

    def run(batches):
        for batch in batches:
            one = pc.equal(pc.list_value_length(batch.column("id")), 1)
            yield alone(batch.filter(one))
            found, rest = [], batch.filter(pc.invert(one))
            for chain, ids, roads, nodes, both in zip(*(rest.column(c).to_pylist() for c in ("chain_id", "id", "highway", "nodes", "bidirectional")), strict=True):
                order = walk(ids, nodes) if all(nodes) else []
                steps = path(order, nodes) or []
                if steps:
                    found.append((chain, roads[order[0]], all(both), [ids[i] for i, _ in steps], [x for _, x in steps]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

    parts = ["id", "highway", "nodes", "bidirectional"]
    chains = ways.select(*parts).join(labels, "id").groupBy("chain_id").agg(F.collect_list(F.struct(*parts)).alias("w"))
    rows = chains.select("chain_id", *[F.col(f"w.{c}").alias(c) for c in parts])
    found = rows.mapInArrow(run, "chain_id bigint, highway string, bidirectional boolean, ways array<bigint>, nodes array<bigint>")
    long = found.select("chain_id", "highway", "bidirectional", F.posexplode(F.arrays_zip(F.col("ways").alias("way_id"), F.col("nodes").alias("node_id"))).alias("pos", "x"))
    return long.select("chain_id", "highway", "bidirectional", "x.way_id", "x.node_id", "pos")

"""The batch pipeline of a region: from raw ways, nodes and a raster to scored climbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import climbs as C
from ..operators import graph, loading, regions, score
from ..params import PipelineParams
from ..storage import remove

STEPS = ["load", "degree", "elevation", "stitch", "climbs", "combine", "strip", "dedupe", "score"]


def run(spark: SparkSession, warehouse: str, region: str, raw_ways: DataFrame | None = None, raw_nodes: DataFrame | None = None, raster: dict | None = None, params: PipelineParams = PipelineParams(), steps: list[str] = STEPS, reset: bool = False) -> DataFrame | None:
    """Runs the steps in their fixed order; each reads what the ones before wrote under <warehouse>/<region>.

    `raster` has the arguments of loading.fill_elevation.  Every step rebuilds its table; `reset` removes the region's
    tables first, so that steps can't read what an earlier run left.  osm_way_ids of trimmed climbs are left as they
    were.  The region's climbs replace those of earlier runs, also when there are none any more."""
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    if "load" in steps and (raw_ways is None or raw_nodes is None):
        raise ValueError("load needs raw ways and nodes")
    if "elevation" in steps and raster is None:
        raise ValueError("elevation needs a raster")
    home = f"{warehouse}/{regions.checked(region)}"
    if reset:
        remove(spark, home)
    read = lambda name: spark.read.parquet(f"{home}/{name}")

    def save(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{home}/{name}")

    if "load" in steps:
        save(loading.ridden_ways(raw_ways), "ways")
        save(loading.referenced_nodes(raw_nodes, read("ways")), "nodes_loaded")
    if "degree" in steps:
        save(graph.with_degrees(read("nodes_loaded"), read("ways")), "nodes_degree")
    if "elevation" in steps:
        nodes = read("nodes_degree")
        nodes = nodes if "elevation" in nodes.columns else nodes.withColumn("elevation", F.lit(None).cast("float"))
        save(loading.fill_elevation(nodes, **raster), "nodes")
    if "stitch" in steps:
        save(graph.chain_labels(read("ways")), "chains")
    if "climbs" in steps:
        save(C.detected(graph.chain_paths(read("ways"), read("chains")), read("nodes"), params), "climbs_detected")
    if "combine" in steps:
        base = read("climbs_detected")
        save(base.unionByName(C.combined(base, read("nodes"), params.max_combo)), "climbs_combined")
    if "strip" in steps:
        save(C.stripped(read("climbs_combined"), read("nodes"), params.max_strip, params.strip_degree), "climbs_stripped")
    if "dedupe" in steps:
        save(C.deduplicated(read("climbs_stripped"), params.max_similarity), "proto_climbs")
    if "score" in steps:
        found = score.scored(read("proto_climbs"), read("nodes"), read("ways"), region)
        once = loading.latest_by(found, "id", [F.col("score")])
        return regions.write_region(once.select(*spark.createDataFrame([], schema.CLIMBS).columns), f"{warehouse}/climbs", region).where(F.col("region") == region)
    return None


def explain_way(ways: DataFrame, nodes: DataFrame, way_id: int, params: PipelineParams = PipelineParams()) -> dict[str, DataFrame]:
    """What becomes of one way's chain: its path, its extrema and rises with the reasons why they are no climbs, the
    detected climbs, what trimming keeps of them, and their score.  A way that isn't there gives empty frames."""
    labels = graph.chain_labels(ways)
    chain = labels.join(labels.where(F.col("id") == way_id).select("chain_id"), "chain_id", "left_semi")
    path = graph.chain_paths(ways, chain)
    found = C.detected(path, nodes, params)
    cut = C.stripped(found, nodes, params.max_strip, params.strip_degree)
    return {"chain": chain, "path": path, "reasons": C.explained(path, nodes, params), "detected": found, "slices": C.strip_slices(found, nodes, params.max_strip, params.strip_degree), "stripped": cut, "score": score.breakdown(cut, nodes, ways).drop("path")}

"""The command line: runs the batch pipeline of a region.

    python -m escarp REGION --warehouse DIR --ways DIR --nodes DIR --raster DIR --west W --north N --cell C

Raw ways and nodes are Parquet tables (schema.RAW_WAYS, RAW_NODES), or one PBF extract given by --pbf; the raster is a
Parquet table (row, col, value).
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from .params import PipelineParams
from .plans import pipeline


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="escarp", description="Runs the batch pipeline of a region.")
    out.add_argument("region")
    out.add_argument("--warehouse", required=True)
    out.add_argument("--steps", nargs="+", default=pipeline.STEPS, choices=pipeline.STEPS)
    out.add_argument("--reset", action="store_true", help="remove the region's tables first")
    for name in ("ways", "nodes", "pbf", "raster"):
        out.add_argument(f"--{name}")
    for name in ("west", "north", "cell", "nodata"):
        out.add_argument(f"--{name}", type=float)
    for f in dataclasses.fields(PipelineParams):
        out.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    return out


def problems(args: argparse.Namespace) -> list[str]:
    """What the chosen steps lack."""
    found = []
    if "load" in args.steps and not args.pbf and not (args.ways and args.nodes):
        found.append("load needs --pbf, or --ways and --nodes")
    if "elevation" in args.steps and (not args.raster or None in (args.west, args.north, args.cell)):
        found.append("elevation needs --raster, --west, --north and --cell")
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if found := problems(args):
        print("\n".join(found), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("escarp").getOrCreate()
    raw_ways = raw_nodes = raster = None
    if "load" in args.steps:
        if args.pbf:
            from .sources import osm_pbf

            raw_ways, raw_nodes = osm_pbf.read_ways(spark, args.pbf), osm_pbf.read_nodes(spark, args.pbf)
        else:
            raw_ways, raw_nodes = spark.read.parquet(args.ways), spark.read.parquet(args.nodes)
    if "elevation" in args.steps:
        raster = {"grid": spark.read.parquet(args.raster), "west": args.west, "north": args.north, "cell": args.cell, "nodata": args.nodata}
    params = PipelineParams(**{f.name: getattr(args, f.name) for f in dataclasses.fields(PipelineParams)})
    found = pipeline.run(spark, args.warehouse, args.region, raw_ways, raw_nodes, raster, params, args.steps, args.reset)
    if found is not None:
        print(f"{found.count()} climbs in {args.region}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

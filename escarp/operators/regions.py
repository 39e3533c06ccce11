"""The climbs table by region."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import exists, new_path, remove

KEY = ["start_lat", "start_lng", "end_lat", "end_lng", "osm_way_ids"]


def checked(region: str) -> str:
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", region):
        raise ValueError(f"not a region name: {region!r}")
    return region


def once(new: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Of climbs with one key the one of the least id."""
    rest = [c for c in columns if c not in key]
    return new.groupBy(*key).agg(F.min_by(F.struct(*rest), "id").alias("x")).select(*[F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in columns])


def replaced(climbs: DataFrame, new: DataFrame, region: str, key: list[str] = KEY) -> DataFrame:
    """The table after a region's climbs were replaced; a new climb also replaces another region's of the same key.
    Of new climbs with one key the one of the least id stays."""
    checked(region)
    fresh = once(new, climbs.columns, key)
    others = climbs.where(~F.col("region").eqNullSafe(F.lit(region)))
    return others.join(fresh.select(*key), key, "left_anti").select(*climbs.columns).unionByName(fresh)


def write_region(new: DataFrame, path: str, region: str, key: list[str] = KEY) -> DataFrame:
    """Replaces a region's climbs in a table partitioned by region and returns the table.  Only the partitions of the
    region and of others that held a climb of the same key are written; those left without climbs go."""
    checked(region)
    spark, folder = new.sparkSession, new_path(new.sparkSession, "region")
    fresh = once(new, new.columns, key)
    rows, touched = fresh, [region]
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("region") != region)
        hit = old.join(fresh.select(*key), key, "left_semi").select("region").distinct()
        touched += [r["region"] for r in hit.collect()]  # regions, not climbs
        rows = old.where(F.col("region").isin(touched)).join(fresh.select(*key), key, "left_anti").select(*new.columns).unionByName(fresh)
    # Written apart first: the partitions are read and replaced.
    rows.write.parquet(folder)
    rows = spark.read.schema(new.schema).parquet(folder)
    laid = rows.repartitionByRange("region", "start_lat", "start_lng").sortWithinPartitions("region", "start_lat", "start_lng")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region").parquet(path)
    left = {r["region"] for r in rows.select("region").distinct().collect()}
    for name in set(touched) - left:
        remove(spark, f"{path}/region={name}")
    remove(spark, folder)
    return spark.read.schema(new.schema).parquet(path)

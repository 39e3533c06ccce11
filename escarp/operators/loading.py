"""From raw OSM ways and nodes to the ways and nodes of the engine, elevations, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roads that are ridden, those that are paved unless tagged otherwise, and unpaved surfaces.
CYCLABLE = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "road", "cycleway", "track", "living_street"]
PAVED_BY_DEFAULT = ["primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "road"]
UNPAVED = ["unpaved", "gravel", "dirt", "ground", "grass", "mud", "sand", "compacted", "fine_gravel", "pebblestone", "woodchips", "earth"]


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def is_one_of(x: Column, values: list[str]) -> Column:
    """False, not null, where x is null."""
    return F.coalesce(x.isin(values), F.lit(False))


def surface_of(surface: Column, highway: Column) -> Column:
    return F.coalesce(surface, F.when(is_one_of(highway, PAVED_BY_DEFAULT), "paved").otherwise("unpaved"))


def is_paved(surface: Column, highway: Column) -> Column:
    return ~is_one_of(surface_of(surface, highway), UNPAVED)


def ridden_ways(raw: DataFrame) -> DataFrame:
    """Ways (schema.WAYS) from raw ways: cyclable, bicycles allowed, no tunnel; against-the-way ones reversed."""
    rows = raw.where(is_one_of(tag("highway"), CYCLABLE) & ~is_one_of(tag("bicycle"), ["no", "private"]) & ~is_one_of(tag("tunnel"), ["yes", "true", "1"]))
    one_way = is_one_of(tag("oneway"), ["yes", "1", "true", "-1"]) & ~is_one_of(tag("oneway:bicycle"), ["no"])
    nodes = F.when(is_one_of(tag("oneway"), ["-1"]), F.reverse("nodes")).otherwise(F.col("nodes"))
    return rows.select("id", tag("name").alias("name"), tag("ref").alias("ref"), tag("highway").alias("highway"), surface_of(tag("surface"), tag("highway")).alias("surface"), nodes.alias("nodes"), (~one_way).alias("bidirectional"), "tags")


def referenced_nodes(raw: DataFrame, ways: DataFrame) -> DataFrame:
    """Raw nodes that some way refers to, with their signals."""
    wanted = ways.select(F.explode("nodes").alias("id")).distinct()
    signal = is_one_of(tag("highway"), ["traffic_signals"])
    return raw.join(wanted, "id", "left_semi").select("id", "lat", F.col("lng"), signal.alias("is_signal"), "tags")


def latest(old: DataFrame, new: DataFrame, key: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """An upsert: rows of `new` replace those of `old` by key, but for the columns in `keep`."""
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = both.groupBy(key).agg(*[F.max_by(F.struct(c), "_new")[c].alias(c) for c in columns if c != key and c not in keep], *[F.max_by(F.when(F.col("_new") == 0, F.struct(c)), F.when(F.col("_new") == 0, 1))[c].alias(c) for c in keep])
    return last.select(*columns)


def fill_elevation(nodes: DataFrame, grid: DataFrame, west: float, north: float, cell: float, nodata: float | None = None) -> DataFrame:
    """Nodes with missing elevations taken from the raster cell they lie in.

    `grid` has (row, col, value), row 0 at the north edge; coordinates are degrees.  An equi-join on the cell."""
    at = nodes.withColumn("_row", F.floor((F.lit(north) - F.col("lat")) / cell)).withColumn("_col", F.floor((F.col("lng") - west) / cell))
    cells = grid.select(F.col("row").cast("bigint").alias("_row"), F.col("col").cast("bigint").alias("_col"), F.col("value").cast("float").alias("_value"))
    if nodata is not None:
        cells = cells.where(F.col("_value") != F.lit(nodata).cast("float"))
    return at.join(cells, ["_row", "_col"], "left").withColumn("elevation", F.coalesce("elevation", "_value")).select(*nodes.columns)


def latest_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")

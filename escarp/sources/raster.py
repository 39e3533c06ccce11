"""Elevation rasters as tables of cells."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

VOID = -32768


def read_tiles(spark: SparkSession, path: str, per_degree: int = 1200) -> dict:
    """One-degree tiles of big-endian 16-bit heights named by their south-west corner (N44E020.hgt), as the raster
    arguments of loading.fill_elevation: one global grid whose cells lie around the samples."""
    side = per_degree + 1

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                ns, lat, ew, lng = re.search(r"([NS])(\d+)([EW])(\d+)\.hgt$", name).groups()
                south, west = int(lat) * (1 if ns == "N" else -1), int(lng) * (1 if ew == "E" else -1)
                # The first row and the last column are the neighbours' too.
                heights = np.frombuffer(content, ">i2").reshape(side, side)[1:, :-1]
                row, col = np.indices(heights.shape)
                yield pd.DataFrame({"row": (row + 1 + (89 - south) * per_degree).ravel().astype(np.int64), "col": (col + (west + 180) * per_degree).ravel().astype(np.int64), "value": heights.ravel().astype(np.float32)})

    tiles = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content")
    cell = 1 / per_degree
    return {"grid": tiles.mapInPandas(run, "row bigint, col bigint, value float"), "west": -180 - cell / 2, "north": 90 + cell / 2, "cell": cell, "nodata": float(VOID)}

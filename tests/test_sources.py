import zlib

import numpy as np
import pytest

from escarp.operators import loading
from escarp.sources import osm_pbf, raster


def varint(x):
    out = b""
    while x >= 128:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def zig(x):
    return x << 1 if x >= 0 else (-x << 1) - 1


def field(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def deltas(xs):
    return b"".join(varint(zig(x - y)) for x, y in zip(xs, [0, *xs[:-1]]))


def pack(xs):
    return b"".join(map(varint, xs))


def extract():
    strings = field(1, b"".join(field(1, s) for s in (b"", b"highway", b"track", b"traffic_signals", "Straße".encode(), b"name")))
    dense = field(2, field(2, field(1, deltas([10, 11, 9])) + field(8, deltas([440000000, 440001000, -1])) + field(9, deltas([200000000, 200000000, -5])) + field(10, pack([0, 1, 3, 0, 0]))))
    plain = field(2, field(1, field(1, zig(-7)) + field(2, pack([1])) + field(3, pack([3])) + field(8, zig(440000000)) + field(9, zig(200000000))))
    way = field(2, field(3, field(1, 5) + field(2, pack([1, 5])) + field(3, pack([2, 4])) + field(8, deltas([10, 9, 11]))))
    out = b""
    for kind, raw in ((b"OSMHeader", b""), (b"OSMData", strings + dense + plain), (b"OSMData", strings + way)):
        blob = field(2, len(raw)) + field(3, zlib.compress(raw))
        header = field(1, kind) + field(3, len(blob))
        out += len(header).to_bytes(4, "big") + header + blob
    return out


def test_pbf(spark, tmp_path):
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(extract())
    ways = osm_pbf.read_ways(spark, str(path))
    assert [(r["id"], r["nodes"], r["tags"]) for r in ways.collect()] == [(5, [10, 9, 11], {"highway": "track", "name": "Straße"})]
    nodes = {r["id"]: r for r in osm_pbf.read_nodes(spark, f"file://{path}").collect()}
    assert set(nodes) == {10, 11, 9, -7}
    assert (nodes[10]["lat"], nodes[10]["lng"]) == pytest.approx((44.0, 20.0)) and nodes[9]["lng"] == pytest.approx(-5e-7)
    assert nodes[11]["tags"] == {"highway": "traffic_signals"} == nodes[-7]["tags"] and nodes[9]["tags"] == {}
    found = loading.referenced_nodes(osm_pbf.read_nodes(spark, str(path)), loading.ridden_ways(ways))
    assert {r["id"]: r["is_signal"] for r in found.collect()} == {9: False, 10: False, 11: True}


def test_tiles(spark, tmp_path):
    heights = np.arange(25).reshape(5, 5).astype(">i2")
    heights[2, 2] = raster.VOID
    (tmp_path / "N44E020.hgt").write_bytes(heights.tobytes())
    nodes = spark.createDataFrame([(1, 44.5, 20.26, None), (2, 44.26, 20.5, None), (3, 44.5, 20.5, None), (4, 44.5, 20.5, 3.0), (5, 50.0, 20.0, None)], "id bigint, lat double, lng double, elevation float")
    found = {r["id"]: r["elevation"] for r in loading.fill_elevation(nodes, **raster.read_tiles(spark, str(tmp_path), per_degree=4)).collect()}
    assert found == {1: 11.0, 2: 17.0, 3: None, 4: 3.0, 5: None}

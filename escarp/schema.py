"""Schemas of the road tables and of the climbs that the engine makes from them."""

from __future__ import annotations

WAYS = "id bigint, name string, ref string, highway string, surface string, nodes array<bigint>, bidirectional boolean, tags map<string,string>"
NODES = "id bigint, lat double, lng double, is_signal boolean, tags map<string,string>, elevation float, degree int"
PROTO_CLIMBS = "id string, nodes array<bigint>, osm_way_ids array<bigint>, start_lat double, start_lng double, distance double, nodes_hash string, from_climbs array<string>"
CLIMBS = (
    "id string, name string, distance double, average_grade double, start_lat double, start_lng double, end_lat double, end_lng double, "
    "polyline string, surfaces array<string>, is_paved boolean, bidirectional boolean, elevation_profile array<float>, osm_way_ids array<bigint>, score double, region string"
)
RAW_WAYS = "id bigint, nodes array<bigint>, tags map<string,string>"
RAW_NODES = "id bigint, lat double, lng double, tags map<string,string>"

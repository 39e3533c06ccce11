import itertools
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from escarp import __main__ as command
from escarp.functions.geodesy import inverse_np
from escarp.operators import climbs, graph, loading, regions, score
from escarp.params import ExploreRequest, PipelineParams, SearchRequest
from escarp.plans import pipeline, service

WAYS = "id bigint, highway string, nodes array<bigint>, bidirectional boolean"


def ways(spark, rows):
    return spark.createDataFrame([(i, h, n, True) for i, h, n in rows], WAYS)


def test_oneway_rules(spark):
    rows = [(1, [1, 2], {"highway": "track", "oneway": "-1", "oneway:bicycle": "no"}), (2, [1, 2], {"highway": "primary", "oneway": "yes"}), (3, [1], {"highway": "motorway"}), (4, [1], {"highway": "road", "tunnel": "1"}), (5, [1], {"highway": "road", "bicycle": "private"}), (6, [3], {})]
    found = {r["id"]: r for r in loading.ridden_ways(spark.createDataFrame(rows, "id bigint, nodes array<bigint>, tags map<string,string>")).collect()}
    assert set(found) == {1, 2}
    assert (found[1]["nodes"], found[1]["bidirectional"], found[1]["surface"]) == ([2, 1], True, "unpaved")
    assert (found[2]["nodes"], found[2]["bidirectional"], found[2]["surface"]) == ([1, 2], False, "paved")


def test_degrees_and_edges(spark):
    w = ways(spark, [(1, "road", [1, 2, 3, 1]), (2, "road", [4, 2]), (3, "track", [5, 6]), (4, "track", [6, 7]), (5, "track", [8, 9]), (6, "track", [9, 10]), (7, "track", [9, 11])])
    degrees = {r["node_id"]: r["degree"] for r in graph.node_degrees(w).collect()}
    assert degrees[1] == 2 and degrees[2] == 2
    assert [(r["a"], r["b"]) for r in graph.chain_edges(w).collect()] == [(3, 4)]


def test_long_chains_and_cycles(spark):
    rows = [(100 + i, "road", [i, i + 1] if i % 2 else [i + 1, i]) for i in range(40)] + [(1, "track", [900, 901]), (2, "track", [901, 900])]
    w = ways(spark, rows)
    labels = graph.chain_labels(w)
    assert {r["id"]: r["chain_id"] for r in labels.collect()} == {**{100 + i: 100 for i in range(40)}, 1: 1, 2: 1}
    path = graph.chain_paths(w, labels).where("chain_id = 100").orderBy("pos").collect()
    assert [r["node_id"] for r in path] == list(range(41))
    cycle = graph.chain_paths(w, labels).where("chain_id = 1").orderBy("pos").collect()
    assert [r["node_id"] for r in cycle] == [900, 901, 900]


@pytest.mark.parametrize("n", [3, 4])
def test_one_way_loops_are_ridden_with_traffic(spark, n):
    """A cycle leaves its least way by that way's last node, whatever the order and direction of the others."""
    rows = [(1 + i, "road", [10 + i, 50 + i, 10 + (i + 1) % n], False) for i in range(n)]
    w = spark.createDataFrame(rows[::-1], WAYS)
    found = graph.chain_paths(w, graph.chain_labels(w)).orderBy("pos").collect()
    assert [r["node_id"] for r in found] == [x for i in range(n) for x in (10 + i, 50 + i)] + [10]
    assert [r["way_id"] for r in found][:5] == [1, 1, 1, 2, 2] and not any(r["bidirectional"] for r in found)
    turned = spark.createDataFrame([(i, h, x[::-1], b) if i % 2 else (i, h, x, b) for i, h, x, b in rows], WAYS)
    found = graph.chain_paths(turned, graph.chain_labels(turned)).orderBy("pos").collect()
    assert [r["node_id"] for r in found][:4] == [11 % (10 + n), 50, 10, 50 + n - 1]


def test_a_path_leaves_its_free_end(spark):
    w = ways(spark, [(1, "road", [1, 2]), (2, "road", [3, 2]), (3, "road", [3, 4])])
    assert [r["node_id"] for r in graph.chain_paths(w, graph.chain_labels(w)).orderBy("pos").collect()] == [1, 2, 3, 4]
    assert graph.walk([7], [[1, 2]]) == [0] and graph.walk([7], [[1, 1]]) == [0]


def test_similar_pairs_and_survivors_by_brute_force(spark):
    r = random.Random(4)
    pool = [[r.randrange(40) for _ in range(r.randint(1, 9))] for _ in range(12)]
    rows = []
    for i in range(90):
        nodes = list(r.choice(pool))
        for _ in range(r.randint(0, 2)):
            nodes[r.randrange(len(nodes))] = r.randrange(40)
        rows.append((f"c{i:02}", [] if i % 30 == 7 else nodes, 44 + r.random() * 0.02, 20 + r.random() * 0.02, r.choice([100.0, 900.0, 2500.0])))
    protos = spark.createDataFrame(rows, "id string, nodes array<bigint>, start_lat double, start_lng double, distance double")
    own = {i: (set(n), lat, lng, max(d, 500.0), n) for i, n, lat, lng, d in rows}
    far = lambda a, b: float(inverse_np(*(np.array([x]) for x in (*own[a][1:3], *own[b][1:3])))[0][0])
    for threshold in (0.3, 0.9):
        want = {}
        for a, b in itertools.permutations(own, 2):
            x, y = own[a][0], own[b][0]
            similarity = len(x & y) / len(x | y) if x | y else 1.0
            if similarity >= threshold and far(a, b) <= own[a][3]:
                want[a, b] = similarity
        found = {(x["a"], x["b"]): x["similarity"] for x in climbs.similar_pairs(protos, threshold).collect()}
        assert found == pytest.approx(want) and len(want) > 20
        gone: set = set()
        for a in sorted(own, key=lambda k: (-(len(own[k][4]) or 1 << 30), k)):
            if a not in gone:
                gone |= {b for x, b in want if x == a}
        for one_task in (0, 100_000):
            assert {x["id"] for x in climbs.deduplicated(protos, threshold, one_task).collect()} == set(own) - gone


def test_dedupe_kills_by_the_killers_length(spark):
    rows = [("a", list(range(10)), 44.0, 20.0, 600.0), ("b", list(range(9)), 44.0, 20.0, 600.0), ("c", [50, 51], 44.0, 20.0, 1.0), ("d", [50, 51], 45.0, 20.0, 1.0), ("e", [], 44.0, 20.0, 1.0)]
    protos = spark.createDataFrame(rows, "id string, nodes array<bigint>, start_lat double, start_lng double, distance double")
    assert {r["id"] for r in climbs.deduplicated(protos, 0.9).collect()} == {"a", "c", "d", "e"}


def test_strip(spark):
    # A sharp turn some 45 m after the start; the rest is straight.
    nodes = spark.createDataFrame([(1, 44.0, 20.0), (2, 44.0004, 20.0), (3, 44.0004, 20.001), (4, 44.0004, 20.01), (5, 44.0004, 20.02)], "id bigint, lat double, lng double")
    protos = spark.createDataFrame([("x", [1, 2, 3, 4, 5]), ("y", [3, 4, 5]), ("z", [1, 99])], "id string, nodes array<bigint>")
    found = {r["id"]: (r["first"], r["last"]) for r in climbs.strip_slices(protos, nodes).collect()}
    assert found == {"x": (2, 5), "y": (0, 3)}


def test_region_names_and_replacement(spark):
    with pytest.raises(ValueError):
        regions.checked("No Way")
    old = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0), ("3", "b", 3.0)], "id string, region string, score double")
    new = spark.createDataFrame([("2", "a", 5.0), ("4", "a", 6.0)], "id string, region string, score double")
    assert {tuple(r) for r in regions.replaced(old, new, "a", key=["id"]).collect()} == {("2", "a", 5.0), ("3", "b", 3.0), ("4", "a", 6.0)}


def test_regions_on_disk(spark, tmp_path):
    """A rerun without climbs empties the region, and a climb of another region's key takes its place."""
    kind = "id string, region string, score double, start_lat double, start_lng double, end_lat double, end_lng double, osm_way_ids array<bigint>"
    climb = lambda i, region, lat, score=1.0: (i, region, score, lat, 20.0, 45.0, 20.0, [1, 2])
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    path, rows = str(tmp_path / "climbs"), lambda df: {(r["id"], r["region"]) for r in df.collect()}
    assert rows(regions.write_region(frame(), path, "a")) == set()
    assert rows(regions.write_region(frame(climb("1", "a", 1.0), climb("2", "a", 2.0), climb("0", "a", 2.0)), path, "a")) == {("1", "a"), ("0", "a")}
    assert rows(regions.write_region(frame(climb("3", "b", 3.0)), path, "b")) == {("1", "a"), ("0", "a"), ("3", "b")}
    assert rows(regions.write_region(frame(climb("4", "b", 1.0)), path, "b")) == {("0", "a"), ("4", "b")}
    assert rows(regions.write_region(frame(climb("5", "b", 2.0)), path, "b")) == {("5", "b")}
    assert rows(regions.write_region(frame(), path, "b")) == set()


def test_command_line(capsys):
    assert command.main(["hill", "--warehouse", "x"]) == 2
    said = capsys.readouterr().err
    assert "load needs" in said and "elevation needs" in said
    args = command.parser().parse_args(["hill", "--warehouse", "x", "--steps", "combine", "--max-combo", "3", "--min-grade", "0.02"])
    assert command.problems(args) == [] and (args.max_combo, args.min_grade, args.prominence) == (3, 0.02, 15.0)


def test_requests(spark):
    with pytest.raises(ValueError):
        SearchRequest(0, 0, 1, 0, 1, 1)
    form = ExploreRequest.from_form((0, 0, 1, 1), 0, surface="unpaved", max_grade=30)
    assert form.paved is False and form.max_grade is None and form.min_distance_m is None
    rows = spark.createDataFrame([("1", 0.0, 1.0, 0.5, 0.5, True, True, 1.0), ("2", 1.0, 1.0, 0.5, 0.5, True, True, 2.0)], "id string, distance double, average_grade double, start_lat double, start_lng double, is_paved boolean, bidirectional boolean, score double")
    found = service.explore(rows, ExploreRequest(0, 0, 1, 1, 0)).collect()
    assert [r["id"] for r in found] == ["2", "1"] and found[0]["rank"] == 2.0
    assert service.search(rows.limit(0), SearchRequest(0, 0, 1, 1, 1, 1)).count() == 0


def test_a_region_from_end_to_end(spark, tmp_path):
    """One straight road that climbs 60 m on 2 km, beside a flat crossing."""
    n = 41
    raw_nodes = spark.createDataFrame([(i, 44.0 + i * 0.00045, 20.0, {"highway": "traffic_signals"} if i == 20 else {}) for i in range(n)] + [(100, 44.009, 20.01, {}), (101, 44.0, 21.0, {})], "id bigint, lat double, lng double, tags map<string,string>")
    raw_ways = spark.createDataFrame([(1, list(range(n)), {"highway": "tertiary", "name": "Hill Road"}), (2, [20, 100], {"highway": "primary"}), (3, [100, 20], {"highway": "secondary"})], "id bigint, nodes array<bigint>, tags map<string,string>")
    grid = spark.range(200).select(F.col("id").alias("row")).crossJoin(spark.range(20).select(F.col("id").alias("col"))).withColumn("value", (200 - F.col("row")).cast("double") / 2)
    raster = {"grid": grid, "west": 19.999, "north": 44.0201, "cell": 0.0002}
    found = pipeline.run(spark, str(tmp_path), "hill", raw_ways, raw_nodes, raster).collect()
    up = [r for r in found if r["start_lat"] < 44.001 and r["distance"] > 1900]
    assert len(up) == 1 and up[0]["name"] == "Hill Road" and up[0]["is_paved"] and up[0]["average_grade"] > 2
    # 50 for the signal, 6 * 5 for the primary road that crosses.
    assert up[0]["score"] == pytest.approx(80, abs=1)
    nodes, w = spark.read.parquet(f"{tmp_path}/hill/nodes"), spark.read.parquet(f"{tmp_path}/hill/ways")
    assert nodes.where("id = 101").count() == 0
    explained = pipeline.explain_way(w, nodes, 1, PipelineParams())
    assert explained["detected"].count() >= 1 and explained["score"].count() >= 1
    reasons = explained["reasons"].collect()
    assert {r["what"] for r in reasons} == {"trough", "peak", "rise"} and [r["verdict"] for r in reasons if r["what"] == "rise"] == ["accepted"]
    strict = pipeline.explain_way(w, nodes, 1, PipelineParams(min_length=1e4))["reasons"].collect()
    assert [r["verdict"] for r in strict] == ["skipped: shorter than the least length"]
    steep = pipeline.explain_way(w, nodes, 1, PipelineParams(min_grade=0.5, min_gain=1e3))["reasons"].collect()
    assert [r["verdict"] for r in steep if r["what"] == "rise"] == ["skipped: too little grade, gain"]
    # The same region without any road that is ridden: its climbs go; a reset leaves no tables for single steps.
    none = raw_ways.withColumn("tags", F.create_map(F.lit("highway"), F.lit("motorway")))
    assert pipeline.run(spark, str(tmp_path), "hill", none, raw_nodes, raster).count() == 0
    with pytest.raises(AnalysisException):
        pipeline.run(spark, str(tmp_path), "hill", steps=["degree"], reset=True)
    with pytest.raises(ValueError):
        pipeline.run(spark, str(tmp_path), "hill", steps=["load"])
    assert score.rank(F.lit("primary")) is not None

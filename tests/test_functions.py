import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from escarp.functions import physics, series, text
from escarp.functions import text as T
from escarp.functions.geodesy import cumulative_np, direct_np, inverse_np, turn_angle, within
from escarp.plans import service


def test_geodesics_have_the_known_lengths():
    metres, azimuth = inverse_np(np.array([0.0, 0.0, 44.0]), np.array([0.0, 0.0, 20.0]), np.array([0.0, 90.0, 44.0]), np.array([1.0, 0.0, 20.0]))
    assert metres == pytest.approx([111319.491, 10001965.729, 0.0], abs=1e-3)
    assert azimuth == pytest.approx([90.0, 0.0, 180.0], abs=1e-9)


@given(st.floats(-70, 70), st.floats(-170, 170), st.floats(-179, 179), st.floats(1, 50_000))
@settings(max_examples=60, deadline=None)
def test_direct_is_the_inverse_of_inverse(lat, lng, azimuth, metres):
    y, x = direct_np(np.array([lat]), np.array([lng]), np.array([azimuth]), np.array([metres]))
    back, bearing = inverse_np(np.array([lat]), np.array([lng]), y, x)
    assert back[0] == pytest.approx(metres, abs=1e-5)
    assert abs((bearing[0] - azimuth + 180) % 360 - 180) < 1e-3


def test_turns_and_radius(spark):
    rows = spark.createDataFrame([(10.0, 350.0, 20.0), (-170.0, 170.0, 20.0), (0.0, 180.0, 180.0), (5.0, 5.0, 0.0)], "a double, b double, t double")
    assert all(r["x"] == r["t"] for r in rows.select("t", turn_angle(F.col("a"), F.col("b")).alias("x")).collect())
    y, x = direct_np(np.full(3, 44.0), np.full(3, 20.0), np.array([45.0, 135.0, 250.0]), np.array([999.9, 1000.1, 500.0]))
    near = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "id int, lat double, lng double")
    assert {r["id"] for r in near.where(within(F.col("lat"), F.col("lng"), 44.0, 20.0, 1000.0)).collect()} == {0, 2}


def test_power_model(spark):
    rows = spark.createDataFrame([(1000.0, 8.0, 78.0, 250.0), (1000.0, -5.0, 78.0, 250.0), (0.0, 5.0, 78.0, 250.0), (1000.0, 5.0, 78.0, 0.0), (1000.0, -1.0, 78.0, 250.0)], "d double, g double, w double, p double")
    found = [r["t"] for r in rows.select(physics.ride_time(F.col("d"), F.col("g"), F.col("w"), F.col("p")).alias("t")).collect()]
    v = 1000 / found[0]
    assert (78 * 9.81 * 0.084 + 0.5 * 1.225 * 0.32 * v * v) * v == pytest.approx(237.5, abs=1e-6)
    assert found[1:4] == [None, None, None] and found[4] > 0


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ([0, 10, 10, 10, 0], [(0, "trough"), (2, "peak"), (4, "trough")]),
        ([0, 5, 20], [(0, "trough"), (2, "peak")]),
        ([20, 0, 20], [(0, "peak"), (1, "trough"), (2, "peak")]),
        ([20, 0, 20, 1, 20], [(0, "peak"), (1, "trough"), (2, "peak"), (3, "trough"), (4, "peak")]),
        ([3, 2, 1], [(0, "peak"), (2, "trough")]),
        ([1], []),
    ],
)
def test_extrema(x, want):
    assert series.extrema(np.array(x, dtype=float), 5.0) == want


def test_smoothing():
    x = np.arange(20.0)
    even = series.moving_average(x, 10)
    assert even[10] == np.mean(np.arange(5, 15)) and even[0] == np.mean([0] * 5 + [0, 1, 2, 3, 4])
    assert series.savgol(x**3, 7, 3) == pytest.approx(x**3)
    assert series.spike_penalty(np.linspace(0, 1000, 50), np.linspace(0, 80, 50)) == pytest.approx(0, abs=1e-12)
    grid, total = series.uniform(np.array([0.0, 100.0]), np.array([0.0, 10.0]), 20.0)
    assert total == 100 and grid == pytest.approx([0, 2.5, 5, 7.5, 10])
    assert series.uniform(np.array([0.0, 30.0]), np.array([0.0, 1.0]), 20.0) is None


def test_a_path_keeps_its_length():
    lat, lng = np.array([44.0, 44.01, 44.01, 44.02]), np.array([20.0, 20.0, 20.0, 20.01])
    y, x, cum = series.along(lat, lng, 10.0)
    assert cum[-1] == pytest.approx(cumulative_np(lat, lng)[-1]) and cumulative_np(y, x)[-1] == pytest.approx(cum[-1], rel=1e-9)


def test_polyline_and_labels(spark):
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert text.encode_polyline(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert text.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == points
    rows = spark.createDataFrame([(3725.4, 0.3)], "s double, a double")
    r = rows.select(text.format_duration(F.col("s")).alias("d"), text.format_time(F.lit(59.6)).alias("t"), text.drag_note(F.col("a")).alias("n")).first()
    assert (r["d"], r["t"], r["n"]) == ("1:02:05", "0:60", "racing, on the drops")


@given(st.lists(st.integers(1, 10**12), max_size=8), st.randoms())
@settings(max_examples=10, deadline=None)
def test_the_hash_is_blind_to_order(spark, nodes, random):
    other = nodes[:]
    random.shuffle(other)
    a, b = (r["h"] for r in spark.createDataFrame([(nodes,), (other,)], "n array<bigint>").select(text.nodes_hash(F.col("n")).alias("h")).collect())
    assert a == b


def test_polyline_column(spark):
    r = random.Random(3)
    lines = [[(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(r.randint(0, 6))] for _ in range(40)] + [[(0.0, 0.0), (-1e-6, 179.9999999), (-0.000005, 0.000005)], [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]]
    frame = spark.createDataFrame([(i, [a for a, _ in x], [b for _, b in x]) for i, x in enumerate(lines)] + [(99, None, None)], "id int, lat array<double>, lng array<double>")
    found = {x["id"]: x["p"] for x in frame.select("id", T.polyline(F.col("lat"), F.col("lng")).alias("p")).collect()}
    assert found == {i: T.encode_polyline(x) for i, x in enumerate(lines)} | {99: None}
    assert found[len(lines) - 1] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_tags_and_labels(spark):
    rows = spark.createDataFrame([({"highway": "road", "name": 'a "b" é'}, -0.4, -3.7), ({}, 0.5, 12.0), (None, 59.6, 0.0)], "tags map<string,string>, delta double, score double")
    back = rows.select("tags", T.tags_from_json(T.tags_to_json(F.col("tags"))).alias("back"), T.signed_seconds(F.col("delta")).alias("s"), T.whole_score(F.col("score")).alias("score")).collect()
    assert all(x["tags"] == x["back"] for x in back)
    assert [x["s"] for x in back] == ["+0s", "+1s", "+60s"] and [x["score"] for x in back] == ["-3 score", "12 score", "0 score"]
    assert spark.range(1).select(T.tags_from_json(F.lit("no json")).alias("x")).first()["x"] is None


def test_lists_of_found_climbs(spark):
    found = spark.createDataFrame([("1", "Hill", 1234.0, 5.55, 42.9, True, 300.0, -12.6)], "id string, name string, distance double, average_grade double, score double, is_paved boolean, estimated_time_s double, delta_s double")
    row = service.shown(found).first()
    assert tuple(row) == ("1", "Hill", "1.23 km", "5.6%" if row["average_grade"] == "5.6%" else "5.5%", "42 score", "paved", "5:00", "14.8 km/h", "-13s")
    lines = spark.createDataFrame([("a", [0.0, 10.0], [0.0, 0.0]), ("b", [0.0, 0.0], [0.0, 0.0]), ("c", [5.0], [5.0]), ("d", [0.0, 100.0], [50.0, 50.0]), ("e", [], [])], "id string, px array<double>, py array<double>")
    assert {x["id"] for x in service.hovered(lines, 5.0, 5.0).collect()} == {"a", "b"}


def test_intermediate_tables_go(spark, tmp_path):
    import os

    from escarp.operators.components import components

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    out = components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint"), 3)
    assert out.count() == 51 and len(set(os.listdir(folder)) - before) == 1
    with pytest.raises(AnalysisException):
        components(spark.createDataFrame([(1,)], "a bigint"))
    assert len(set(os.listdir(folder)) - before) == 1


def test_shown_numbers_are_rounded_by_their_exact_value(spark):
    rng = random.Random(3)
    numbers = [3.175, 3.165, 0.125, 0.375, 2.675, 1.005, 0.05, 0.15, 0.25, 0.35, -0.125, -2.675, -0.001, 0.0, 1e-300, 5e15, 123456789.125, 8.5, 8.45]
    numbers += [k / 1000 for k in range(5, 9000, 10)] + [rng.randrange(10**7) / 1000 for _ in range(500)] + [rng.random() * 10.0 ** rng.randrange(-5, 9) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.fixed(F.col("x"), 2, "%s km").alias("a"), T.fixed(F.col("x"), 1, "%s%%").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(f"{r['x']:.2f} km", f"{r['x']:.1f}%") for r in rows]
    one = spark.createDataFrame([(3175.0, None)], "m double, g double").select(T.kilometres(F.col("m")), T.percent(F.col("g"))).first()
    assert tuple(one) == ("3.17 km", None)


def test_climbs_of_many_chains_are_those_of_each(monkeypatch):
    """One call for all chains, with the same values to the last bit; cycles, stops and short chains among them."""
    from escarp.functions import series as S
    from escarp.params import PipelineParams

    p, rng, chains = PipelineParams(), np.random.default_rng(7), []
    for i in range(300):
        n = int(rng.integers(0, 9))
        lat, lng, elev = 44 + rng.random(n) * 0.02, 20 + rng.random(n) * 0.02, 100 + 8.0 * rng.integers(1, 20, n)
        if n > 3 and i % 3 == 0:
            lat[2], lng[2] = lat[1], lng[1]
        if n > 3 and i % 7 == 0:
            lat[-1], lng[-1] = lat[0], lng[0]
        chains.append((lat, lng, elev, rng.integers(0, 99, n), np.sort(rng.integers(0, 3, n)), i % 4 > 0))
    expected = [{"chain": i, **x} for i, c in enumerate(chains) for x in S.chain_climbs(*c, p)]
    calls, real = [], S.inverse_np
    monkeypatch.setattr(S, "inverse_np", lambda *x: calls.append(1) or real(*x))
    monkeypatch.setattr(S, "SAMPLES_AT_ONCE", 20_000)
    found = S.chains_climbs(np.array([len(c[0]) for c in chains]), *[np.concatenate([c[k] for c in chains]) for k in range(5)], np.array([c[5] for c in chains]), p)
    assert len(calls) == 1
    lists = {c: np.split(found[c], np.cumsum(found[f"n_{c}"])) for c in ("nodes", "ways")}
    rows = [{c: lists[c][k].tolist() if c in lists else found[c][k].item() for c in expected[0]} for k in range(len(found["chain"]))]
    key = lambda x: (x["chain"], x["turn"], x["at"])
    assert sorted(rows, key=key) == sorted(expected, key=key) and len(rows) > 300

"""Stand-in road tables over the star schema of the test data, for Spark and, as text, for an SQL oracle."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import part_of

HIGHWAYS = {"1-URGENT": "primary", "2-HIGH": "secondary", "3-MEDIUM": "tertiary", "4-NOT SPECIFIED": "residential", "5-LOW": "track"}
SURFACES = {"F": "asphalt", "P": "gravel"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key: str, factor: int, modulus: int, base: float, width: float) -> Column:
    return F.lit(base) + (F.col(key) * factor % modulus).cast("double") / float(modulus) * width


def case(key: str, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(key) == k, v) if out is None else out.when(F.col(key) == k, v)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), spread("p_partkey", 7919, 10007, 44.0, 0.02).alias("lat"), spread("p_partkey", 104729, 10009, 20.0, 0.02).alias("lng"),
        (100 + 8 * F.col("p_size")).cast("float").alias("elevation"), (F.col("p_type") == "PROMO").alias("is_signal"),
    )


def ways(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """One way for each order of at least two lines; with `part`, orders of that slice."""
    lines = part_of(table(spark, sf_dir, "lineitem"), "l_orderkey", part).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x")).where(F.size("x") >= 2)
    rows = part_of(table(spark, sf_dir, "orders"), "o_orderkey", part).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Road "), F.col("o_custkey"))).alias("name"), F.lit(None).cast("string").alias("ref"),
        case("o_orderpriority", HIGHWAYS).alias("highway"), case("o_orderstatus", SURFACES).alias("surface"), F.col("x.l_partkey").alias("nodes"), (F.col("o_orderkey") % 4 != 0).alias("bidirectional"),
    )


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as an extract would have them, with tags."""
    key = F.col("id")
    pairs = {"highway": F.col("highway"), "surface": F.col("surface"), "bicycle": F.when(key % 11 == 0, "no"), "tunnel": F.when(key % 13 == 0, "yes"), "oneway": F.when(key % 5 == 0, "-1").when(key % 7 == 0, "yes"), "oneway:bicycle": F.when(key % 3 == 0, "no"), "name": F.col("name")}
    tags = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return ways(spark, sf_dir).select("id", "nodes", tags.alias("tags"))


CORNER = "l_partkey * 20 + l_suppkey % 20"


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each part and twentieth of the suppliers that some line has: a network in which, unlike the one of
    parts, few nodes are junctions."""
    lines = table(spark, sf_dir, "lineitem")
    lat = spread("l_partkey", 7919, 10007, 44.0, 0.02) + (F.col("l_suppkey") % 20).cast("double") * 0.0001
    return lines.select(F.expr(CORNER).alias("id"), lat.alias("lat"), spread("l_partkey", 104729, 10009, 20.0, 0.02).alias("lng")).distinct()


def streets(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """One way through corners for each order of at least two lines; with `part`, orders of that slice."""
    at = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.expr(CORNER).alias("node"))))
    lines = part_of(table(spark, sf_dir, "lineitem"), "l_orderkey", part).groupBy(F.col("l_orderkey").alias("id")).agg(at.alias("x")).where(F.size("x") >= 2)
    return lines.select("id", F.col("x.node").alias("nodes"))


def protos(spark: SparkSession, sf_dir: str, nodes=nodes, ways=ways, part: tuple[int, int] | None = None) -> DataFrame:
    """Ways as detected climbs; ids are strings.  With `part`, ways of that slice."""
    from .functions.text import nodes_hash
    from .operators.climbs import places, segments

    rows = part_of(ways(spark, sf_dir), "id", part).select(F.col("id").cast("string").alias("id"), "nodes", F.array("id").alias("osm_way_ids"))
    at = segments(places(rows, nodes(spark, sf_dir), ["lat", "lng"]))
    ends = at.groupBy("id").agg(F.min_by("lat", "pos").alias("start_lat"), F.min_by("lng", "pos").alias("start_lng"), F.sum("step").alias("distance"))
    return rows.join(ends, "id").select("id", "nodes", "osm_way_ids", "start_lat", "start_lng", "distance", nodes_hash(F.col("nodes")).alias("nodes_hash"), F.lit(None).cast("array<string>").alias("from_climbs"))


def climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One climb for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (200 + F.col("o_totalprice").cast("double") / 100).alias("distance"), (1 + (F.col("o_custkey") % 120).cast("double") / 10).alias("average_grade"),
        spread("o_orderkey", 7919, 10007, 44.0, 0.05).alias("start_lat"), spread("o_orderkey", 104729, 10009, 20.0, 0.05).alias("start_lng"),
        ((F.col("o_orderkey") * 31 % 4000).cast("double") / 10).alias("score"), (F.col("o_orderstatus") != "P").alias("is_paved"), (F.col("o_orderkey") % 2 == 0).alias("bidirectional"),
        F.concat(F.lit("r"), F.col("o_orderkey") % 5).alias("region"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, d, e): arrays of metres and elevations, one series for each user of the events."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    return rows.select("user_id", F.transform("x", lambda x, i: (i * 20).cast("double")).alias("d"), F.col("x.value").cast("array<double>").alias("e"))


# --- the same for the oracle

SQL_SPREAD = "{base}e0 + CAST({key} * {factor} % {modulus} AS DOUBLE) / {modulus}e0 * {width}e0"


def sql_spread(key: str, factor: int, modulus: int, base: float, width: float) -> str:
    return SQL_SPREAD.format(key=key, factor=factor, modulus=modulus, base=base, width=width)


SQL = {
    "node": f"SELECT p_partkey AS id, {sql_spread('p_partkey', 7919, 10007, 44.0, 0.02)} AS lat, {sql_spread('p_partkey', 104729, 10009, 20.0, 0.02)} AS lng, CAST(100 + 8 * p_size AS FLOAT) AS elevation, p_type = 'PROMO' AS is_signal FROM part",
    "way": "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'Road ' || o_custkey END AS name, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HIGHWAYS.items())
    + " END AS highway, CASE o_orderstatus WHEN 'F' THEN 'asphalt' WHEN 'P' THEN 'gravel' END AS surface, nodes, o_orderkey % 4 <> 0 AS bidirectional FROM orders JOIN (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2) ON o_orderkey = l_orderkey",
    "place": "SELECT id, unnest(nodes) AS node_id, generate_subscripts(nodes, 1) - 1 AS pos FROM way",
    "degree": "SELECT node_id, count(*) AS degree FROM place GROUP BY node_id",
    "climb": f"SELECT o_orderkey AS id, 200 + CAST(o_totalprice AS DOUBLE) / 100 AS distance, 1 + CAST(o_custkey % 120 AS DOUBLE) / 10 AS average_grade, {sql_spread('o_orderkey', 7919, 10007, 44.0, 0.05)} AS start_lat, {sql_spread('o_orderkey', 104729, 10009, 20.0, 0.05)} AS start_lng, CAST(o_orderkey * 31 % 4000 AS DOUBLE) / 10 AS score, o_orderstatus <> 'P' AS is_paved, o_orderkey % 2 = 0 AS bidirectional, 'r' || (o_orderkey % 5) AS region FROM orders",
    "point": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(value AS DOUBLE) AS e FROM events",
}
NEEDS = {"place": ["way"], "degree": ["way", "place"]}
#: The network of corners and streets.
STREETS = {
    "node": f"SELECT DISTINCT {CORNER} AS id, {sql_spread('l_partkey', 7919, 10007, 44.0, 0.02)} + CAST(l_suppkey % 20 AS DOUBLE) * 0.0001e0 AS lat, {sql_spread('l_partkey', 104729, 10009, 20.0, 0.02)} AS lng FROM lineitem",
    "way": f"SELECT l_orderkey AS id, list({CORNER} ORDER BY l_linenumber, l_partkey, {CORNER}) AS nodes FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2",
}


def with_views(*names: str, instead: dict[str, str] = {}) -> str:  # noqa: B006
    """The WITH clause's views, those that they need first."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({instead.get(n, SQL[n])})" for n in order)


def sql_geodesic(source: str, out: str, keep: str, rounds: int = 8) -> str:
    """Views that add `metres` and `azimuth` between (lat1, lng1) and (lat2, lng2) of a view, spelled out."""
    f, a = "(1e0 / 298.257223563e0)", "6378137e0"
    b = f"({a} * (1e0 - {f}))"
    step = f"{out}_0 AS (SELECT {keep}, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l, l AS lam FROM (SELECT {keep}, atan((1e0 - {f}) * tan(radians(lat1))) AS u1, atan((1e0 - {f}) * tan(radians(lat2))) AS u2, radians(lng2 - lng1) AS l FROM {source}))"
    parts = [step]
    angle = "SELECT *, c2 * sin(lam) AS x, c1 * s2 - s1 * c2 * cos(lam) AS y, s1 * s2 + c1 * c2 * cos(lam) AS co"
    first = "SELECT *, sqrt(x * x + y * y) AS si"
    second = "SELECT *, CASE WHEN si = 0 THEN 0e0 ELSE c1 * c2 * sin(lam) / si END AS al, atan2(si, co) AS sg"
    third = "SELECT *, 1e0 - al * al AS c2a"
    fourth = "SELECT *, CASE WHEN c2a = 0 THEN 0e0 ELSE co - 2e0 * s1 * s2 / c2a END AS mid"
    nested = lambda v: f"({fourth} FROM ({third} FROM ({second} FROM ({first} FROM ({angle} FROM {v})))))"
    for k in range(rounds):
        parts.append(f"{out}_{k + 1} AS (SELECT {keep}, s1, c1, s2, c2, l, l + (1e0 - c) * {f} * al * (sg + c * si * (mid + c * co * (-1e0 + 2e0 * mid * mid))) AS lam FROM (SELECT *, {f} / 16e0 * c2a * (4e0 + {f} * (4e0 - 3e0 * c2a)) AS c FROM {nested(f'{out}_{k}')}))")
    q = f"(SELECT *, c2a * (({a} * {a} - {b} * {b}) / ({b} * {b})) AS q FROM {nested(f'{out}_{rounds}')})"
    ab = f"(SELECT *, 1e0 + q / 16384e0 * (4096e0 + q * (-768e0 + q * (320e0 - 175e0 * q))) AS ba, q / 1024e0 * (256e0 + q * (-128e0 + q * (74e0 - 47e0 * q))) AS bb FROM {q})"
    delta = "bb * si * (mid + bb / 4e0 * (co * (-1e0 + 2e0 * mid * mid) - bb / 6e0 * mid * (-3e0 + 4e0 * si * si) * (-3e0 + 4e0 * mid * mid)))"
    parts.append(f"{out} AS (SELECT {keep}, CASE WHEN si = 0 THEN 0e0 ELSE {b} * ba * (sg - {delta}) END AS metres, CASE WHEN si = 0 THEN 180e0 ELSE degrees(atan2(x, y)) END AS azimuth FROM {ab})")
    return ", ".join(parts)


def sql_polynomial_weights(name: str, widths, order: int = 3) -> str:
    """A view (w, i, j, c): at place i of a window of w samples, the least-squares polynomial has the value of the sum
    of c times sample j.  By orthogonal polynomials in exact fractions."""
    rows = []
    for w in widths:
        basis: list[list[Fraction]] = []
        for k in range(order + 1):
            p = [Fraction(2 * x - w + 1) ** k for x in range(w)]
            for q in basis:
                share = sum(a * b for a, b in zip(p, q)) / sum(b * b for b in q)
                p = [a - share * b for a, b in zip(p, q)]
            basis.append(p)
        norms = [sum(b * b for b in q) for q in basis]
        rows += [f"({w}, {i}, {j}, {float(sum(q[i] * q[j] / n for q, n in zip(basis, norms)))!r}e0)".replace("e0)", "::DOUBLE)") for i in range(w) for j in range(w)]
    return f"{name}(w, i, j, c) AS (VALUES {', '.join(rows)})"


def sql_segments(places: str, out: str) -> str:
    """Views with (id, pos, node_id, step, cum, turn, n, total) of a view with (id, pos, node_id)."""
    return (
        f"{out}_a AS (SELECT p.id, p.pos, p.node_id, lag(n.lat) OVER w AS lat1, lag(n.lng) OVER w AS lng1, n.lat AS lat2, n.lng AS lng2 FROM {places} p JOIN node n ON n.id = p.node_id WINDOW w AS (PARTITION BY p.id ORDER BY p.pos)), "
        f"{out}_b AS (SELECT * FROM {out}_a WHERE lat1 IS NOT NULL), {sql_geodesic(f'{out}_b', f'{out}_g', 'id, pos')}, "
        f"{out}_c AS (SELECT a.id, a.pos, a.node_id, a.lat2 AS lat, a.lng2 AS lng, coalesce(g.metres, 0e0) AS step, g.azimuth AS az FROM {out}_a a LEFT JOIN {out}_g g ON g.id = a.id AND g.pos = a.pos), "
        f"{out}_d AS (SELECT *, sum(step) OVER (PARTITION BY id ORDER BY pos) AS cum, count(*) OVER (PARTITION BY id) AS n, abs(lead(az) OVER (PARTITION BY id ORDER BY pos) - az) AS t0 FROM {out}_c), "
        f"{out} AS (SELECT *, CASE WHEN t0 - 360e0 * floor(t0 / 360e0) > 180 THEN 360 - (t0 - 360e0 * floor(t0 / 360e0)) ELSE t0 - 360e0 * floor(t0 / 360e0) END AS turn, max(cum) OVER (PARTITION BY id) AS total FROM {out}_d)"
    )

"""The analytic requests over a table of climbs, each one plan.

The table is best laid out by region and latitude (operators.regions.write_region), so that boxes prune files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geodesy import within
from ..functions.physics import ride_time
from ..params import ExploreRequest, SearchRequest

SEARCH_ROWS, EXPLORE_ROWS = 20, 150
LIST_COLUMNS = ["id", "name", "distance", "average_grade", "start_lat", "start_lng", "polyline", "surfaces", "is_paved", "bidirectional", "score"]
DETAIL_COLUMNS = [*LIST_COLUMNS[:6], "end_lat", "end_lng", *LIST_COLUMNS[6:-1], "elevation_profile", "score"]


def has(climbs: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in climbs.columns]


def lookup(climbs: DataFrame, climb: str | int) -> DataFrame:
    return climbs.where(F.col("id") == climb).select(*has(climbs, DETAIL_COLUMNS))


def lookup_many(climbs: DataFrame, ids: DataFrame) -> DataFrame:
    """The climbs whose ids a frame (id) lists."""
    return climbs.join(ids.select("id"), "id", "left_semi").select(*has(climbs, DETAIL_COLUMNS))


def explore_all(climbs: DataFrame, r: ExploreRequest) -> DataFrame:
    """All climbs in the viewport that pass the filters, with their rank; limits that aren't set are no predicates."""
    rows = climbs.where(F.col("start_lat").between(r.min_lat, r.max_lat) & F.col("start_lng").between(r.min_lng, r.max_lng))
    for column, least, most in (("distance", r.min_distance_m, r.max_distance_m), ("average_grade", r.min_grade, r.max_grade)):
        if least is not None:
            rows = rows.where(F.col(column) >= least)
        if most is not None:
            rows = rows.where(F.col(column) <= most)
    if r.paved is not None:
        rows = rows.where(F.col("is_paved") == r.paved)
    if r.bidirectional_only:
        rows = rows.where("bidirectional")
    target = max(0.75 * r.radius_m, 1.0)
    # A length of 0 has no logarithm; such climbs come last.
    fit = F.when(F.col("distance") > 0, F.pow(F.ln(F.col("distance") / target), 2) * 30 + F.col("score"))
    return rows.withColumn("rank", F.coalesce(fit, F.lit(float("inf"))))


def explore(climbs: DataFrame, r: ExploreRequest) -> DataFrame:
    """The 150 climbs that fit a viewport best."""
    top = explore_all(climbs, r).orderBy("rank", "id").limit(EXPLORE_ROWS)
    return top.select(*[F.col(c).alias("distance_m" if c == "distance" else c) for c in has(climbs, LIST_COLUMNS)], "rank")


def search_all(climbs: DataFrame, r: SearchRequest) -> DataFrame:
    """Climbs within the radius whose ride time suits the interval, with time, difference and rank."""
    near = climbs.where(within(F.col("start_lat"), F.col("start_lng"), r.lat, r.lng, r.radius_m))
    timed = near.withColumn("estimated_time_s", ride_time(F.col("distance"), F.col("average_grade"), r.weight_kg, r.power_w))
    timed = timed.where(F.col("estimated_time_s").between(0.95 * r.interval_s, 2 * r.interval_s)).withColumn("delta_s", F.col("estimated_time_s") - r.interval_s)
    span = timed.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))  # one row
    share = F.when(F.col("_high") > F.col("_low"), F.try_divide(F.col("score") - F.col("_low"), F.col("_high") - F.col("_low"))).otherwise(0.0)
    off = F.col("delta_s") / r.interval_s
    return timed.crossJoin(F.broadcast(span)).withColumn("rank", 0.7 * off * off + 0.3 * share).drop("_low", "_high")


def search(climbs: DataFrame, r: SearchRequest) -> DataFrame:
    """The 20 best climbs for an interval."""
    top = search_all(climbs, r).orderBy("rank", "id").limit(SEARCH_ROWS)
    return top.select(*has(climbs, LIST_COLUMNS), "estimated_time_s", "delta_s", "rank")


def post_filtered(found: DataFrame, paved_only: bool = False, bidirectional_only: bool = False) -> DataFrame:
    """The client's filters, after the best were chosen."""
    if paved_only:
        found = found.where("is_paved")
    return found.where("bidirectional") if bidirectional_only else found


def shown(found: DataFrame) -> DataFrame:
    """What a list shows of found climbs: names and numbers as text."""
    columns = {"distance_m" if "distance_m" in found.columns else "distance": T.kilometres, "average_grade": T.percent, "score": T.whole_score}
    out = [F.col("id"), *[F.col(c) for c in ("name",) if c in found.columns], *[f(F.col(c)).alias(c) for c, f in columns.items()], F.when(F.col("is_paved"), "paved").otherwise("unpaved").alias("surface")]
    if "estimated_time_s" in found.columns:
        out += [T.format_time(F.col("estimated_time_s")).alias("time"), T.kmh(F.col("distance") / F.col("estimated_time_s")).alias("speed"), T.signed_seconds(F.col("delta_s")).alias("delta")]
    return found.select(*out)


HIT_PIXELS = 8.0


def hovered(climbs: DataFrame, x: float, y: float, tolerance: float = HIT_PIXELS) -> DataFrame:
    """The climbs (id, px, py: arrays of pixel places along the line) that pass within some pixels of a point; lines
    of fewer than two points don't."""

    def off(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(length > 0, length)))).otherwise(0.0)
        return F.hypot(x - (a["x"] + t * dx), y - (a["y"] + t * dy))

    points = climbs.withColumn("_p", F.arrays_zip(F.col("px").alias("x"), F.col("py").alias("y"))).where(F.size("_p") > 1)
    tail = F.slice("_p", F.lit(2), F.size("_p") - 1)
    least = F.array_min(F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), tail, off))
    return points.where(least <= tolerance).drop("_p")


def as_json(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("*")).alias("json"))

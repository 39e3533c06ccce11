"""The cycling power model: speed from power, and what the power goes into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gravity, rolling resistance, air density, drag area, drivetrain efficiency; the standard atmosphere.
G, CRR, RHO, CDA, ETA = 9.81, 0.004, 1.225, 0.32, 0.95
P_SEA, T_SEA, LAPSE, R_AIR, MOLAR, R_GAS = 101325.0, 288.15, 0.0065, 287.05, 0.0289644, 8.31446
# Newton's rounds, step and slope at which it stops, least speed, greatest residual in watts.
ROUNDS, STEP, SLOPE, LEAST, RESIDUAL = 64, 1e-9, 1e-12, 0.01, 1.0


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def speed(grade_pct, weight_kg, power_w, crr=CRR, cda=CDA, rho=RHO) -> Column:
    """Metres a second at which the resistances use the effective power; null where Newton's method, begun from the
    speed without drag, doesn't get there (on steep descents) or the power isn't positive."""
    grade, weight, power, crr, cda, rho = map(_lit, (grade_pct, weight_kg, power_w, crr, cda, rho))
    force = weight * G * (grade / 100) + weight * G * crr
    fixed = F.struct(force.alias("f"), (power * ETA).alias("p"), (0.5 * rho * cda).alias("k"))

    def solve(c: Column) -> Column:
        first = F.when(c["f"] > 0, F.try_divide(c["p"], c["f"])).otherwise(F.lit(5.0))
        begin = F.struct(F.least(F.greatest(first, F.lit(0.1)), F.lit(30.0)).alias("v"), F.lit(False).alias("done"))

        def step(s: Column, _: Column) -> Column:
            v = s["v"]
            slope = c["f"] + 3 * c["k"] * v * v
            flat = F.abs(slope) < SLOPE
            delta = F.when(flat, F.lit(0.0)).otherwise(F.try_divide((c["f"] + c["k"] * v * v) * v - c["p"], slope))
            moved = F.struct(F.when(flat, v).otherwise(F.greatest(v - delta, F.lit(LEAST))).alias("v"), (flat | (F.abs(delta) < STEP)).alias("done"))
            return F.when(s["done"], s).otherwise(moved)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: s["v"])
        return F.get(F.transform(F.array(found), lambda v: F.when(F.abs((c["f"] + c["k"] * v * v) * v - c["p"]) <= RESIDUAL, v)), F.lit(0))

    return F.when((power > 0) & force.isNotNull(), F.get(F.transform(F.array(fixed), solve), F.lit(0)))


def ride_time(distance_m, grade_pct, weight_kg, power_w, crr=CRR, cda=CDA, rho=RHO) -> Column:
    """Seconds for a distance; null where `speed` is or the distance isn't positive."""
    distance = _lit(distance_m)
    return F.when(distance > 0, distance / speed(grade_pct, weight_kg, power_w, crr, cda, rho))


def prediction(distance_m, grade_pct, weight_kg, power_w, crr=CRR, cda=CDA, rho=RHO) -> Column:
    """struct(time, v, p_eff, p_gravity, p_rolling, p_aero), null where the model doesn't converge."""
    distance, grade, weight, power, crr_, cda_, rho_ = map(_lit, (distance_m, grade_pct, weight_kg, power_w, crr, cda, rho))

    def of(v: Column) -> Column:
        parts = F.struct((distance / v).alias("time"), v.alias("v"), (power * ETA).alias("p_eff"), (weight * G * (grade / 100) * v).alias("p_gravity"), (weight * G * crr_ * v).alias("p_rolling"), (0.5 * rho_ * cda_ * v * v * v).alias("p_aero"))
        return F.when(v.isNotNull() & (distance > 0), parts)

    return F.get(F.transform(F.array(speed(grade, weight, power, crr_, cda_, rho_)), of), F.lit(0))


def pressure(altitude_m) -> Column:
    """Pascals at an altitude in the standard troposphere."""
    return P_SEA * F.pow(1 - LAPSE * _lit(altitude_m) / T_SEA, F.lit(G * MOLAR / (R_GAS * LAPSE)))


def air_density(temperature_c, altitude_m) -> Column:
    return pressure(altitude_m) / (R_AIR * (_lit(temperature_c) + 273.15))


def watts_per_kg(power_w, weight_kg) -> Column:
    return F.try_divide(_lit(power_w), _lit(weight_kg))


def power_shares(p: Column, power_w) -> dict[str, Column]:
    """What a prediction's power goes into: drivetrain loss and percentages, none below 0."""
    power = _lit(power_w)
    share = lambda x: F.greatest(F.lit(0.0), F.try_divide(x, power) * 100)
    loss = power - p["p_eff"]
    return {"p_loss": loss, "loss_pct": share(loss), "gravity_pct": share(p["p_gravity"]), "rolling_pct": share(p["p_rolling"]), "aero_pct": share(p["p_aero"]), "speed_kmh": p["v"] * 3.6}

"""Motion, category and pixel expressions."""
import math

from pyspark.sql import Column, functions as F

from ..constants import TWO_WHEELERS, VEHICLES

TIE = 1e-9        # values this close to a limit lie on it


def is_vehicle(c="category") -> Column:
    return F.col(c).isin(VEHICLES)


def is_two_wheeler(c="category") -> Column:
    return F.col(c).isin(TWO_WHEELERS)


def category_group(c="category") -> Column:
    return (F.when(is_vehicle(c), F.lit("vehicle"))
            .when(is_two_wheeler(c), F.lit("two_wheeler")).otherwise(F.col(c)))


def cos_to(vx: Column, vy: Column, dx, dy) -> Column:
    """Cosine between a velocity and a unit direction."""
    return (vx * dx + vy * dy) / (F.sqrt(vx * vx + vy * vy) + F.lit(1e-9))


def moving_toward(vx, vy, speed, dx, dy, min_speed: float = 0.4) -> Column:
    return (speed >= min_speed) & (cos_to(vx, vy, dx, dy) > 0.3)


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest signed difference a - b in radians."""
    return F.pmod(a - b + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def closest_approach(rx, ry, vx, vy, horizon: float = 4.0) -> Column:
    """struct(t_cpa, d_cpa, v_rel); times are NULL when the two are not closing in.

    Limits give way by ``TIE``, so that rounding doesn't decide who lies on one: a meeting now (t = 0) counts as none.
    """
    vv = vx * vx + vy * vy
    v = F.sqrt(vv)
    t = -F.try_divide(rx * vx + ry * vy, vv)
    ok = (v >= 0.2 - TIE) & (t > TIE) & (t <= horizon + TIE)
    d = F.sqrt(F.pow(rx + vx * t, 2.0) + F.pow(ry + vy * t, 2.0))
    return F.struct(F.when(ok, t).alias("t_cpa"), F.when(ok, d).alias("d_cpa"), v.alias("v_rel"))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) of 8-bit RGB; hue on the 0-179 scale.

    Maximum and spread are bound once by a one-element ``transform``, else every
    use would repeat their expressions.
    """
    r, g, b = (c.cast("double") for c in (r, g, b))
    parts = F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("v"),
                     F.nullif(F.greatest(r, g, b) - F.least(r, g, b), F.lit(0.0)).alias("d"))

    def convert(c):
        raw = (F.when(c["v"] == c["r"], 60.0 * (c["g"] - c["b"]) / c["d"])
               .when(c["v"] == c["g"], 120.0 + 60.0 * (c["b"] - c["r"]) / c["d"])
               .otherwise(240.0 + 60.0 * (c["r"] - c["g"]) / c["d"]))
        hue = F.pmod(F.floor(F.pmod(F.coalesce(raw, F.lit(0.0)), F.lit(360.0)) / 2.0 + 0.5), F.lit(180))
        sat = F.coalesce(F.floor(c["d"] * 255.0 / F.nullif(c["v"], F.lit(0.0)) + 0.5), F.lit(0))
        return F.struct(hue.alias("h"), sat.alias("s"), c["v"].cast("long").alias("v"))

    return F.transform(F.array(parts), convert)[0]


def fire_pixel(r: Column, g: Column, b: Column) -> Column:
    """Flame-coloured: bright, saturated red to yellow with red well over blue.

    With r >= g > b the maximum is r and the minimum b, so the hue lies within
    0..30 by itself and only saturation is left to test.
    """
    sat = F.floor((r - b) * 255.0 / F.nullif(r, F.lit(0)) + 0.5)
    return (r > 190) & (r >= g) & (g > b) & (r - b > 90) & (sat > 90)


def stride_for(fps: Column, rate: float, override: int = 0) -> Column:
    """Keep every n-th frame to get about ``rate`` frames per second."""
    if override:
        return F.lit(override)
    return F.greatest(F.lit(1), F.bround(fps / rate, 0).cast("int"))

"""Places on the border of a zone, meetings at a limit."""
import pytest
from pyspark.sql import functions as F

from lanewise.functions import geometry as G, motion as M


def _ring(spark, points, px, py):
    rows = spark.createDataFrame([([dict(x=float(a), y=float(b)) for a, b in points], x, y) for x, y in zip(px, py)],
                                 "points array<struct<x:double,y:double>>, px double, py double")
    return rows.withColumn("edges", G.ring(F.col("points")))


def test_a_place_on_an_axis_parallel_border_is_at_distance_zero(spark):
    # 1184.8 on the lower border of the road: its foot on the edge was off by rounding, which put it outside
    xs = [1184.8, 0.1, 1180.0000000000002, 333.3, 7.7, 1661.9]
    rows = _ring(spark, [(0, 0), (1662, 0), (1662, 300), (0, 300)], xs * 2, [300.0] * 6 + [0.0] * 6)
    got = [r.d for r in rows.select(G.polygon_distance(F.col("edges"), F.col("px"), F.col("py")).alias("d")).collect()]
    assert got == [0.0] * 12


def test_distances_inside_outside_and_at_corners(spark):
    rows = _ring(spark, [(0, 0), (10, 0), (10, 10), (0, 10)], [5.0, 13.0, 3.0, -3.0, 10.0], [4.0, 14.0, 12.0, -4.0, 10.0])
    got = [r.d for r in rows.select(G.polygon_distance(F.col("edges"), F.col("px"), F.col("py")).alias("d")).collect()]
    assert got == pytest.approx([4.0, -5.0, -2.0, -5.0, 0.0])


def test_rounding_does_not_decide_who_meets_at_a_limit(spark):
    # (rx, vx): meets in 4 s and a few ulps, in 0 s and an ulp, at a relative speed of just 0.2
    rows = spark.createDataFrame([(-4.0 - 1e-14, 1.0), (-4.0 + 1e-14, 1.0), (-1e-17, 1.0), (1e-17, 1.0), (-0.4, 0.2 - 1e-16)], "rx double, vx double")
    c = M.closest_approach(F.col("rx"), F.lit(0.0), F.col("vx"), F.lit(0.0))
    got = [r.t for r in rows.select(c["t_cpa"].alias("t")).collect()]
    assert got[:2] == pytest.approx([4.0, 4.0]) and got[2:4] == [None, None] and got[4] == pytest.approx(2.0)

"""Images in plain NumPy against the pixel tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.constants import Obstacle
from lanewise.operators import backgrounds as BG, cues as C

S = 1_000_000


def pixels(spark, cubes):
    rows = [(v, i, i * S // 2, y, x, float(g)) for v, cube in cubes.items() for i, img in enumerate(cube) for (y, x), g in np.ndenumerate(img) if not np.isnan(g)]
    return spark.createDataFrame(rows, "video_id string, cue_idx long, t_us long, y int, x int, gray double")


@pytest.mark.parametrize("whole, slice_us, strip", [(True, 7 * S, 2), (False, 1200 * S, 512)])
def test_median_of_sliding_windows(spark, monkeypatch, whole, slice_us, strip):
    monkeypatch.setattr(BG, "STRIP", strip)
    rng = np.random.default_rng(1)
    cubes = {v: rng.integers(0, 256, (60, 3, 5)).astype(float) + (0 if whole else 0.25) for v in "ab"}
    cubes["a"][10:20, 1, 1] = np.nan   # a pixel that comes and goes
    cubes["b"][20:50] = np.nan         # a camera that was off
    spans = [(v, e * S, side, (e + lo) * S, (e + hi) * S) for v in "ab" for e in range(6, 27) for side, lo, hi in (("past", -6, -2), ("future", 0, 3))]
    table = spark.createDataFrame(spans, "video_id string, eval_us long, side string, lo long, hi long")
    got = BG.median_background(pixels(spark, cubes), table, slice_us).collect()
    want = {}
    for v, e, side, lo, hi in spans:
        window = cubes[v][[i for i in range(60) if lo <= i * S // 2 <= hi]]
        for (y, x), m in np.ndenumerate(np.zeros((3, 5))):
            seen = window[:, y, x][~np.isnan(window[:, y, x])]
            if len(seen):
                want[v, e, side, y, x] = float(np.median(seen))
    assert {(r.video_id, r.eval_us, r.side, r.y, r.x): r.gray for r in got} == want and len(got) == len(want)


def test_a_pixel_is_dealt_once_whatever_the_windows(spark):
    """Copies come from slice borders only: 40 + 8 s of 1200 s."""
    t = spark.range(4000).selectExpr("'v' AS video_id", "id * 500000 AS t_us", "0 AS y", "0 AS x", "1 AS gray")
    e = spark.range(50, 1900).selectExpr("'v' AS video_id", "id * 1000000 AS eval_us", "'past' AS side", "(id - 40) * 1000000 AS lo", "(id - 15) * 1000000 AS hi")
    out = BG.median_background(t, e)
    assert out.count() == 1850
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("dx, dy", [(0.5, 0.0), (-0.5, 2.25), (3.0, -1.0), (0.01, 5.9)])
def test_drift_is_undone_below_a_pixel(spark, dx, dy):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (9, 12)).astype(float)
    qx, qy = np.floor(dx * 32 + 0.5) / 32, np.floor(dy * 32 + 0.5) / 32
    y, x = np.mgrid[0:9, 0:12]
    sx, sy = x + qx, y + qy
    fx, fy = sx - np.floor(sx), sy - np.floor(sy)
    at = lambda a, b: img[np.clip(np.floor(sy).astype(int) + a, 0, 8), np.clip(np.floor(sx).astype(int) + b, 0, 11)]
    want = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    cur = pixels(spark, {"v": img[None], "w": img[None]}).select("video_id", F.lit(7).alias("eval_us"), "y", "x", "gray")
    drift = spark.createDataFrame([("v", 7, dx, dy, 0.9), ("w", 7, dx, dy, 0.01)], "video_id string, eval_us int, dx double, dy double, response double")
    size = spark.createDataFrame([("v", 12, 9), ("w", 12, 9)], "video_id string, width int, height int")
    got = C.shift_by_drift(cur, drift, size, Obstacle()).collect()
    out = {v: np.full((9, 12), np.nan) for v in "vw"}
    for r in got:
        out[r.video_id][r.y, r.x] = r.gray
    assert len(got) == 2 * 108 and np.allclose(out["v"], want) and (out["w"] == img).all()


def test_squares_axis_by_axis(spark):
    rng = np.random.default_rng(3)
    img, mask = rng.integers(0, 99, (8, 11)).astype(float), rng.random((8, 11)) < 0.8
    img[~mask] = np.nan
    grey = pixels(spark, {"v": img[None]}).select("video_id", "y", "x", "gray", F.lit(11).alias("width"), F.lit(8).alias("height"))

    def square(a, y, x, r):
        return a[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1]

    got = {(r.y, r.x): (r.hi, r.lo) for r in C.local_range(grey, ["video_id"], 2).collect()}
    assert got == {(y, x): (np.nanmax(square(img, y, x, 2)), np.nanmin(square(img, y, x, 2))) for y, x in zip(*np.nonzero(mask))}
    got = {(r.y, r.x) for r in C.erode(grey, ["video_id"], 1).collect()}
    assert got == {(y, x) for y in range(8) for x in range(11) if square(mask, y, x, 1).all()}
    few = grey.filter("gray < 6")
    got = {(r.y, r.x) for r in C.dilate(few, ["video_id"], 3).filter("y >= 0 AND x >= 0 AND y < 8 AND x < 11").collect()}
    assert got == {(y, x) for y in range(8) for x in range(11) if (square(np.nan_to_num(img, nan=99), y, x, 3) < 6).any()}

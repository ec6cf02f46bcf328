"""Windows cut into time slices against whole ones, and joins by place against all pairs."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.constants import Stopped
from lanewise.operators import signals as SG, timeseries as ts
from lanewise.operators.pairs import unwrap_column, unwrap_heading
from lanewise.operators.slices import neighbours_in_slices
from lanewise.plans import conflicts as C, junction as J, vehicles as V
from scenes import analysis, join, line, still, track

WHOLE = 10 ** 15
KEY = ["video_id", "track_id"]


def same(a, b):
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    got, want = rows(a), rows(b)
    assert got == want and got
    return got


@pytest.fixture(scope="module")
def spinning(spark):
    """Two tracks that turn several times, with holes and equal headings."""
    rng = np.random.default_rng(3)
    rows = []
    for tid in (1, 2):
        t = np.cumsum(rng.integers(40_000, 900_000, 150))
        turn = np.cumsum(rng.normal(0.6, 0.9, 150))
        rows += [("v", tid, int(a), float(math.remainder(h, 2 * math.pi)), 1.0) for a, h in zip(t, turn)]
    return spark.createDataFrame(rows, "video_id string, track_id long, t_us long, heading double, speed double")


def test_unwrapping_composes_over_slices(spinning):
    cut = unwrap_heading(spinning, slice_us=3_000_000).select(*KEY, "t_us", "theta")
    same(cut, unwrap_column(spinning, "heading", KEY, "theta").select(*KEY, "t_us", "theta"))


def test_neighbours_and_least_before_over_slices(spinning):
    cut = neighbours_in_slices(spinning, KEY, ["heading"], ["heading"], slice_us=2_000_000)
    w = ts.win(KEY)
    whole = spinning.select(*KEY, "t_us", F.lag("heading").over(w).alias("p"), F.lead("heading").over(w).alias("n"),
                            F.min("heading").over(w.rowsBetween(-10 ** 6, -1)).alias("low"), ts.gradient(F.col("heading"), KEY).alias("g"))
    got = cut.select(*KEY, "t_us", F.col("_prev.heading").alias("p"), F.col("_next.heading").alias("n"),
                     F.col("_low_heading").alias("low"), ts.gradient_between("heading").alias("g"))
    clean = lambda df: df.na.fill(-99.0)
    same(clean(got), clean(whole))


@pytest.fixture(scope="module")
def busy(spark):
    """A turn, a run over a stop line with a head, a crash and a stop among movers, near and far."""
    def uturn(tid):
        n = 60
        angle = np.radians(np.linspace(90, -90, n))
        return track("busy", tid, "car", (70 + np.arange(n), np.stack([900 + 130 * np.cos(angle), 500 + 130 * np.sin(angle)], axis=1)))
    crash = [track("busy", 3, "car", join(line(3, 5, (1000, 700), (1290, 700)), still(5.08, 14, (1290, 700)))),
             track("busy", 4, "car", join(line(3, 5, (1330, 520), (1330, 690)), still(5.08, 14, (1330, 690))))]
    stop = [track("busy", 50, "car", still(4, 28, (1250, 600)))]
    over = [track("busy", 60 + k, "car", line(5 + 3 * k, 8 + 3 * k, (1000, 500), (1520, 500))) for k in range(5)]
    passers = [track("busy", 100 + k, "motorcycle", line(4 + 0.1 * k, 9 + 0.1 * k, (30, 60 + k % 20), (700, 60 + k % 20))) for k in range(200)]
    return analysis(spark, [uturn(2), *crash, *stop, *over, *passers], {"busy": 40.0})


def test_rules_of_tracks_and_pairs_do_not_depend_on_slices(busy):
    for rule in (V.illegal_u_turn, V.illegal_turn):
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(rule(busy, slice_us=2_000_000)) == rows(rule(busy, slice_us=WHOLE))
    assert V.illegal_u_turn(busy, slice_us=2_000_000).count() == 1
    series = C.conflict_series(busy)
    cut, whole = (C.accident_spans(series, slice_us=s) for s in (2_000_000, WHOLE))
    same(cut, whole)
    none = cut.limit(0)
    assert sorted(map(tuple, C.near_miss_spans(series, none, slice_us=2_000_000).collect())) == sorted(
        map(tuple, C.near_miss_spans(series, none, slice_us=WHOLE).collect()))
    a, b = (sorted(map(tuple, J.line_crossings(busy, slice_us=s).collect())) for s in (2_000_000, WHOLE))
    assert a == b


def test_movers_out_of_reach_never_meet_a_stop(busy):
    stops = V.travel_direction(V.stop_candidates(busy, Stopped(zone_share=0.0)), busy).filter("track_id = 50")
    met = V.around(stops, busy, 0.8, True, V.strip_cells())
    assert met.filter("other >= 100").count() == 0     # 200 motorcycles far above the strip
    movers = busy.samples.filter("speed > 0.8").toPandas()
    (s,) = stops.collect()
    movers = movers[(movers.track_id != 50) & (movers.t_us >= s.start_us) & (movers.t_us <= s.end_us) & (movers.category != "person")]
    side = -(movers.px - s.sx) * s.dy + (movers.py - s.sy) * s.dx
    want = sorted(zip(movers.track_id[side.abs() < s.radius], movers.t_us[side.abs() < s.radius]))
    strip = F.abs(-(F.col("px") - F.col("sx")) * F.col("dy") + (F.col("py") - F.col("sy")) * F.col("dx")) < F.col("radius")
    assert sorted(map(tuple, met.filter(strip).select("other", "t_us").collect())) == want and want
    near = np.hypot(movers.px - s.sx, movers.py - s.sy) < s.radius
    disc = F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")) < F.col("radius")
    got = V.around(stops, busy, 0.8, True, V.disc_cells()).filter(disc)
    assert sorted(map(tuple, got.select("other", "t_us").collect())) == sorted(zip(movers.track_id[near], movers.t_us[near]))


def test_places_of_any_kind_meet_their_strip(spark):
    """Random stops and places, also outside the frame, against all pairs."""
    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 40)
    stops = spark.createDataFrame(pd.DataFrame({"s": range(40), "sx": rng.uniform(0, 1600, 40), "sy": rng.uniform(0, 900, 40), "radius": rng.uniform(1, 300, 40),
                                                "dx": np.cos(angle), "dy": np.sin(angle), "width": 1600, "height": 900}))
    places = spark.createDataFrame(pd.DataFrame({"p": range(300), "px": rng.uniform(-200, 1800, 300), "py": rng.uniform(-200, 1100, 300)}))
    placed = places.withColumn("cell", V.frame_cell(F.col("px"), F.col("py"), F.lit(1600), F.lit(900)))
    rx, ry = F.col("px") - F.col("sx"), F.col("py") - F.col("sy")
    for cells, near in ((V.strip_cells(), F.abs(-rx * F.col("dy") + ry * F.col("dx"))), (V.disc_cells(), F.hypot(rx, ry))):
        met = stops.withColumn("cell", F.explode(cells)).join(placed, "cell")
        inside = near < F.col("radius")
        same(met.filter(inside).select("s", "p"), stops.join(F.broadcast(places), inside).select("s", "p"))
        assert met.count() < 0.75 * 40 * 300


def test_pixels_meet_heads_by_cell(spark):
    """Boxes over several cells, that overlap, that are empty or lie beyond the frame; heads without lit pixels."""
    rng = np.random.default_rng(7)
    px = [("v", int(f), int(x), int(y), *map(int, c)) for f, x, y, c in zip(
        rng.integers(0, 3, 4000), rng.integers(0, 200, 4000), rng.integers(0, 150, 4000), rng.choice([(250, 20, 20), (20, 240, 30), (250, 180, 20), (40, 40, 40)], 4000))]
    pixels = spark.createDataFrame(px, "video_id string, frame_idx int, x int, y int, r int, g int, b int")
    boxes = [("v", "a", "vehicle", 10.5, 3.2, 90.1, 99.9), ("v", "b", "pedestrian", 64.0, 32.0, 96.0, 64.0), ("v", "c", "vehicle", 60.0, 20.0, 70.0, 40.0),
             ("v", "d", "vehicle", 5.0, 5.0, 5.0, 9.0), ("v", "e", "vehicle", -20.0, -5.0, 12.0, 8.0), ("w", "a", "vehicle", 0.0, 0.0, 50.0, 50.0)]
    heads = spark.createDataFrame(boxes, "video_id string, head string, kind string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame_idx, r["head"]): (r.red, r.amber, r.green) for r in SG.head_state(pixels, heads).collect()}
    want = {}
    for _, f, x, y, *c in px:
        for v, h, kind, x1, y1, x2, y2 in boxes:
            if v == "v" and max(0, math.floor(x1)) <= x < math.ceil(x2) and max(0, math.floor(y1)) <= y < math.ceil(y2):
                n = want.setdefault((f, h), [0, 0, 0])
                hue = {250: 0 if c[1] == 20 else 1, 20: 2}.get(c[0])
                if hue is not None:
                    n[0 if kind == "pedestrian" and hue == 1 else hue] += 1
    assert got == {k: tuple(v) for k, v in want.items()}

"""Operators against brute force on small inputs."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import cues as C, intervals as I, signals as SG, timeseries as ts, tracks as T
from lanewise.operators.assign import best_assignment
from lanewise.operators.medians import exact_median
from lanewise.operators.pairs import unwrap_heading
from lanewise.operators.slices import lag_in_slices, prefix_in_slices
from scenes import FPS, H, W, line, still, join, track

US = 1_000_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_runs(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("slice_us", [5 * US, 3600 * US])
def test_runs_do_not_depend_on_slices(spark, slice_us):
    rng = random.Random(1)
    times = {k: sorted(rng.sample(range(0, 4000), 300)) for k in range(3)}
    rows = [(k, t * 10_000) for k, ts_ in times.items() for t in ts_]
    got = I.runs(frame(spark, rows, "k int, t_us long"), ["k"], 0.1, step=None, slice_us=slice_us).collect()
    for k in times:
        want = brute_runs([t * 10_000 for t in times[k]], 100_000)
        assert sorted((r.start_us, r.end_us) for r in got if r.k == k) == want


def test_runs_gap_grows_with_the_sampling_step(spark):
    rows = [(1, t * US, 2.0 * US) for t in (0, 2, 4, 9, 11)]
    got = I.runs(frame(spark, rows, "k int, t_us long, step_us double"), ["k"], 0.5).orderBy("start_us").collect()
    assert [(r.start_us // US, r.end_us // US) for r in got] == [(0, 4), (9, 11)]


def test_merge_is_inclusive_and_blocks_do_not_matter(spark):
    segs = [("v", 0.0, 1.0), ("v", 2.0, 3.0), ("v", 4.5, 9.0), ("v", 5.0, 6.0), ("v", 10.0, 11.0)]
    df = frame(spark, segs, "k string, start_sec double, end_sec double")
    for block in (1.0, 600.0):
        got = sorted((r.start_sec, r.end_sec) for r in I.merge_segments(df, ["k"], 1.0, block=block).collect())
        assert got == [(0.0, 3.0), (4.5, 11.0)]
    strict = sorted((r.start_sec, r.end_sec) for r in I.merge_segments(df, ["k"], 1.0, strict=True).collect())
    assert strict == [(0.0, 1.0), (2.0, 3.0), (4.5, 9.0), (10.0, 11.0)]


def test_clean_events_keeps_the_earlier_segment(spark):
    ev = [("v", 0, "1", "5", "accident"), ("v", 1, "4", "9", "accident"), ("v", 2, "5", "99", "accident"),
          ("v", 3, "x", "2", "accident"), ("v", 4, "1", "2", "nonsense"), ("v", 5, "7", "7", "red_light")]
    videos = frame(spark, [("v", 20.0)], "video_id string, duration double")
    out = I.clean_events(frame(spark, ev, "video_id string, pos long, start_sec string, end_sec string, label string"), videos, ["accident", "red_light"])
    got = {r.pos: (r.end_sec, r.problem) for r in out.collect()}
    assert got[0] == (5.0, None) and got[1] == (9.0, "overlap") and got[2] == (20.0, None)
    assert [got[k][1] for k in (3, 4, 5)] == ["not_numeric", "bad_label", "bad_times"]


def test_lag_and_prefix_cross_slices(spark):
    rows = [(1, t, t % 7) for t in (0, 1, 5, 50, 51, 300, 999)]
    df = frame(spark, rows, "k int, t_us long, v long")
    lag = lag_in_slices(df, ["k"], {"p": "v"}, ["t_us"], slice_us=10).orderBy("t_us").collect()
    assert [r.p for r in lag] == [None] + [v for _, _, v in rows][:-1]
    pre = prefix_in_slices(df, ["k"], F.col("v"), "sum", ["t_us"], "s", F.floor(F.col("t_us") / 10)).orderBy("t_us").collect()
    assert [r.s for r in pre] == np.cumsum([v for *_, v in rows]).tolist()


def test_exact_median_of_a_hot_group(spark):
    rng = np.random.default_rng(0)
    parts = {k: rng.normal(50, 9, n).round(k % 3) for k, n in enumerate((1, 2, 7, 400, 401))}
    rows = [(k, float(v), len(p)) for k, p in parts.items() for v in p]
    got = {r.k: r.median for r in exact_median(frame(spark, rows, "k int, v double, n long"), ["k"], "v", "n", width=2.0, hot=5).collect()}
    for k, p in parts.items():
        assert got[k] == pytest.approx(np.median(p))


def test_smoothing_and_derivatives_match_a_loop(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(np.arange(0, 40_000_000, 80_000), 200, replace=False))
    x = rng.normal(0, 10, len(t)).cumsum()
    df = frame(spark, [(1, int(a), float(b)) for a, b in zip(t, x)], "k int, t_us long, x double")
    out = df.withColumns({"g": ts.gaussian_smooth(["x"], 0.25, ["k"])["x"], "d": ts.derivative("x", 0.4, ["k"]),
                          "gr": ts.gradient(F.col("x"), ["k"]), "m": ts.range_median("x", -1.1, -0.5, ["k"])}).toPandas().sort_values("t_us")
    s = t / US
    for i in range(len(t)):
        near = np.abs(t - t[i]) <= 750_000
        w = np.exp(-0.5 * ((s[near] - s[i]) / 0.25) ** 2)
        assert out.g.iloc[i] == pytest.approx((w * x[near]).sum() / w.sum())
        near = np.flatnonzero(np.abs(t - t[i]) <= 400_000)
        lo, hi = min(near[0], max(i - 1, 0)), max(near[-1], min(i + 1, len(t) - 1))
        assert out.d.iloc[i] == pytest.approx((x[hi] - x[lo]) / (s[hi] - s[lo]))
        back = x[(t >= t[i] - 1_100_000) & (t <= t[i] - 500_000)]
        assert (np.isnan(out.m.iloc[i]) and not len(back)) or out.m.iloc[i] == pytest.approx(np.median(back))
    assert np.allclose(out.gr, np.gradient(x, s))


def _kin(spark, tracks, **kw):
    obs = pd.concat(tracks)
    obs["t_us"] = obs["frame_idx"].astype("int64") * 80_000
    obs = spark.createDataFrame(obs, "video_id string, track_id long, frame_idx int, category string, x1 double, y1 double, x2 double, y2 double, t_us long")
    videos = frame(spark, [("v", W, H)], "video_id string, width int, height int")
    return T.kinematics(obs, T.majority_category(obs), videos, **kw)


def test_kinematics_do_not_depend_on_slices(spark):
    path = join(line(0, 20, (100, 300), (900, 500)), still(20.08, 70, (900, 500)), line(70.08, 90, (900, 500), (300, 800)))
    whole = _kin(spark, [track("v", 1, "car", path)]).toPandas().sort_values("t_us")
    cut = _kin(spark, [track("v", 1, "car", path)], slice_us=30 * US).toPandas().sort_values("t_us")
    assert len(whole) == len(cut) == len(path[0])
    for c in ("px", "py", "size", "vx", "vy", "speed", "accel"):
        assert np.allclose(whole[c], cut[c], atol=1e-9), c
    assert whole.loc[whole.t_us == 45 * US, "heading"].isna().all()


def test_unwrapped_heading_has_no_jumps(spark):
    ang = np.linspace(0, 4 * np.pi, 200)
    path = (np.arange(200), np.stack([800 + 200 * np.cos(ang), 500 + 200 * np.sin(ang)], axis=1))
    th = unwrap_heading(_kin(spark, [track("v", 1, "car", path)])).toPandas().sort_values("t_us").theta
    assert np.abs(np.diff(th)).max() < 0.5 and abs(th.iloc[-1] - th.iloc[0]) > 11


def test_flicker_is_bridged(spark):
    rows = [("v", "h", f, f * 80_000, "red" if f % 7 else "unknown") for f in range(125)]
    tl = SG.signal_timeline(frame(spark, rows, "video_id string, head string, frame_idx int, t_us long, state string"))
    got = tl.toPandas()
    assert (got[got.t_us >= US].code == 1).all()


def test_assignment_is_optimal():
    from itertools import permutations
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        s = np.where(rng.random((n, m)) < 0.3, 0.0, rng.random((n, m)))
        pairs = best_assignment(s)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        k = max(n, m)
        full = np.zeros((k, k))
        full[:n, :m] = s
        best = max(sum(full[i, p[i]] for i in range(k)) for p in permutations(range(k)))
        assert sum(s[p] for p in pairs) == pytest.approx(best)


def test_blobs_match_flood_fill(spark):
    rng = np.random.default_rng(7)
    img = rng.random((20, 25)) < 0.35
    rows = [("v", 1, int(y), int(x)) for y, x in zip(*np.nonzero(img))]
    got = C.label_blobs(frame(spark, rows, "video_id string, cue_idx long, y int, x int"), ["video_id", "cue_idx"]).toPandas()
    left, want = {(y, x) for _, _, y, x in rows}, []
    while left:
        todo, blob = [left.pop()], []
        while todo:
            y, x = todo.pop()
            blob.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        b = np.array(blob)
        want.append((len(b), b[:, 1].min(), b[:, 0].min(), b[:, 1].max(), b[:, 0].max(), round(b[:, 1].mean(), 6), round(b[:, 0].mean(), 6)))
    have = [(r.area, r.x1, r.y1, r.x2, r.y2, round(r.cx, 6), round(r.cy, 6)) for r in got.itertuples()]
    assert sorted(have) == sorted(want)


def test_persistent_objects_group_by_place(spark):
    rows = [("v", t * US, 1, 30 if t < 20 else 32, 30, 40, 40, 35.0, 35.0, 100) for t in range(40, 52)]
    rows += [("v", t * US, 2, 100, 100, 108, 108, 104.0, 104.0, 60) for t in range(40, 44)]
    b = frame(spark, rows, "video_id string, eval_us long, blob int, x1 int, y1 int, x2 int, y2 int, cx double, cy double, area long")
    size = frame(spark, [("v", 300, 300)], "video_id string, width int, height int")
    got = C.persistent_objects(b, size).collect()
    assert [(r.start_us // US, r.end_us // US) for r in got] == [(44, 55)]


def test_scenario_rate():
    assert FPS == 12.5

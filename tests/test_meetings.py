"""Pairs met in tiles of tracks against the joins over time slices and brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.constants import Conflict
from lanewise.operators import meetings as M, pairs as P, tracks as T
from lanewise.operators.kernels import covered_counts
from lanewise.plans import conflicts as C
from scenes import analysis, track

EASY = Conflict(contact_dist=1.5, contact_iou=0.01, approach_dist=1.0, pre_speed=0.3, pre_closing=-9.0, deflect=20.0, rest=0.5, stop_speed=0.8, rest_dist=4.0,
                ttc=9.0, min_closing=0.05, max_gap=9.0, cpa=9.0, nm_keep=1.05, nm_speed=0.3)


@pytest.fixture(scope="module")
def crowd(spark):
    """Users that wander, halt and turn among each other; two come and go at other times."""
    rng = np.random.default_rng(11)
    tracks = []
    for k in range(26):
        first, n = (0, 110) if k < 24 else (60 * (k - 24), 40)
        moving = (np.arange(n) < n * rng.uniform(0.4, 1.0))[:, None]
        turn = np.cumsum(rng.normal(0, 0.25, n)) + rng.uniform(0, 6)
        place = rng.uniform((300, 250), (1100, 800)) + np.cumsum(moving * 14 * np.stack([np.cos(turn), np.sin(turn)], axis=1), axis=0)
        tracks.append(track("busy", k + 1, ["car", "person", "motorcycle", "bus"][k % 4], (first + np.arange(n), place)))
    return analysis(spark, tracks, {"busy": 40.0})


@pytest.fixture(params=[(500_000, 4096, 200_000), (150, 2, 60)], ids=["one tile", "many tiles"])
def sizes(request, monkeypatch):
    rows, tracks, step = request.param
    monkeypatch.setattr(M, "TRACKS", tracks)
    monkeypatch.setattr(M, "STEP", step)
    monkeypatch.setattr(M.meetings, "__defaults__", (Conflict(), rows))
    monkeypatch.setattr(C.M, "split_long", lambda users: (users, None))


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_pairs_events_and_series_equal_the_sliced_joins(crowd, sizes):
    users, _ = C.pair_users(crowd, EASY)
    pairs = P.sliced_candidates(users, EASY)
    assert rows(P.candidate_pairs(users, EASY)) == rows(pairs) and pairs.count() > 25
    want = C.sliced_series(users, EASY)
    cols = ["video_id", "a_id", "b_id", "t_us", "dist", "closing", "iou", "ok", "dt_us", "a_heading", "b_speed", "b_last_us"]
    assert rows(C.conflict_series(crowd, EASY).select(cols).na.fill(-9)) == rows(want.select(cols).na.fill(-9))
    hits = C.accident_spans(want, EASY)
    both = C.events(hits, "accident").unionByName(C.events(C.near_miss_spans(want, hits, EASY), "near_miss"))
    got = rows(C.conflict_events(crowd, EASY))
    assert got == rows(both) and {r[3] for r in got} == {"accident", "near_miss"} and len(got) > 4
    assert rows(C.accident(crowd, p=EASY)) == rows(C.events(hits, "accident"))
    best = {r[:3]: r[3] for r in rows(want.groupBy(*P.PAIR).agg(F.max("iou").alias("iou")))}
    assert best.items() <= {r[:3]: r[3] for r in rows(P.pair_ious(users, EASY))}.items()


def test_events_are_made_without_rows_of_pairs(crowd):
    plan = C.conflict_events(crowd, EASY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Window" not in plan and "Generate" not in plan


def test_a_video_with_a_track_too_long_for_a_task_is_joined_over_slices(crowd, monkeypatch):
    whole = rows(C.conflict_events(crowd, EASY))
    monkeypatch.setattr(M.split_long, "__defaults__", (80,))
    assert rows(C.conflict_events(crowd, EASY)) == whole


def test_covered_share_equals_all_boxes(spark):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 600, 900), rng.uniform(0, 300, 900)
    data = [("v", int(k % 60), int(k // 60 % 40), ["person", "car", "bicycle"][k % 60 % 3], float(x[k]), float(y[k]), float(x[k] + rng.uniform(1, 150)), float(y[k] + rng.uniform(1, 90)))
            for k in range(900)]
    samples = spark.createDataFrame(data, "video_id string, track_id long, frame_idx int, category string, x1 double, y1 double, x2 double, y2 double")

    def covers(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        return max(w, 0) * max(h, 0) / ((a[6] - a[4]) * (a[7] - a[5])) > 0.3
    people = [a for a in data if a[3] == "person"]
    hit = {(a[1], a[2]): any(b[2] == a[2] and covers(a, b) for b in data if b[3] != "person") for a in people}
    want = sorted(("v", t, sum(h for (k, _), h in hit.items() if k == t) / sum(k == t for k, _ in hit)) for t in {a[1] for a in people})
    assert rows(T.covered_share(samples)) == [(v, t, round(c, 6)) for v, t, c in want] and len({c for _, _, c in want}) > 3
    whole = samples.withColumn("person", F.col("category") == "person").toArrow()
    few = covered_counts(whole, 0.3, step=7).to_pylist()
    assert [(r["track_id"], round(r["n_hit"] / r["n"], 6)) for r in few] == [(t, round(c, 6)) for _, t, c in want]

"""Scores against a plain-Python version on small random inputs, and file round trips."""
import functools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import intervals as I
from lanewise.plans import evaluate as E
from lanewise.sources import results as R

EV = "video_id string, label string, pos long, start_sec double, end_sec double"


def tiou(a, b):
    inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return inter / (a[1] - a[0] + b[1] - b[0] - inter)


@pytest.mark.parametrize("component, block", [(50_000, 600.0), (6, 5.0)])
def test_greedy_matching_in_components(spark, component, block):
    """Against the greedy order over all pairs: many ties, chains over time blocks, a hot class; small components force the rounds."""
    rng = np.random.default_rng(11)
    truth, pred = ([(f"v{k % 3}", k, float(s), float(s + n), "a" if k % 4 else "b") for k, (s, n) in enumerate(zip(rng.integers(0, 160, m), rng.integers(1, 9, m)))]
                   for m in (150, 170))

    def iou(g, p):
        inter = max(0.0, min(g[3], p[3]) - max(g[2], p[2]))
        return inter / (g[3] - g[2] + p[3] - p[2] - inter)

    want = set()
    for key in {(g[0], g[4]) for g in truth}:
        pairs = sorted(((iou(g, p), g[1], p[1]) for g in truth for p in pred if (g[0], g[4]) == key == (p[0], p[4]) and iou(g, p) >= 0.3), reverse=True)
        used_g, used_p = set(), set()
        for _, i, j in pairs:
            if i not in used_g and j not in used_p:
                used_g.add(i), used_p.add(j), want.add((*key, i, j))
    t, p = (spark.createDataFrame([(v, label, k, a, b) for v, k, a, b, label in rows], EV) for rows in (truth, pred))
    by_block = functools.partial(I.time_components, block=block)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(E, "time_components", by_block)
        got = E.match_segments(t, p, ["video_id", "label"], component=component).collect()
    assert {(r.video_id, r.label, r.i, r.j) for r in got} == want and len(got) == len(want)
    assert E.match_segments(t.limit(0), p, ["video_id", "label"]).count() == 0


def test_dense_matching_without_a_table_of_pairs(spark):
    """Tiles of time decide nearly all before pairs become rows, however many segments share a time; the matches are those of the pairs."""
    rng = np.random.default_rng(5)
    truth, pred = ([("v", "a", int(k), float(s), float(s + n / 2)) for k, s, n in zip(rng.permutation(m), rng.integers(0, 300, m), rng.integers(1, 13, m))]
                   for m in (700, 900))
    t, p = spark.createDataFrame(truth, EV), spark.createDataFrame(pred, EV)
    rows, plain = [], E.match_candidates

    def counted(*args):
        out = plain(*args)
        rows.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(E, "match_candidates", counted)
        got = {(r.i, r.j, r.iou) for r in E.match_segments(t, p, ["video_id", "label"]).collect()}
    assert sum(rows) < 100 < 5_000 < plain(t, p, ["video_id", "label"], 0.3).count()
    assert got == {(r.i, r.j, r.iou) for r in E.match_segments(t, p, ["video_id", "label"], tiles=()).collect()}


def test_stretches_of_time(spark):
    rng = np.random.default_rng(4)
    rows = [("v" if k % 5 else "w", k, float(s), float(s + n)) for k, (s, n) in enumerate(zip(rng.integers(0, 900, 300), rng.choice([0, 1, 2, 3, 80], 300, p=[.2, .3, .3, .18, .02])))]
    got = I.time_components(spark.createDataFrame(rows, "video_id string, k long, s double, e double"), ["video_id"], "s", "e", ["k"], "part", 20.0).collect()
    for video in "vw":
        reach, part = -1.0, None
        for r in sorted((r for r in got if r.video_id == video), key=lambda r: (r.s, r.e, r.k)):
            part = r.s if r.s > reach else part
            reach = max(reach, r.e)
            assert r.part == part
    assert len(got) == 300


def test_greedy_matching(spark):
    rng = random.Random(4)
    seg = lambda: (lambda s: (s, s + rng.choice([1, 2, 3, 5])))(rng.randint(0, 60))
    truth = [("v", "a", k, *map(float, seg())) for k in range(40)]
    pred = [("v", "a", k, *map(float, seg())) for k in range(50)]
    got = {(r.i, r.j) for r in E.match_segments(spark.createDataFrame(truth, EV), spark.createDataFrame(pred, EV), ["video_id", "label"]).collect()}
    order = sorted(((tiou(t[3:], p[3:]), t[2], p[2]) for t in truth for p in pred if tiou(t[3:], p[3:]) >= 0.3), reverse=True)
    want, used_i, used_j = set(), set(), set()
    for _, i, j in order:
        if i not in used_i and j not in used_j:
            want.add((i, j))
            used_i.add(i)
            used_j.add(j)
    assert got == want


def test_perfect_predictions_score_one(spark):
    truth = [("v", "accident", 0, 20.0, 26.0), ("v", "red_light", 1, 3.0, 5.0)]
    ev = spark.createDataFrame(truth, EV)
    curve = spark.createDataFrame([("v", t, float(t), 0.9 if 15 <= t < 20 else 0.1) for t in range(60)], "video_id string, pos long, t double, score double")
    videos = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    rep = E.evaluate(ev, ev, curve, videos, videos)
    s = rep.scores.collect()[0]
    assert s.score_a == 1.0 and s.score_b == pytest.approx(0.4 + 0.4 + 0.2 * 0.5)
    assert s.model_score == pytest.approx(0.7 + 0.3 * s.score_b)
    lines = [(r.section, json.loads(r.body)) for r in E.report_lines(rep).collect()]
    assert {b["video_id"] for s, b in lines if s == "missing_videos"} == {r.video_id for r in rep.diff.filter("status = 'missing'").collect()}
    assert {b["video_id"] for s, b in lines if s == "extra_videos"} == {r.video_id for r in rep.diff.filter("status = 'extra'").collect()}
    assert sum(s == "per_video" for s, _ in lines) == rep.per_video.count()
    for label in {b["label"] for s, b in lines if s == "per_class"}:
        f1 = [b["f1"] for s, b in lines if s == "per_class" and b["label"] == label]
        assert all(b["f1_mean"] == pytest.approx(sum(f1) / len(f1)) for s, b in lines if s == "per_class" and b["label"] == label)
    assert json.loads(E.report_row(rep).select(F.to_json(F.struct("*"))).first()[0])["part_b"]["n_matched"] == 1


def test_no_accident_scores_part_a_only(spark):
    ev = spark.createDataFrame([("v", "red_light", 0, 3.0, 5.0)], EV)
    curve = spark.createDataFrame([("v", 0, 0.0, 0.1)], "video_id string, pos long, t double, score double")
    videos = spark.createDataFrame([("v", 60.0)], "video_id string, duration double")
    s = E.evaluate(ev, ev, curve, videos, videos).scores.collect()[0]
    assert s.score_b is None and s.model_score == 1.0


def test_alarms_split_by_low_rows_and_joined_by_time(spark):
    curve = [("v", k, t, s) for k, (t, s) in enumerate([(0.0, .6), (1.0, .1), (1.9, .7), (5.0, .8), (8.0, .2), (10.0, .5)])]
    got = E.alarm_starts(spark.createDataFrame(curve, "video_id string, pos long, t double, score double"))
    assert sorted(r.t for r in got.collect()) == [0.0, 10.0]


def test_files_round_trip(spark, tmp_path):
    doc = {"team": "t", "videos": {"a.mp4": {"events": [[1.0, 2.5, "red_light"], [3, 4, "accident"]], "risk": [[0.0, 0.1], [0.04, 0.7]]},
                                   "b.mp4": {"events": [], "risk": []}}}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    v, ev, rk = R.read_predictions(spark, str(tmp_path / "p.json"))
    assert sorted(r.video_id for r in v.collect()) == ["a.mp4", "b.mp4"]
    assert [(r.pos, r.start_sec, r.label) for r in ev.orderBy("pos").collect()] == [(0, 1.0, "red_light"), (1, 3.0, "accident")]
    out = str(tmp_path / "out")
    R.write_predictions(v, ev, rk, out, "t")
    v2, ev2, rk2 = R.read_predictions(spark, out)
    assert v2.count() == 2 and rk2.count() == 2
    assert sorted((r.start_sec, r.end_sec, r.label) for r in ev2.collect()) == [(1.0, 2.5, "red_light"), (3.0, 4.0, "accident")]
    lv, _ = R.import_labels(spark, str(tmp_path / "p.json"))
    assert {(r.duration, r.fps) for r in lv.collect()} == {(0.0, 25.0)}


def test_long_lists_come_back_whole_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    videos = spark.createDataFrame([(f"v{k}.mp4", 9000.0, 25.0) for k in range(3)], "video_id string, duration double, fps double")
    rows = [(f"v{k % 2}.mp4", k // 2, float(k * 997 % 8000), float(k * 997 % 8000) + 1.5, 'say "x", ü') for k in range(90)]
    ev = spark.createDataFrame(rows, "video_id string, pos long, start_sec double, end_sec double, label string")
    rk = spark.createDataFrame([(f"v{k % 2}.mp4", k // 2, k * 90.0, k / 100) for k in range(80)], "video_id string, pos long, t double, score double")
    R.export_labels(videos, ev, str(tmp_path / "truth"))
    R.write_predictions(videos, ev, rk, str(tmp_path / "pred"))
    key = lambda df: sorted(tuple(r) for r in df.select("video_id", "pos", "start_sec", "end_sec", "label").collect())
    for read in (R.read_ground_truth, R.import_labels):
        v, back = read(spark, str(tmp_path / "truth"))
        assert key(back) == sorted(rows) and sorted(tuple(r) for r in v.collect()) == sorted(tuple(r) for r in videos.collect())
    v, back, risk = R.read_predictions(spark, str(tmp_path / "pred"))
    assert key(back) == sorted(rows) and v.count() == 3 and sorted(tuple(r) for r in risk.collect()) == sorted(tuple(r) for r in rk.collect())
    _, untimed, _ = R.prediction_tables(R.prediction_documents(videos, ev.drop("pos"), rk, "t"))
    assert [r.start_sec for r in untimed.where("video_id = 'v1.mp4'").orderBy("pos").collect()] == sorted(x[2] for x in rows if x[0] == "v1.mp4")


def test_format_check_names_each_problem(spark, tmp_path):
    doc = {"videos": {"a.mp4": {"events": [[1, 3, "accident"], [2, 4, "accident"], [1, "2", "accident"], [True, 2, "accident"], [5, 4, "accident"],
                                          [1, 2, "nope"], [1, 2], [90, 99, "red_light"]], "risk": [[0, 0.1], [1, 1.5], [0.5, 0.1]]},
                      "x/y.mp4": {"events": []}, "c.mp4": {"events": 3}}}
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    docs = spark.read.text(str(tmp_path / "bad.json"), wholetext=True)
    files, entries, ev, rk = R.raw_items(docs)
    assert not files.first().has_team
    videos = spark.createDataFrame([("a.mp4", 60.0), ("z.mp4", 9.0)], "video_id string, duration double")
    got = {(r.video_id, r.problem, r.pos) for r in E.validate_predictions(entries, ev, rk, videos).collect()}
    assert {("a.mp4", "overlap", 1), ("a.mp4", "not_numeric", 2), ("a.mp4", "not_numeric", 3), ("a.mp4", "bad_times", 4), ("a.mp4", "bad_label", 5),
            ("a.mp4", "bad_event", 6), ("a.mp4", "past_end", 7), ("a.mp4", "score_range", 1), ("x/y.mp4", "path_key", None), ("c.mp4", "bad_entry", None),
            ("z.mp4", "missing_video", None), ("x/y.mp4", "extra_video", None), ("x/y.mp4", "no_risk", None)} <= got
    assert not any(p == "time_order" for _, p, _ in got)   # only the first bad point counts


def test_items_are_taken_apart_once(spark):
    """The problems are read from plain columns; no branch takes a VARIANT apart again."""
    doc = json.dumps({"team": "t", "videos": {"v": {"events": [[0, 1, "accident"], [0.5, "x", "accident"], [2, 1, "no"]], "risk": [[0, 0.5], [1, 7]]}}})
    _, entries, ev, rk = R.raw_items(spark.createDataFrame([(doc,)], "value string"))
    got = E.validate_predictions(entries.select("video_id", "ok"), ev, rk)
    taken = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "schema_of_variant" in line]
    assert taken == []
    assert sorted((r.problem, r.pos) for r in got.collect()) == [("bad_label", 2), ("bad_times", 2), ("not_numeric", 1), ("score_range", 1)]


def test_format_check_of_documents_and_risk_lists(spark):
    docs = spark.createDataFrame([('{"team": "t", "videos": {"a": {"events": [], "risk": "x"}, "b": {"events": [], "risk": null}, "c": {"events": []}, "d": {"events": [], "risk": []}}}',),
                                  ('{"videos": {}}',), ('{"team": "t", "videos": [1]}',), ("[1, 2]",)], "value string")
    files, entries, ev, rk = R.raw_items(docs)
    got = [(r.level, r.video_id, r.problem) for r in E.validate_predictions(entries, ev, rk, files=files).collect()]
    assert sorted(got, key=str) == sorted([("error", "a", "bad_risk"), ("error", "b", "bad_risk"), ("warning", "c", "no_risk"), ("warning", "d", "no_risk"),
                                           ("error", None, "bad_top_level"), ("error", None, "bad_top_level"), ("warning", None, "no_team")], key=str)

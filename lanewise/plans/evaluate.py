"""Scoring predictions against truth.

Events: video_id, label, pos (unique order key), start_sec, end_sec.
Risk curve: video_id, pos, t, score. Videos: video_id, duration.
"""
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (ALARM_GAP, ALARM_WINDOW, CLASSES, HORIZON, THETA, TIOU_THRESHOLDS, W_AP, W_F1, W_MTTA,
                         WEIGHT_A, WEIGHT_B)
from ..operators.greedy import match_in_tiles
from ..operators.intervals import merge_segments, overlapping, points_in, time_components, time_parts
from ..operators.ordered import ordered_scan
from ..operators.slices import lag_in_slices, prefix_in_slices
from ..session import materialise

CURVE_SLICE = 65_536
COMPONENT = 50_000  # candidates of a stretch of time that one task matches
TILES = ((60.0, 0.0), (60.0, 30.0), (600.0, 0.0), (600.0, 300.0))  # length and shift of the tiles of time that decide before any pair is a row


def tiou(a="", b="p_") -> Column:
    c = F.col
    inter = F.greatest(F.lit(0.0), F.least(c(a + "end_sec"), c(b + "end_sec")) - F.greatest(c(a + "start_sec"), c(b + "start_sec")))
    union = (c(a + "end_sec") - c(a + "start_sec")) + (c(b + "end_sec") - c(b + "start_sec")) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def match_candidates(truth: DataFrame, pred: DataFrame, keys: list[str], floor: float, block: float = 10.0) -> DataFrame:
    """Overlapping (truth i, prediction j) with temporal IoU of at least ``floor``, and the time (lo, hi) both cover together."""
    t = truth.select(*keys, F.col("pos").alias("i"), "start_sec", "end_sec")
    p = pred.select(*keys, F.col("pos").alias("j"), F.col("start_sec").alias("p_start_sec"), F.col("end_sec").alias("p_end_sec"))
    met = overlapping(t, p, keys, ("start_sec", "end_sec"), ("p_start_sec", "p_end_sec"), block)
    return met.withColumn("iou", tiou()).filter(F.col("iou") >= floor).select(
        *keys, "i", "j", "iou", F.least("start_sec", "p_start_sec").alias("lo"), F.greatest("end_sec", "p_end_sec").alias("hi"))


def match_segments(truth: DataFrame, pred: DataFrame, keys: list[str], floor: float = min(TIOU_THRESHOLDS),
                   block: float = 10.0, component: int = COMPONENT, tiles=TILES) -> DataFrame:
    """Greedy one-to-one matching by descending IoU, ties to the higher truth then prediction position.

    Tiles of time decide first what they can, holding pairs of distinct segments only while they do (``match_in_tiles``); what waits
    for a segment that crosses a border goes on to other tiles, and the few left become rows of candidates.

    Candidates that could compete share time, so each stretch of time without a hole is matched by itself: its candidates reach one
    task in greedy order and pass it in one go. A stretch of more than ``component`` candidates first loses the pairs that are the best
    choice of both their segments, which are exactly the ones the greedy order takes before touching either, and all their
    rivals; what is left falls apart into shorter stretches. Higher thresholds need no run of their own: their matches are the ones
    with a large enough IoU.
    """
    out = []
    for length, shift in tiles if floor > 0 else ():
        step = materialise(match_in_tiles(truth, pred, keys, floor, length, shift))
        out.append(step.filter("kind = 0").select(*keys, "i", "j", "iou"))
        truth, pred = (step.filter(f"kind = {kind}").select(*keys, F.col(at).alias("pos"), "start_sec", "end_sec") for kind, at in ((1, "i"), (2, "j")))
        if truth.isEmpty() or pred.isEmpty():
            return reduce(DataFrame.unionByName, out)
    edges = match_candidates(truth, pred, keys, floor, block)
    while True:
        parts = time_components(edges, keys, "lo", "hi", ["i", "j"], "part")
        large = parts.groupBy(*keys, "part").count().filter(F.col("count") > component).drop("count")
        if large.isEmpty():
            out.append(_in_order(parts, keys))
            return reduce(DataFrame.unionByName, out)
        parts, large = materialise(parts), materialise(large)
        out.append(_in_order(parts.join(large, [*keys, "part"], "left_anti"), keys))
        rest = parts.join(large, [*keys, "part"], "left_semi")
        best_i = rest.groupBy(*keys, "i").agg(F.max(F.struct("iou", "j")).alias("b")).select(*keys, "i", "b.j", "b.iou")
        best_j = rest.groupBy(*keys, "j").agg(F.max(F.struct("iou", "i")).alias("b")).select(*keys, "j", "b.i")
        won = materialise(best_i.join(best_j, [*keys, "i", "j"]).select(*keys, "i", "j", "iou"))
        out.append(won)
        edges = (rest.drop("part").join(won.select(*keys, "i"), [*keys, "i"], "left_anti")
                 .join(won.select(*keys, "j"), [*keys, "j"], "left_anti"))


def _in_order(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The greedy matches of every stretch. A task keeps the used segments of one stretch at a time."""
    group = [*keys, "part"]

    def greedy(batches):
        now, used_i, used_j = None, set(), set()
        for batch in batches:
            take = []
            for row, (i, j, *at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "j", *group)))):
                if at != now:
                    now, used_i, used_j = at, set(), set()
                if i not in used_i and j not in used_j:
                    used_i.add(i)
                    used_j.add(j)
                    take.append(row)
            yield batch.select([*keys, "i", "j", "iou"]).take(pa.array(take, pa.int64()))

    ordered = parts.repartition(*group).sortWithinPartitions(*group, F.desc("iou"), F.desc("i"), F.desc("j")).select(*group, "i", "j", "iou")
    return ordered.mapInArrow(greedy, parts.select(*keys, "i", "j", "iou").schema)


def _rates(df: DataFrame) -> DataFrame:
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", div(2 * p * r, p + r))


def class_union(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Classes scored: all labels of the truth and of the predictions, of any video."""
    return truth.select("label").union(pred.select("label")).distinct()


def _tally(truth, pred, matches, by, taus):
    tau = F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau")
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name)) if by else df.agg(F.count("*").alias(name))
    hits = matches.select(*by, "iou", tau).filter(F.col("iou") >= F.col("tau")).groupBy(*by, "tau").agg(F.count("*").alias("tp"))
    return n(truth, "n_truth"), n(pred, "n_pred"), hits, tau


def segment_prf(truth: DataFrame, pred: DataFrame, videos: DataFrame, taus=TIOU_THRESHOLDS,
                matches: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per class and threshold, pooled over the truth's videos."""
    known = pred.join(videos.select("video_id"), "video_id", "left_semi")
    m = match_segments(truth, known, ["video_id", "label"], min(taus)) if matches is None else matches
    n_t, n_p, hits, tau = _tally(truth, known, m, ["label"], taus)
    rows = (class_union(truth, pred).select("label", tau).join(n_t, "label", "left").join(n_p, "label", "left")
            .join(hits, ["label", "tau"], "left").fillna(0, ["n_truth", "n_pred", "tp"]))
    return _rates(rows.select("label", "tau", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"),
                              (F.col("n_truth") - F.col("tp")).alias("fn")))


def micro_prf(per_class: DataFrame) -> DataFrame:
    return _rates(per_class.groupBy("tau").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def agnostic_prf(truth, pred, videos, taus=TIOU_THRESHOLDS) -> DataFrame:
    """The same with labels ignored."""
    known = pred.join(videos.select("video_id"), "video_id", "left_semi")
    m = match_segments(truth, known, ["video_id"], min(taus))
    hits = m.agg(*[F.count_if(F.col("iou") >= t).alias(f"tp{k}") for k, t in enumerate(taus)])
    n = truth.agg(F.count("*").alias("n_truth")).join(known.agg(F.count("*").alias("n_pred"))).join(hits)
    rows = n.select("n_truth", "n_pred", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tau"), F.col(f"tp{k}").alias("tp")) for k, t in enumerate(taus)])).alias("r"))
    return _rates(rows.select("r.tau", "r.tp", (F.col("n_pred") - F.col("r.tp")).alias("fp"),
                              (F.col("n_truth") - F.col("r.tp")).alias("fn")))


def per_video(truth, pred, videos, matches: DataFrame, tau: float = 0.5) -> DataFrame:
    """``tp/fp/fn`` text per video and class."""
    known = pred.join(videos.select("video_id"), "video_id", "left_semi")
    by = ["video_id", "label"]
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    rows = (n(truth, "g").join(n(known, "p"), by, "full").join(n(matches.filter(F.col("iou") >= tau), "tp"), by, "left")
            .fillna(0, ["g", "p", "tp"]))
    return rows.select(*by, "g", "p", F.format_string("%d/%d/%d", F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp")).alias("cell"))


def score_a(per_class: DataFrame) -> DataFrame:
    """Mean over classes of the mean F1 over thresholds; 0 without classes."""
    f = per_class.groupBy("label").agg(F.avg("f1").alias("f1_mean"))
    return f.agg(F.coalesce(F.avg("f1_mean"), F.lit(0.0)).alias("score_a"))


def frame_label(points: DataFrame, truth: DataFrame, block: float = 10.0) -> DataFrame:
    """``frame_label`` of (video_id, pos, t): NULL inside an accident, 1 shortly before one,
    NULL around a near miss, else 0."""
    lead = truth.filter(F.col("label").isin("accident", "near_miss")).select(
        "video_id", "label", "start_sec", "end_sec", (F.col("start_sec") - HORIZON).alias("lo"))
    hit = points_in(points.select("video_id", "pos", "t"), lead, ["video_id"], "t", "lo", "end_sec", block)
    acc = F.col("label") == "accident"
    flags = hit.groupBy("video_id", "pos").agg(
        F.bool_or(acc & (F.col("t") >= F.col("start_sec"))).alias("inside"),
        F.bool_or(acc & (F.col("t") < F.col("start_sec"))).alias("before"),
        F.bool_or(~acc).alias("near"))
    label = (F.when(F.col("inside"), F.lit(None)).when(F.col("before"), F.lit(1))
             .when(F.col("near"), F.lit(None)).otherwise(F.lit(0)))
    return points.join(flags, ["video_id", "pos"], "left").withColumn("frame_label", label.cast("int")).drop("inside", "before", "near")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: ap_raw, positive_rate, chance-normalised ap, n_frames, n_positive.

    Equal scores collapse first; the running counts then use score slices, so
    no task sees all scores.
    """
    groups = materialise(scored.groupBy("score").agg(F.sum("frame_label").alias("pos"), F.count("*").alias("n")))
    keyed = groups.withColumn("k", F.lit(0)).withColumn("neg", -F.col("score"))
    cut = F.floor(F.col("neg") * 4096)
    run = prefix_in_slices(keyed, ["k"], F.col("pos"), "sum", ["neg"], "tp", cut)
    run = prefix_in_slices(run, ["k"], F.col("n"), "sum", ["neg"], "seen", cut)
    tot = run.agg(F.sum("pos").alias("n_positive"), F.sum("n").alias("n_frames"),
                  F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("acc"))
    rate = F.coalesce(F.try_divide(F.col("n_positive"), F.col("n_frames")), F.lit(0.0))
    raw = F.coalesce(F.try_divide(F.col("acc"), F.col("n_positive")), F.lit(0.0))
    return tot.select(
        raw.alias("ap_raw"), rate.alias("positive_rate"),
        F.when(rate < 1.0, F.greatest(F.lit(0.0), F.try_divide(raw - rate, F.lit(1.0) - rate))).otherwise(F.lit(0.0)).alias("ap"),
        F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.coalesce("n_positive", F.lit(0)).alias("n_positive"))


def alarm_runs(curve: DataFrame, theta: float = THETA) -> DataFrame:
    """Maximal runs of consecutive curve rows with score >= theta: start_sec, end_sec per video."""
    rows = curve.select("video_id", "pos", "t", (F.col("score") >= theta).alias("on"),
                        F.floor(F.col("pos") / CURVE_SLICE).alias("slice"))
    w = Window.partitionBy("video_id", "slice").orderBy("pos")
    here = F.struct("on", "t")
    body = rows.withColumn("_p", F.lag(here).over(w)).withColumn("_n", F.lead("pos").over(w))
    # turns of the curve and the rows at slice borders decide everything
    edge = body.filter(F.col("_p").isNull() | F.col("_n").isNull() | (F.col("on") != F.col("_p.on")))
    k = Window.partitionBy("video_id").orderBy("pos")
    edge = (edge.withColumn("_p", F.coalesce("_p", F.lag(here).over(k)))
            .withColumn("last_t", F.max_by("t", "pos").over(Window.partitionBy("video_id"))))
    turns = edge.filter(F.col("on") != F.coalesce("_p.on", F.lit(False)))
    return (turns.withColumn("stop", F.lead("_p.t").over(k)).filter("on")
            .select("video_id", F.col("t").alias("start_sec"), F.coalesce("stop", "last_t").alias("end_sec")))


def alarm_starts(curve: DataFrame, theta: float = THETA, gap: float = ALARM_GAP) -> DataFrame:
    """Alarm onsets: runs less than ``gap`` apart are one alarm."""
    merged = merge_segments(alarm_runs(curve, theta), ["video_id"], gap, strict=True)
    return merged.select("video_id", F.col("start_sec").alias("t"))


class _MatchAlarms:
    """Accidents in time order take the earliest free alarm of the last ``window`` seconds."""

    def __init__(self, window):
        self.window, self.free = window, []

    def feed(self, pdf):
        gain = []
        for t, kind in zip(pdf["t"].to_numpy(), pdf["kind"].to_numpy()):
            if kind == 1:
                self.free.append(t)
                gain.append(None)
                continue
            while self.free and self.free[0] < t - self.window:
                self.free.pop(0)
            gain.append(t - self.free.pop(0) if self.free and self.free[0] < t else 0.0)
        return pdf.assign(tta=gain)

    def close(self):
        return None


def match_alarms(truth: DataFrame, alarms: DataFrame, window: float = ALARM_WINDOW) -> DataFrame:
    """Seconds of warning per accident (0 = none): video_id, t, tta."""
    acc = truth.filter("label = 'accident'").select("video_id", F.col("start_sec").alias("t"), F.lit(0).alias("kind"), F.col("end_sec").alias("e"))
    rows = acc.unionByName(alarms.select("video_id", "t", F.lit(1).alias("kind"), F.lit(0.0).alias("e")))
    # an alarm reaches window seconds ahead: what lies beyond a hole of that length can't compete
    parts = time_parts(rows.withColumn("until", F.col("t") + (window + 1e-6)), ["video_id"], "t", "until", ["kind", "e"], "part").drop("until")
    out = ordered_scan(parts, ["video_id", "part"], ["t", "kind", "e"], _MatchAlarms,
                       "video_id string, t double, kind int, e double, part long, tta double", window)
    return out.filter("kind = 0").select("video_id", "t", "tta")


def scored_alarms(curve: DataFrame, truth: DataFrame) -> DataFrame:
    """Alarms that do not start on an ignored frame."""
    a = alarm_starts(curve).withColumn("pos", F.bround(F.col("t") * 1e6, 0).cast("long"))
    return frame_label(a, truth).filter("frame_label is not null").select("video_id", "t")


def alarm_metrics(truth: DataFrame, curve: DataFrame, videos: DataFrame) -> DataFrame:
    """One row with the accident-anticipation scores; score_b is NULL when the truth has no accident."""
    c = curve.join(videos.select("video_id"), "video_id", "left_semi")
    ap = average_precision(frame_label(c, truth).filter("frame_label is not null"))
    alarms = materialise(scored_alarms(c, truth))
    tta = match_alarms(truth, alarms).agg(F.count("*").alias("n_accidents"), F.count_if(F.col("tta") > 0).alias("n_matched"),
                                          F.coalesce(F.sum("tta"), F.lit(0.0)).alias("tta_sum"))
    row = tta.join(alarms.agg(F.count("*").alias("n_alarms"))).join(ap)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    row = (row.withColumn("alarm_precision", div(F.col("n_matched"), F.col("n_alarms")))
           .withColumn("alarm_recall", div(F.col("n_matched"), F.col("n_accidents")))
           .withColumn("mtta_sec", div(F.col("tta_sum"), F.col("n_accidents"))))
    p, r = F.col("alarm_precision"), F.col("alarm_recall")
    row = row.withColumn("f1_alarm", div(2 * p * r, p + r))
    score = W_AP * F.col("ap") + W_F1 * F.col("f1_alarm") + W_MTTA * F.least(F.lit(1.0), F.col("mtta_sec") / ALARM_WINDOW)
    return row.withColumn("score_b", F.when(F.col("n_accidents") > 0, score)).drop("tta_sum")


def model_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """0.7 A + 0.3 B, or A alone without accidents; both inputs are one-row aggregates."""
    s = F.coalesce(WEIGHT_A * F.col("score_a") + WEIGHT_B * F.col("score_b"), F.col("score_a"))
    return a.join(b).select("score_a", "score_b", s.alias("model_score"))


def video_diff(truth_videos: DataFrame, pred_videos: DataFrame) -> DataFrame:
    """Videos only one side has: status missing (truth only) or extra (predictions only)."""
    t, p = truth_videos.select("video_id").distinct(), pred_videos.select("video_id").distinct()
    return (t.join(p, "video_id", "left_anti").withColumn("status", F.lit("missing"))
            .unionByName(p.join(t, "video_id", "left_anti").withColumn("status", F.lit("extra"))))


@dataclass
class Report:
    per_class: DataFrame
    micro: DataFrame
    agnostic: DataFrame
    per_video: DataFrame
    alarms: DataFrame
    scores: DataFrame
    diff: DataFrame


def evaluate(truth: DataFrame, pred: DataFrame, curve: DataFrame, videos: DataFrame, pred_videos: DataFrame) -> Report:
    known = pred.join(videos.select("video_id"), "video_id", "left_semi")
    m = match_segments(truth, known, ["video_id", "label"])
    per_class = materialise(segment_prf(truth, pred, videos, matches=m))
    alarms = materialise(alarm_metrics(truth, curve, videos))
    return Report(per_class, micro_prf(per_class), agnostic_prf(truth, pred, videos), per_video(truth, pred, videos, m),
                  alarms, model_score(score_a(per_class), alarms), video_diff(videos, pred_videos))


def report_row(r: Report) -> DataFrame:
    """The report as one row; it grows with the number of classes, not with the data."""
    cls = r.per_class.agg(F.sort_array(F.collect_list(F.struct("label", "tau", "tp", "fp", "fn", "precision", "recall", "f1"))).alias("per_class"))
    mic = r.micro.agg(F.sort_array(F.collect_list(F.struct("tau", "tp", "fp", "fn", "f1"))).alias("micro"))
    agn = r.agnostic.agg(F.sort_array(F.collect_list(F.struct("tau", "tp", "fp", "fn", "f1"))).alias("class_agnostic"))
    b = r.alarms.select(F.struct("*").alias("part_b"))
    n = r.diff.agg(F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if(F.col("status") == "extra").alias("n_extra"))
    return r.scores.join(cls).join(mic).join(agn).join(b).join(n)


def class_means(per_class: DataFrame) -> DataFrame:
    """Mean F1 of a class over the IoU thresholds: label, f1_mean."""
    return per_class.groupBy("label").agg(F.avg("f1").alias("f1_mean"))


def report_lines(r: Report) -> DataFrame:
    """The whole report as rows (section, body as JSON): scores, classes with their mean F1, sums, alarms, every video, and the names of missing
    and extra videos. Nothing is gathered, so it may list any number of videos; ``.write.partitionBy("section").text(path)`` stores it."""
    def section(name, rows):
        return rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))
    parts = [section("scores", r.scores), section("per_class", r.per_class.join(class_means(r.per_class), "label")), section("micro", r.micro),
             section("class_agnostic", r.agnostic), section("part_b", r.alarms), section("per_video", r.per_video),
             section("missing_videos", r.diff.filter("status = 'missing'").select("video_id")),
             section("extra_videos", r.diff.filter("status = 'extra'").select("video_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _number(v: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({v}) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'"), F.lit(False))


def _item(i: int) -> Column:
    return F.expr(f"try_variant_get(item, '$[{i}]', 'variant')")


def _array_of(n: int) -> Column:
    return F.coalesce(F.size(F.expr("try_variant_get(item, '$', 'array<variant>')")) == n, F.lit(False))


def validate_predictions(entries: DataFrame, events: DataFrame, risk: DataFrame, videos: DataFrame | None = None,
                         classes=CLASSES, files: DataFrame | None = None) -> DataFrame:
    """Format problems: level, video_id, pos, problem.

    ``entries``: video_id, ok (has an event list), risk_ok (its risk is a list or
    missing; optional); ``events`` and ``risk``: video_id, pos, item VARIANT, one
    row per list element, so numbers, strings and booleans stay apart. Only the
    first bad point of a risk curve counts. ``files``: has_team, ok (an object with
    videos), one row per document; its problems have no video.
    """
    if "risk_ok" not in entries.columns:
        entries = entries.withColumn("risk_ok", F.lit(True))

    def out(df, level, problem, pos="pos"):
        return df.select(F.lit(level).alias("level"), "video_id", (F.col(pos) if pos else F.lit(None)).cast("long").alias("pos"),
                         F.lit(problem).alias("problem") if isinstance(problem, str) else problem.alias("problem"))

    # a VARIANT costs far more to take apart than to read: each item is taken apart once and written as plain columns
    number = lambda c: F.expr(f"try_variant_get({c}, '$', 'double')").alias(c)
    ev = events.select("video_id", "pos", "item", _item(0).alias("s"), _item(1).alias("e"), _item(2).alias("l"))
    ev = materialise(ev.select("video_id", "pos", _array_of(3).alias("shape"), (_number("s") & _number("e")).alias("num"), number("s"), number("e"),
                               F.when(F.expr("schema_of_variant(l) = 'STRING'"), F.expr("try_variant_get(l, '$', 'string')")).alias("label")))
    num = ev.filter("shape and num")
    good = F.coalesce(F.col("label").isin(list(classes)), F.lit(False))
    rows = [out(ev.filter("not shape"), "error", "bad_event"), out(ev.filter("shape and not num"), "error", "not_numeric"),
            out(num.filter(~((F.col("s") >= 0) & (F.col("s") < F.col("e")))), "error", "bad_times"),
            out(num.filter(~good), "error", "bad_label")]
    labelled = num.filter(good)
    # neighbours in (start, end) order of one video and class
    seq = labelled.select("video_id", "label", "pos", "s", "e", F.floor(F.col("s") * 1e6).alias("s_us"))
    prev = lag_in_slices(seq, ["video_id", "label"], {"p_e": "e"}, ["s_us", "s", "e", "pos"], t="s_us", slice_us=600_000_000)
    rows.append(out(prev.filter(F.col("s") < F.col("p_e")), "error", "overlap"))
    r = risk.select("video_id", "pos", "item", _item(0).alias("t"), _item(1).alias("v"))
    r = materialise(r.select("video_id", "pos", number("t"), number("v"), (_array_of(2) & _number("t") & _number("v")).alias("shape")))
    r = lag_in_slices(r, ["video_id"], {"p_t": "t"}, ["pos"], t="pos", slice_us=CURVE_SLICE)
    bad = (F.when(~F.col("shape"), "bad_risk_item").when(F.col("t") < F.coalesce("p_t", F.lit(-1.0)), "time_order")
           .when(~((F.col("v") >= 0) & (F.col("v") <= 1)), "score_range"))
    first = (r.withColumn("problem", bad).filter("problem is not null")
             .groupBy("video_id").agg(F.min(F.struct("pos", "problem")).alias("f")).select("video_id", "f.pos", "f.problem"))
    rows.append(out(first, "error", F.col("problem")))
    rows.append(out(entries.filter(F.col("video_id").rlike(r"[/\\]")), "error", "path_key", None))
    rows.append(out(entries.filter(~F.col("ok")), "error", "bad_entry", None))
    rows.append(out(entries.filter("ok AND NOT risk_ok"), "error", "bad_risk", None))
    rows.append(out(entries.filter("ok AND risk_ok").join(risk.select("video_id").distinct(), "video_id", "left_anti"), "warning", "no_risk", None))
    if files is not None:
        of_file = files.withColumn("video_id", F.lit(None).cast("string"))
        rows.append(out(of_file.filter("NOT ok"), "error", "bad_top_level", None))
        rows.append(out(of_file.filter("ok AND NOT has_team"), "warning", "no_team", None))
    if videos is not None:
        late = labelled.join(videos.select("video_id", "duration"), "video_id").filter(F.col("e") > F.col("duration") + 0.5)
        rows.append(out(late, "error", "past_end"))
        rows.append(out(videos.join(entries, "video_id", "left_anti"), "error", "missing_video", None))
        rows.append(out(entries.filter("ok").join(videos, "video_id", "left_anti"), "warning", "extra_video", None))
    res = rows[0]
    for x in rows[1:]:
        res = res.unionByName(x)
    return res

"""Pairs of road users: candidates and their aligned series."""
import math

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import Conflict
from ..functions import geometry as G
from . import timeseries as ts
from .meetings import BOX, best_iou, meetings, near_pairs, split_long
from .sweep import frame_neighbours, ground_distance
from .slices import SLICE_US, lag_in_slices, own_rows, running_sums, slice_rows
from .tracks import KEY, MAX_HOLE, pedestrians, vehicle_tracks

PAIR = ["video_id", "a_id", "b_id"]


def conflict_users(samples: DataFrame, p: Conflict = Conflict()) -> DataFrame:
    """Vehicles, two-wheelers and pedestrians large enough to judge contact."""
    users = vehicle_tracks(samples).unionByName(pedestrians(samples))
    return users.filter(F.col("med_size") >= p.min_size * F.col("width"))


def candidate_pairs(users: DataFrame, p: Conflict = Conflict()) -> DataFrame:
    """Distinct pairs ever closer than ``candidate_dist`` mean sizes; two persons never pair.

    Pairs are ordered vehicles first, then by track id.
    """
    whole, long = split_long(users)
    pairs = meetings(whole, [], near_pairs, "", p)
    return pairs if long is None else pairs.unionByName(sliced_candidates(long, p))


def sliced_candidates(users: DataFrame, p: Conflict = Conflict()) -> DataFrame:
    """``candidate_pairs`` frame block by frame block, for tracks of any length."""
    rows = users.withColumn("person", F.col("category") == "person")

    def near(a, b, gap):
        return (gap < p.candidate_dist * 0.5 * (a["size"] + b["size"])) & ~(a["person"] & b["person"])

    met = frame_neighbours(rows, ["person", "track_id"], [], p.candidate_dist, "larger", near, ["track_id"])
    return met.select("video_id", F.col("a_track_id").alias("a_id"), F.col("b_track_id").alias("b_id")).distinct()


def pair_ious(users: DataFrame, p: Conflict = Conflict()) -> DataFrame:
    """The best IoU of every candidate pair over its common samples."""
    whole, long = split_long(users)
    best = meetings(whole, BOX, best_iou, "iou double", p)
    if long is None:
        return best
    side = lambda k: long.select("video_id", F.col("track_id").alias(k + "_id"), "frame_idx", *[F.col(c).alias(f"{k}_{c}") for c in BOX])
    rows = sliced_candidates(long, p).join(side("a"), ["video_id", "a_id"]).join(side("b"), ["video_id", "b_id", "frame_idx"])
    return best.unionByName(rows.groupBy(*PAIR).agg(F.max(G.box_iou("a_", "b_")).alias("iou")))


def pair_series(pairs: DataFrame, users: DataFrame, slice_us: int = SLICE_US, min_common: int = 4) -> DataFrame:
    """Samples both members have, with normalised distance, closing speed, IoU and both-in-frame flag."""
    cols = ["px", "py", "vx", "vy", "size", "speed", "heading", "x1", "y1", "x2", "y2", "at_edge", "last_us", "category",
            *[c for c in ("v_before", "v_after") if c in users.columns]]
    base = users.select("video_id", "track_id", "frame_idx", "t_us", *cols)
    a = base.select("video_id", F.col("track_id").alias("a_id"), "frame_idx", "t_us", *[F.col(c).alias("a_" + c) for c in cols])
    b = base.select("video_id", F.col("track_id").alias("b_id"), "frame_idx", *[F.col(c).alias("b_" + c) for c in cols])
    # only the time both are there: a parked car isn't copied for users that have left
    block = ts.us(10.0)
    life = users.groupBy("video_id", "track_id").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    for side in ("a", "b"):
        pairs = pairs.join(life.select("video_id", F.col("track_id").alias(f"{side}_id"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi")),
                           ["video_id", f"{side}_id"])
    both = pairs.filter(F.greatest("a_lo", "b_lo") <= F.least("a_hi", "b_hi")).select(
        *PAIR, F.explode(F.sequence(F.floor(F.greatest("a_lo", "b_lo") / block), F.floor(F.least("a_hi", "b_hi") / block))).alias("_block"))
    a = a.withColumn("_block", F.floor(F.col("t_us") / block))
    rows = both.join(a, ["video_id", "a_id", "_block"]).drop("_block").join(b, ["video_id", "b_id", "frame_idx"])
    raw = ground_distance() / (0.5 * (F.col("a_size") + F.col("b_size")))
    rows = rows.withColumn("raw", raw).withColumn("iou", G.box_iou("a_", "b_")).withColumn(
        "ok", ~F.col("a_at_edge") & ~F.col("b_at_edge"))
    # pair length first: it decides whether a pair counts at all
    n = rows.groupBy(*PAIR).agg(F.count("*").alias("n_common")).filter(F.col("n_common") >= min_common)
    by = [*PAIR, "slice"]
    rows = slice_rows(rows.join(n, PAIR, "left_semi"), ts.us(0.45 + 2 * MAX_HOLE), slice_us)
    rows = rows.withColumn("dist", ts.gaussian_smooth(["raw"], 0.15, by)["raw"]).drop("raw")
    rows = rows.withColumn("closing", -ts.gradient(F.col("dist"), by))
    rows = rows.withColumn("dt_us", F.col("t_us") - F.lag("t_us").over(ts.win(by)))
    return own_rows(rows)


def speed_windows(samples: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Median speed in [t-1.1, t-0.5] and [t+0.5, t+1.1]; both 0 when either window is empty."""
    by = ["video_id", "track_id", "slice"]
    rows = slice_rows(samples, ts.us(1.1), slice_us)
    rows = (rows.withColumn("_b", ts.range_median("speed", -1.1, -0.5, by))
            .withColumn("_a", ts.range_median("speed", 0.5, 1.1, by)))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = rows.withColumn("v_before", F.when(both, F.col("_b")).otherwise(F.lit(0.0))).withColumn(
        "v_after", F.when(both, F.col("_a")).otherwise(F.lit(0.0))).drop("_a", "_b")
    return own_rows(rows)


def unwrap_column(rows: DataFrame, heading: str, by: list[str], name: str) -> DataFrame:
    """Unwrapped heading over the non-NULL samples of a window group (constant offset per group)."""
    w = ts.win(by)
    prev = F.last(heading, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_p", prev).withColumn(
        "_fix", F.when(F.col(heading).isNull(), F.lit(0.0)).otherwise(ts.turn_fix(F.col(heading), F.col("_p"))))
    total = F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.col(heading) + total).drop("_p", "_fix")


def unwrap_heading(samples: DataFrame, min_speed: float = 0.0, exclude=None, slice_us: int = SLICE_US) -> DataFrame:
    """Moving samples with their heading made continuous (``theta``): whole turns are a running sum, so slices compose."""
    ok = F.col("heading").isNotNull() & (F.col("speed") >= min_speed)
    if exclude is not None:
        ok = ok & ~exclude
    moving = lag_in_slices(samples.filter(ok), KEY, {"_before": "heading"}, ["t_us"], slice_us=slice_us)
    fix = ts.turn_fix(F.col("heading"), F.col("_before"))
    turned = running_sums(moving, KEY, {"_turns": fix}, ["t_us"], F.floor(F.col("t_us") / slice_us))
    return turned.withColumn("theta", F.col("heading") + F.col("_turns")).drop("_before", "_turns")


def with_swerve(rows: DataFrame, who: str, by: list[str]) -> DataFrame:
    """|dθ/dt| of one member: missing headings take ``<who>_mean``, its mean over the common samples."""
    rows = rows.withColumn("_h", F.coalesce(F.col(f"{who}_heading"), F.col(f"{who}_mean"), F.lit(0.0)))
    rows = unwrap_column(rows, "_h", by, "_u")
    return rows.withColumn(f"{who}_rate", F.abs(ts.gradient(F.col("_u"), by))).drop("_h", "_u")


def on_course(p: Conflict) -> "F.Column":
    """Paths meet within ``cpa`` sizes of the smaller member in the next two seconds."""
    from ..functions.motion import closest_approach
    s = F.least("a_size", "b_size")
    d = lambda c: (F.col("b_" + c) - F.col("a_" + c)) / s
    c = closest_approach(d("px"), d("py"), d("vx"), d("vy"), 2.0)
    return F.coalesce(c["d_cpa"] <= p.cpa, F.lit(False))


DEG = math.pi / 180.0

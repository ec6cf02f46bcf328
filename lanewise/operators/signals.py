"""Traffic-signal readings: per-frame state, cleaned timeline and look-ups."""
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import MIN_LIT_PX, SIGNAL_STATES
from ..functions.motion import hsv
from ..session import sized
from .intervals import US, points_in
from .slices import SLICE_US, own_rows, running_sums, slice_rows

HEAD = ["video_id", "head"]
GRID = 32         # pixels a cell


def head_state(pixels: DataFrame, heads: DataFrame) -> DataFrame:
    """Lit-pixel vote per (video, frame, head): red, amber, green or unknown.

    ``pixels``: video_id, frame_idx, x, y, r, g, b. A pixel belongs to a head
    when it lies in its box (floor of the near corner, ceiling of the far one).
    Boxes are copied to the cells of ``GRID`` pixels they touch, so a pixel meets the heads of its cell only.
    """
    x1, y1 = (F.greatest(F.lit(0), F.floor(c).cast("int")) for c in ("x1", "y1"))
    box = heads.select("video_id", "head", "kind", x1.alias("bx1"), y1.alias("by1"),
                       F.ceil("x2").alias("bx2"), F.ceil("y2").alias("by2"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / GRID), F.floor((F.col(hi) - 1) / GRID)))
    box = (box.filter("bx1 < bx2 AND by1 < by2").withColumn("_gx", cells("bx1", "bx2")).withColumn("_gy", cells("by1", "by2")))
    inside = (F.col("x") >= F.col("bx1")) & (F.col("x") < F.col("bx2")) & (F.col("y") >= F.col("by1")) & (F.col("y") < F.col("by2"))
    c = hsv(F.col("r"), F.col("g"), F.col("b"))
    placed = pixels.withColumns({"_gx": F.floor(F.col("x") / GRID), "_gy": F.floor(F.col("y") / GRID)})
    lit = placed.join(sized(box), ["video_id", "_gx", "_gy"]).filter(inside).withColumn("c", c)
    on = (F.col("c.v") >= 90) & (F.col("c.s") >= 120)
    h = F.col("c.h")
    n = (lit.groupBy("video_id", "frame_idx", "head", "kind").agg(
        F.count_if(on & ((h <= 12) | (h >= 160))).alias("r0"),
        F.count_if(on & (h > 12) & (h <= 30)).alias("a0"),
        F.count_if(on & (h >= 45) & (h <= 100)).alias("green"))
        .withColumn("red", F.when(F.col("kind") == "pedestrian", F.col("r0") + F.col("a0")).otherwise(F.col("r0")))
        .withColumn("amber", F.when(F.col("kind") == "pedestrian", F.lit(0)).otherwise(F.col("a0"))))
    best = F.greatest("red", "amber", "green")
    state = (F.when(best < MIN_LIT_PX, "unknown").when(F.col("red") == best, "red")
             .when(F.col("amber") == best, "amber").otherwise("green"))
    return n.select("video_id", "frame_idx", "head", "red", "amber", "green", state.alias("state"))


def code_of(state: str = "state"):
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SIGNAL_STATES]), F.col(state)) - 1, F.lit(0)).cast("int")


def series_steps(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: rows, first and last row (t_us, code) and the median time step."""
    from .slices import lag_in_slices
    d = lag_in_slices(series, keys, {"_p": "t_us"}, ["t_us"]).withColumn("dt", F.col("t_us") - F.col("_p"))
    ends = F.struct("t_us", "code")
    part = d.groupBy(*keys, "dt").agg(F.count("*").alias("n"), F.min(ends).alias("lo"), F.max(ends).alias("hi"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                   F.percentile("dt", F.lit(0.5), F.col("n")).alias("step_us"))


def signal_timeline(states: DataFrame, window: float = 1.0, hold: float = 2.0, slice_us: int = SLICE_US) -> DataFrame:
    """Carry the last reading over dropouts of up to ``hold`` seconds, then a mode filter of about ``window``.

    Input: video_id, head, frame_idx, t_us, state. The filter is centred and
    odd, repeats the border rows, and ties go to the lowest code; series of
    one or two rows are not filtered. A vote over rows i - h to i + h is the
    difference of two running counts, so it may be as wide as the readings are
    fast, and needs no copies of rows.
    """
    raw = states.withColumn("code", code_of())
    rows = slice_rows(raw, int(hold * US), slice_us)
    w = Window.partitionBy(*HEAD, "slice").orderBy("t_us")
    known = F.when(F.col("code") > 0, F.struct("t_us", "code"))
    seen = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = (rows.withColumn("_s", seen).withColumn("code", F.when(
        F.col("t_us") - F.col("_s.t_us") <= int(hold * US), F.col("_s.code")).otherwise(F.lit(0))).drop("_s"))
    carried = own_rows(held).select(*HEAD, "frame_idx", "t_us", "code")
    stats = series_steps(carried, HEAD)
    k = F.greatest(F.lit(1), F.bround(F.lit(window) / F.greatest(F.col("step_us") / US, F.lit(1e-3)), 0).cast("long"))
    half = F.when(F.col("n_rows") > 2, F.floor(k.bitwiseOR(F.lit(1).cast("long")) / 2)).otherwise(F.lit(0)).cast("long")
    dims = stats.select(*HEAD, half.alias("half"), "n_rows", F.col("lo.code").alias("lo_code"), F.col("hi.code").alias("hi_code"))
    codes = range(len(SIGNAL_STATES))
    sums = {"rn": F.lit(1).cast("long")} | {f"n{c}": F.when(F.col("code") == c, 1).otherwise(0).cast("long") for c in codes}
    counted = running_sums(carried, HEAD, sums, ["t_us"], F.floor(F.col("t_us") / slice_us)).join(dims, HEAD)
    at = lambda name, shift: counted.select(
        *HEAD, (F.col("rn") + shift).alias("rn"), *[F.col(f"n{c}").alias(f"{name}{c}") for c in codes])
    # the counts up to the last row of the vote, and those before its first; outside the series the border row repeats
    wide = counted.filter("half > 0")
    ends = wide.join(at("hi", -F.col("half")), [*HEAD, "rn"], "left").join(at("lo", F.col("half") + 1), [*HEAD, "rn"], "left")
    last = counted.filter("rn = n_rows").select(*HEAD, *[F.col(f"n{c}").alias(f"all{c}") for c in codes])
    ends = ends.join(last, HEAD)
    miss_lo = F.greatest(F.lit(0), F.col("half") - F.col("rn") + 1)
    miss_hi = F.greatest(F.lit(0), F.col("half") - (F.col("n_rows") - F.col("rn")))

    def count(c):
        inside = F.coalesce(F.col(f"hi{c}"), F.col(f"all{c}")) - F.coalesce(F.col(f"lo{c}"), F.lit(0))
        return inside + F.when(F.col("lo_code") == c, miss_lo).otherwise(F.lit(0)) + F.when(F.col("hi_code") == c, miss_hi).otherwise(F.lit(0))
    tally = F.array(*[F.struct(count(c).alias("n"), F.lit(-c).alias("c")) for c in codes])
    cols = [*HEAD, "frame_idx", "t_us"]
    voted = ends.select(*cols, (-F.array_max(tally)["c"]).cast("int").alias("code"))
    return voted.unionByName(counted.filter("half = 0").select(*cols, "code"))


def signal_readable(timeline: DataFrame) -> DataFrame:
    """Heads known in more than half of their samples."""
    share = timeline.groupBy(*HEAD).agg(F.avg(F.when(F.col("code") != 0, 1.0).otherwise(0.0)).alias("known"))
    return share.withColumn("readable", F.col("known") > 0.5)


def signal_at(queries: DataFrame, timeline: DataFrame, block_us: int = 60 * US) -> DataFrame:
    """State at each query time: the first sample at or after it, clipped to the last one.

    Every sample but the first answers the span (previous sample, itself], so the as-of
    join is a span join; the first and the last one also answer all times outside.
    """
    spans = sample_spans(timeline)
    ends = timeline.groupBy(*HEAD).agg(F.min("t_us").alias("_begin"), F.min_by("code", "t_us").alias("_begin_code"),
                                       F.max("t_us").alias("_end"), F.max_by("code", "t_us").alias("_end_code"))
    q = queries.join(ends, HEAD, "left")
    early, late = F.col("t_us") <= F.col("_begin"), F.col("_end").isNull() | (F.col("t_us") > F.col("_end"))
    outside = q.filter(early | late).select(
        *queries.columns, F.coalesce(F.when(early, F.col("_begin_code")).otherwise(F.col("_end_code")), F.lit(0)).alias("code"))
    hit = points_in(q.filter((F.col("t_us") > F.col("_begin")) & (F.col("t_us") <= F.col("_end"))).select(*queries.columns),
                    spans.filter("prev_us is not null").select(*HEAD, "after_us", "upto_us", "code"), HEAD, "t_us", "after_us", "upto_us", block_us)
    return hit.select(*queries.columns, "code").unionByName(outside)


def sample_spans(timeline: DataFrame) -> DataFrame:
    """Span of query times between the sample before and each sample, in whole microseconds; the first has none before."""
    from .slices import lag_in_slices
    prev = lag_in_slices(timeline, HEAD, {"prev_us": "t_us"}, ["t_us"])
    return prev.withColumn("upto_us", F.col("t_us")).withColumn(
        "after_us", F.coalesce(F.col("prev_us") + 1, F.col("t_us")))


def signal_held(queries: DataFrame, timeline: DataFrame, code: int, seconds: float, block_us: int = 60 * US) -> DataFrame:
    """``held``: at least one sample in [t - seconds, t] and all of them show ``code``."""
    q = queries.withColumn("lo_us", F.col("t_us") - int(seconds * US)).withColumnRenamed("t_us", "q_us")
    hit = points_in(timeline.select(*HEAD, "t_us", "code"), q, HEAD, "t_us", "lo_us", "q_us", block_us)
    keys = [c for c in q.columns if c != "lo_us"]
    agg = hit.groupBy(*keys).agg(F.bool_and(F.col("code") == code).alias("held"))
    return (q.drop("lo_us").join(agg, keys, "left").withColumnRenamed("q_us", "t_us")
            .withColumn("held", F.coalesce("held", F.lit(False))))


def signal_fraction(spans: DataFrame, timeline: DataFrame, code: int, block_us: int = 60 * US) -> DataFrame:
    """Share of [start_us, end_us] showing ``code``: samples from start up to the first one at or after end."""
    # a sample counts when t >= start and the sample before it is < end
    keys = spans.columns
    blk = lambda c: F.floor(F.col(c) / block_us)
    s = (sample_spans(timeline).select(*HEAD, "t_us", "code", F.coalesce("prev_us", F.col("t_us") - 1).alias("prev_us"))
         .withColumn("_b", F.explode(F.sequence(blk("prev_us"), blk("t_us")))))
    q = spans.withColumn("_b", F.explode(F.sequence(blk("start_us"), blk("end_us"))))
    hit = (q.join(s, [*HEAD, "_b"])
           .filter((F.col("t_us") >= F.col("start_us")) & (F.col("prev_us") < F.col("end_us"))
                   & (F.floor(F.greatest("prev_us", "start_us") / block_us) == F.col("_b")))
           .groupBy(*keys).agg(F.avg(F.when(F.col("code") == code, 1.0).otherwise(0.0)).alias("share")))
    return spans.join(hit, keys, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))

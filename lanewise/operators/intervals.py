"""Interval operators: runs, merges, clean-up and interval joins."""
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import DEFAULT_GAP, DEFAULT_MIN, MERGE_GAP, MIN_LEN
from ..session import materialise
from .ordered import ordered_scan
from .slices import SLICE_US

US = 1_000_000


def runs(flagged: DataFrame, keys: list[str], max_gap: float, step: str | None = "step_us",
         carry: tuple = (), min_len: float = 0.0, slice_us: int = SLICE_US) -> DataFrame:
    """Segments of True samples. ``flagged`` holds the True rows only.

    A gap between consecutive True rows over max(max_gap, 1.5 x median step of
    the whole series) starts a new run; a run of one sample has start = end.
    One pass over the rows by (key, time slice) keeps run starts and the rows
    at slice borders; only those reach the window over the whole key.
    """
    gap = F.lit(int(round(max_gap * US)))
    limit = F.greatest(gap, (1.5 * F.col(step)).cast("double")) if step else gap
    rows = flagged.select(*keys, "t_us", limit.alias("_lim"), *carry).withColumn("slice", F.floor(F.col("t_us") / slice_us))
    w = Window.partitionBy(*keys, "slice").orderBy("t_us")
    body = rows.withColumn("_prev", F.lag("t_us").over(w)).withColumn("_next", F.lead("t_us").over(w))
    far = lambda p: F.col("t_us") - F.col(p) > F.col("_lim")
    edge = body.filter(F.col("_prev").isNull() | F.col("_next").isNull() | far("_prev"))
    k = Window.partitionBy(*keys).orderBy("t_us")
    edge = (edge.withColumn("_before", F.coalesce("_prev", F.lag("t_us").over(k)))
            .withColumn("_last", F.max("t_us").over(Window.partitionBy(*keys))))
    starts = edge.filter(F.col("_before").isNull() | far("_before"))
    out = starts.withColumn("end_us", F.coalesce(F.lead("_before").over(k), "_last")).select(
        *keys, F.col("t_us").alias("start_us"), "end_us", *carry)
    return out.filter(F.col("end_us") - F.col("start_us") >= int(round(min_len * US))) if min_len else out


def _islands(df, keys, gap: Column, start, end, strict=False):
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - reach >= gap if strict else F.col(start) - reach > gap
    new = F.when(reach.isNull() | apart, 1).otherwise(0)
    return (df.withColumn("_new", new)
            .withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_isl").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isl"))


def merge_segments(df: DataFrame, keys: list[str], gap=0.0, start="start_sec", end="end_sec",
                   block: float = 600.0, strict: bool = False) -> DataFrame:
    """Union of segments that overlap or lie within ``gap`` of each other (inclusive unless ``strict``).

    Merging is associative: segments are merged inside time blocks first, in
    parallel, and the few survivors of a key are merged once more.
    """
    g = gap if isinstance(gap, Column) else F.lit(gap)
    cols = [*keys, start, end]
    local = _islands(df.select(*cols).withColumn("_blk", F.floor(F.col(start) / block)), [*keys, "_blk"], g, start, end, strict)
    return _islands(local.drop("_blk"), keys, g, start, end, strict).select(*cols)


def time_components(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], name: str, block: float = 600.0) -> DataFrame:
    """``df`` with ``name``: the start of its stretch of time that some row covers without a hole.

    Rows that touch share a stretch, so whatever chains rows by shared time stays in one. Stretches are found inside time blocks first,
    in parallel; one that starts before the rows of earlier blocks end belongs to the last stretch before it, which a row per block
    tells. ``order`` makes the order by start total; keys are not null.
    """
    w = Window.partitionBy(*keys, "_blk").orderBy(start, end, *order)
    rows = df.withColumn("_blk", F.floor(F.col(start) / block))
    rows = rows.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    local = materialise(rows.withColumn(name, F.max(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (local.groupBy(*keys, "_blk").agg(F.max(end).alias("_tot"), F.max(name).alias("_last"))
              .withColumn("_base", F.max("_tot").over(before)))
    starts = F.when(F.col("_base").isNull() | (F.col("_last") > F.col("_base")), F.col("_last"))
    blocks = blocks.withColumn("_open", F.max(starts).over(before)).select(*keys, "_blk", "_base", "_open")
    joined = local.join(blocks, [*keys, "_blk"])
    return joined.withColumn(name, F.when(F.col(name) <= F.col("_base"), F.col("_open")).otherwise(F.col(name))).drop("_blk", "_base", "_open")


def time_parts(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], name: str, block: float = 600.0) -> DataFrame:
    """``df`` with ``name``: a block of whole stretches, for scans whose state says nothing across a hole in time."""
    return time_components(df, keys, start, end, order, name, block).withColumn(name, F.floor(F.col(name) / block))


def class_param(params: dict, default: float) -> Column:
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(params.items())])
    return F.coalesce(m[F.col("label")], F.lit(default))


def finalize_events(events: DataFrame, videos: DataFrame, merge_gap=MERGE_GAP, min_len=MIN_LEN,
                    default_gap=DEFAULT_GAP, default_min=DEFAULT_MIN) -> DataFrame:
    """Merge per class, clip to the video, drop short segments, round to 2 digits."""
    merged = merge_segments(events, ["video_id", "label"], class_param(merge_gap, default_gap))
    s = F.greatest(F.lit(0.0), F.col("start_sec"))
    e = F.least(F.col("duration"), F.col("end_sec"))
    return (merged.join(videos.select("video_id", "duration"), "video_id")
            .select("video_id", s.alias("s"), e.alias("e"), "label")
            .filter(F.col("e") - F.col("s") >= class_param(min_len, default_min))
            .select("video_id", F.bround("s", 2).alias("start_sec"), F.bround("e", 2).alias("end_sec"), "label"))


def clean_events(events: DataFrame, videos: DataFrame, classes: list[str]) -> DataFrame:
    """Keep valid events, report the rest.

    Adds ``problem`` (NULL for kept rows): ``unknown_video``, ``not_numeric``,
    ``bad_label``, ``bad_times`` or ``overlap``. Starts and ends may be strings. Among
    same-class segments the earlier-starting one is kept; a dropped segment
    does not block later ones.
    """
    s = F.expr("try_cast(start_sec as double)")
    e = F.expr("try_cast(end_sec as double)")
    rows = (events.join(videos.select("video_id", "duration"), "video_id", "left")
            .withColumn("_s", s).withColumn("_e", F.least(e, F.col("duration"))))
    problem = (F.when(F.col("duration").isNull(), "unknown_video")
               .when(s.isNull() | e.isNull(), "not_numeric")
               .when(F.col("label").isNull() | ~F.col("label").isin(classes), "bad_label")
               .when(~((F.col("_s") >= 0) & (F.col("_s") < F.col("_e"))), "bad_times"))
    rows = rows.withColumn("problem", problem).select(
        "video_id", "pos", F.coalesce(F.bround("_s", 3), "_s").alias("start_sec"),
        F.coalesce(F.bround("_e", 3), "_e").alias("end_sec"), "label", "problem")
    valid = rows.filter("problem is null").drop("problem")
    # segments of different stretches of time never overlap: blocks of stretches are scanned by themselves
    parts = time_parts(valid, ["video_id", "label"], "start_sec", "end_sec", ["pos"], "part")
    kept = ordered_scan(parts, ["video_id", "label", "part"], ["start_sec", "pos"], _KeepFirst,
                        "video_id string, label string, pos long, start_sec double, end_sec double, part long, problem string").drop("part")
    return kept.unionByName(rows.filter("problem is not null"))


class _KeepFirst:
    """State of a block of stretches of a (video, class): the end of the last kept segment."""

    def __init__(self):
        self.last = -1.0

    def feed(self, pdf):
        out = []
        for s, e in zip(pdf["start_sec"].to_numpy(), pdf["end_sec"].to_numpy()):
            keep = s >= self.last
            out.append(None if keep else "overlap")
            if keep:
                self.last = e
        return pdf.assign(problem=out)

    def close(self):
        return None


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], t: str, lo: str, hi: str,
              block: float, how: str = "inner") -> DataFrame:
    """Join points to the spans holding them (lo <= t <= hi).

    Spans are copied into the time blocks they touch and the join runs on
    (keys, block): an equi-join with no hot key even when one camera dominates.
    """
    blk = lambda c: F.floor(F.col(c) / block)
    p = points.withColumn("_blk", blk(t))
    s = (spans.withColumn("_b", F.explode(F.sequence(blk(lo), blk(hi))))
         .select("_b", *[F.col(c).alias("_s_" + c) for c in spans.columns]))
    cond = [F.col(k) == F.col("_s_" + k) for k in keys] + [
        F.col("_blk") == F.col("_b"), F.col(t) >= F.col("_s_" + lo), F.col(t) <= F.col("_s_" + hi)]
    joined = p.join(s, cond, how)
    return joined.select(*points.columns, *[F.col("_s_" + c).alias(c) for c in spans.columns
                                            if c not in keys and c not in points.columns])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple, b_span: tuple, block: float) -> DataFrame:
    """Pairs of overlapping segments, each pair once: in the block of the later start."""
    def spread(df, span, pre):
        lo, hi = span
        blocks = F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block))
        return df.withColumn("_b", F.explode(blocks)).select(F.col("_b").alias(pre + "b"), *[F.col(c).alias(pre + c) for c in df.columns])
    left, right = spread(a, a_span, "_l_"), spread(b, b_span, "_r_")
    ls, le, rs, re = (F.col(p + c) for p, sp in (("_l_", a_span), ("_r_", b_span)) for c in sp)
    cond = [F.col("_l_" + k) == F.col("_r_" + k) for k in keys] + [
        F.col("_l_b") == F.col("_r_b"), F.floor(F.greatest(ls, rs) / block) == F.col("_l_b"), ls <= re, rs <= le]
    # sizes behind the copies are unknown to the planner: deal both sides by key and block
    return left.hint("shuffle_hash").join(right, cond).select(*[F.col("_l_" + c).alias(c) for c in a.columns],
                                         *[F.col("_r_" + c).alias(c) for c in b.columns if c not in keys])


def gap_runs(series: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """Stretches of consecutive rows (dense integer ``x``) with a value: start, end, n."""
    rows = series.filter(F.col(value).isNotNull()).select(*keys, F.col(x).cast("long").alias("t_us"))
    out = runs(rows, keys, 1 / US, step=None, slice_us=4096)
    return out.select(*keys, F.col("start_us").alias("start"), F.col("end_us").alias("end"),
                      (F.col("end_us") - F.col("start_us") + 1).alias("n"))

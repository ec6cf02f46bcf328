"""Pixel-cue operators over a long table of pixels.

``pixels``: video_id, cue_idx, t_us, y, x, gray (and r, g, b for flames).
"""
from pyspark.sql import DataFrame, functions as F

from ..constants import Obstacle
from ..functions.motion import fire_pixel
from ..session import sized
from .intervals import US, time_parts
from .ordered import ordered_scan

PIX = ["video_id", "y", "x"]


def lighting(pixels: DataFrame) -> DataFrame:
    """Mean grey level of every cue."""
    return pixels.groupBy("video_id", "cue_idx").agg(F.avg("gray").alias("brightness"))


def eval_times(cues: DataFrame, p: Obstacle = Obstacle()) -> DataFrame:
    """Evaluation times of each video whose past and future windows hold enough cues."""
    span = cues.groupBy("video_id").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"), F.count("*").alias("n"))
    first, last = F.col("lo") - int(p.past[0] * US), F.col("hi") - int(p.future * US) - 1
    times = (span.filter((F.col("n") >= 10) & (first <= last))
             .select("video_id", F.explode(F.sequence(first, last, F.lit(int(p.eval_period * US)))).alias("eval_us")))
    return windows(cues, times, p).groupBy("video_id", "eval_us").agg(
        F.count_if(F.col("side") == "past").alias("n_past"), F.count_if(F.col("side") == "future").alias("n_future")).filter(
        (F.col("n_past") >= p.min_past) & (F.col("n_future") >= p.min_future))


def windows(cues: DataFrame, times: DataFrame, p: Obstacle = Obstacle()) -> DataFrame:
    """(eval_us, side) windows of every cue, matched by arithmetic on ten-second blocks."""
    blk = 10 * US
    w = spans(times, p).withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / blk), F.floor(F.col("hi") / blk))))
    c = cues.select("video_id", "cue_idx", "t_us").withColumn("_b", F.floor(F.col("t_us") / blk))
    # windows are exploded twice, which the planner doesn't count: a build side of cues keeps it from broadcasting them
    return (w.join(c.hint("shuffle_hash"), ["video_id", "_b"]).filter((F.col("t_us") >= F.col("lo")) & (F.col("t_us") <= F.col("hi")))
            .select("video_id", "cue_idx", "eval_us", "side"))


def spans(times: DataFrame, p: Obstacle = Obstacle()) -> DataFrame:
    """The past and the future window of every evaluation time: lo, hi."""
    s = F.explode(F.array(F.struct(F.lit("past").alias("side"), F.lit(int(p.past[0] * US)).alias("lo"), F.lit(int(p.past[1] * US)).alias("hi")),
                          F.struct(F.lit("future").alias("side"), F.lit(0).alias("lo"), F.lit(int(p.future * US)).alias("hi"))))
    return times.select("video_id", "eval_us", s.alias("w")).select(
        "video_id", "eval_us", "w.side", (F.col("eval_us") + F.col("w.lo")).alias("lo"), (F.col("eval_us") + F.col("w.hi")).alias("hi"))


def box_coverage(boxes: DataFrame, members: DataFrame, group: list[str], pad: float = 0.15) -> DataFrame:
    """Per pixel, cues of the group in which any padded box covers it; uncovered pixels are absent."""
    px, py = pad * (F.col("x2") - F.col("x1")), pad * (F.col("y2") - F.col("y1"))
    span = lambda lo, hi: F.explode(F.sequence(lo.cast("int"), hi.cast("int")))
    cells = (boxes.withColumn("x", span(F.col("x1") - px, F.col("x2") + px))
             .withColumn("y", span(F.col("y1") - py, F.col("y2") + py)).select("video_id", "cue_idx", "y", "x").distinct())
    return (cells.join(members, ["video_id", "cue_idx"]).groupBy("video_id", *group, "y", "x")
            .agg(F.count("*").alias("n_cov")))


def spread(df: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    """Copy each pixel to its neighbours at offsets lo..hi along one axis. Squares are done axis by axis: 2 (2r + 1) copies, not (2r + 1)^2."""
    return df.withColumn(axis, F.explode(F.sequence(F.col(axis) + lo, F.col(axis) + hi)))


def dilate(mask: DataFrame, keys: list[str], r: int) -> DataFrame:
    """Pixels within the (2r+1)-square around a pixel of the mask."""
    rows = spread(mask.select(*keys, "y", "x"), "x", -r, r).distinct()
    return spread(rows, "y", -r, r).distinct()


def local_range(gray: DataFrame, keys: list[str], r: int = 2) -> DataFrame:
    """Max and min over the (2r+1)-square around each pixel of the image; partial aggregates combine map-side."""
    near = gray.select(*keys, "y", "x", F.col("gray").alias("hi"), F.col("gray").alias("lo"))
    for axis in ("x", "y"):
        near = spread(near, axis, -r, r).groupBy(*keys, "y", "x").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return near.join(gray.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def erode(mask: DataFrame, keys: list[str], r: int = 1) -> DataFrame:
    """Pixels whose whole (2r+1)-square lies in the mask (outside the image counts as inside).

    ``mask`` needs the image size in ``width`` and ``height``.
    """
    for axis, most in (("x", "width"), ("y", "height")):
        inside = (F.col(axis) >= 0) & (F.col(axis) < F.col(most))
        full = F.least(F.col(axis) + r, F.col(most) - 1) - F.greatest(F.col(axis) - r, F.lit(0)) + 1
        n = spread(mask, axis, -r, r).filter(inside).groupBy(*keys, "width", "height", "y", "x").agg(F.count("*").alias("n"))
        mask = n.filter(F.col("n") == full).drop("n")
    return mask


def open2(mask: DataFrame, keys: list[str]) -> DataFrame:
    """2x2 opening: pixels belonging to at least one full 2x2 square of the mask."""
    corner = spread(spread(mask.select(*keys, "y", "x"), "x", 0, 1), "y", 0, 1).groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
    # a square is named by its lower right pixel; at the border it is completed from outside the image
    full = corner.filter((F.col("n") == 4)
                         | ((F.col("x") == 0) & (F.col("y") == 0) & (F.col("n") == 1))
                         | ((F.col("x") == 0) & (F.col("y") > 0) & (F.col("n") == 2))
                         | ((F.col("y") == 0) & (F.col("x") > 0) & (F.col("n") == 2)))
    back = spread(spread(full.select(*keys, "y", "x"), "x", -1, 0), "y", -1, 0).distinct()
    return back.join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")


def shift_by_drift(cur: DataFrame, drift: DataFrame | None, size: DataFrame, p: Obstacle = Obstacle()) -> DataFrame:
    """Undo a measured view drift (video_id, eval_us, dx, dy, response) when it is small and sure.

    A pixel takes the grey level at (x + dx, y + dy), linear between the four pixels around, in steps of 1/32 pixel; beyond the image
    (``size``: video_id, width, height) the border goes on. Where not all four are at hand, the ones there are weigh alone.
    """
    if drift is None:
        return cur
    key = ["video_id", "eval_us"]
    ok = (F.col("response") >= p.min_response) & (F.hypot("dx", "dy") <= p.max_drift)
    steps = drift.filter(ok).join(size, "video_id").select(*key, "width", "height", *(F.floor(F.col(f"d{a}") * 32 + 0.5).alias(f"q{a}") for a in "xy"))
    steps = sized(steps)
    still = cur.join(steps.select(*key), key, "left_anti")
    moved = cur.join(steps, key).withColumn("w", F.lit(1.0))
    for axis, most in (("x", "width"), ("y", "height")):
        whole, part = F.floor(F.col(f"q{axis}") / 32), F.pmod(F.col(f"q{axis}"), F.lit(32)) / 32.0

        def targets(by):
            # pixels that look here; the border's pixels are also seen from beyond
            to = F.col(axis) - whole - by
            first = F.when(F.col(axis) == 0, F.lit(0)).otherwise(to)
            last = F.when(F.col(axis) == F.col(most) - 1, F.col(most) - 1).otherwise(to)
            return F.transform(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")),
                               lambda i: F.struct(i.alias("i"), (part if by else 1.0 - part).alias("part")))

        moved = (moved.withColumn("_to", F.explode(F.concat(targets(0), targets(1))))
                 .filter((F.col("_to.part") > 0) & (F.col("_to.i") >= 0) & (F.col("_to.i") < F.col(most)))
                 .withColumn(axis, F.col("_to.i")).withColumn("w", F.col("w") * F.col("_to.part")).drop("_to"))
        moved = (moved.groupBy(*key, "width", "height", "qx", "qy", "y", "x").agg(F.sum(F.col("w") * F.col("gray")).alias("gray"), F.sum("w").alias("w"))
                 .withColumn("gray", F.col("gray") / F.col("w")))
    return still.select(*key, "y", "x", "gray").unionByName(moved.select(*key, "y", "x", "gray"))


def change_mask(past: DataFrame, future: DataFrame, road: DataFrame, cov_past: DataFrame, cov_future: DataFrame,
                counts: DataFrame, drift: DataFrame | None = None, p: Obstacle = Obstacle()) -> DataFrame:
    """Road pixels outside the local range of the background and free of road users in both windows.

    ``road``: video_id, y, x, width, height of carriageway pixels;
    ``counts``: cues per window (n_past, n_future) to turn hits into coverage.
    """
    key = ["video_id", "eval_us"]
    rng = local_range(past, key)
    cur = shift_by_drift(future, drift, road.select("video_id", "width", "height").distinct(), p)
    moved = (cur.join(rng, [*key, "y", "x"])
             .filter((F.col("gray") > F.col("hi") + p.diff) | (F.col("gray") < F.col("lo") - p.diff)).select(*key, "y", "x"))
    inner = erode(road, ["video_id"]).select("video_id", "y", "x")
    on = moved.join(inner, ["video_id", "y", "x"], "left_semi")
    for cov, n in ((cov_past, "n_past"), (cov_future, "n_future")):
        busy = cov.join(counts.select(*key, n), key).filter(F.col("n_cov") / F.col(n) >= p.coverage)
        on = on.join(busy, [*key, "y", "x"], "left_anti")
    return open2(on, key)


def label_blobs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """8-connected components of a sparse mask: area, box and centroid per blob.

    Rows of one image arrive sorted and stream through a union of row runs, so
    a task holds the runs of one image row and the open blobs, not the image.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in mask.schema.fields if f.name in keys),
                        "blob int", "area long", "x1 int", "y1 int", "x2 int", "y2 int", "cx double", "cy double"])
    return ordered_scan(mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")),
                        keys, ["y", "x"], _Blobs, schema, keys)


class _Blobs:
    """Row-by-row connected components; ``open`` maps a blob to its running totals."""

    def __init__(self, keys):
        self.keys, self.key = keys, None
        self.row, self.prev_runs, self.runs = None, [], []
        self.parent, self.stat, self.n = {}, {}, 0

    def _root(self, b):
        while self.parent[b] != b:
            b = self.parent[b]
        return b

    def _end_run(self, lo, hi):
        y, n = self.row, hi - lo + 1
        totals = [n, lo, y, hi, y, n * (lo + hi) / 2.0, float(n * y)]
        touching = {self._root(b) for l, h, b in self.prev_runs if l <= hi + 1 and h >= lo - 1}
        if not touching:
            self.n += 1
            self.parent[self.n] = self.n
            root = self.n
            self.stat[root] = totals
        else:
            root = min(touching)
            for b in touching | {None}:
                if b == root:
                    continue
                other = totals if b is None else self.stat.pop(b)
                if b is not None:
                    self.parent[b] = root
                s = self.stat[root]
                self.stat[root] = [s[0] + other[0], min(s[1], other[1]), min(s[2], other[2]), max(s[3], other[3]),
                                   max(s[4], other[4]), s[5] + other[5], s[6] + other[6]]
        self.runs.append((lo, hi, root))

    def feed(self, pdf):
        self.key = tuple(pdf.loc[0, self.keys])
        for y, x in zip(pdf["y"].to_numpy(), pdf["x"].to_numpy()):
            if y != self.row:
                self._flush_row()
                if self.row is not None and y > self.row + 1:
                    self.prev_runs = []
                self.row = int(y)
            if getattr(self, "span", None) and x == self.span[1] + 1:
                self.span = (self.span[0], int(x))
            else:
                self._flush_span()
                self.span = (int(x), int(x))
        return None

    def _flush_span(self):
        if getattr(self, "span", None):
            self._end_run(*self.span)
        self.span = None

    def _flush_row(self):
        self._flush_span()
        self.prev_runs, self.runs = self.runs, []

    def close(self):
        import pandas as pd
        self._flush_row()
        blobs = sorted(self.stat.items())
        out = pd.DataFrame([[i + 1, s[0], s[1], s[2], s[3], s[4], s[5] / s[0], s[6] / s[0]] for i, (_, s) in enumerate(blobs)],
                           columns=["blob", "area", "x1", "y1", "x2", "y2", "cx", "cy"])
        for i, k in enumerate(self.keys):
            out.insert(i, k, self.key[i])
        return out


def largest_blob(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Largest blob per image, the first of equals."""
    cols = [c for c in blobs.columns if c not in keys]
    best = blobs.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col("area"), -F.col("blob"))).alias("b"))
    return best.select(*keys, "b.*")


def persistent_objects(blobs: DataFrame, size: DataFrame, p: Obstacle = Obstacle()) -> DataFrame:
    """Compact blobs that stay at one place: start_us, end_us per object.

    ``size``: video_id, width, height of the cue image. A hit joins the first
    group whose seed is within 2 % of the width and whose last hit is at most
    two periods old.
    """
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    area = F.col("area") / (F.col("width") * F.col("height"))
    hits = (blobs.join(size, "video_id")
            .filter((area >= p.area[0]) & (area <= p.area[1]) & (F.col("area") / (w * h) >= p.min_fill)
                    & (F.greatest(w, h) <= p.max_aspect * F.least(w, h)))
            .select("video_id", "eval_us", "blob", "cx", "cy", (0.02 * F.col("width")).alias("radius")))
    # after two periods without a hit no place is open: blocks of stretches are scanned by themselves
    hits = hits.withColumn("until", F.col("eval_us") + int(2 * p.eval_period * US))
    parts = time_parts(hits, ["video_id"], "eval_us", "until", ["blob"], "part", 600.0 * US).drop("until")
    return ordered_scan(parts, ["video_id", "part"], ["eval_us", "blob"], _Places,
                        "video_id string, start_us long, end_us long", p)


class _Places:
    """Open groups: seed centre, first and last hit; groups two periods old are closed."""

    def __init__(self, p):
        self.p, self.open, self.video = p, [], None

    def _emit(self, groups):
        import pandas as pd
        shift = int(self.p.future / 2 * US)
        done = [(self.video, g[2] + shift, g[3] + shift) for g in groups if g[3] - g[2] >= self.p.min_persist * US]
        return pd.DataFrame(done, columns=["video_id", "start_us", "end_us"]) if done else None

    def feed(self, pdf):
        self.video = pdf["video_id"].iloc[0]
        stale = []
        limit = 2 * self.p.eval_period * US
        for t, x, y, r in pdf[["eval_us", "cx", "cy", "radius"]].itertuples(index=False):
            stale += [g for g in self.open if t - g[3] > limit]
            self.open = [g for g in self.open if t - g[3] <= limit]
            mine = next((g for g in self.open if (g[0] - x) ** 2 + (g[1] - y) ** 2 < r * r), None)
            if mine is None:
                self.open.append([x, y, int(t), int(t)])
            else:
                mine[3] = int(t)
        return self._emit(stale)

    def close(self):
        return self._emit(self.open)


def fire_mask(pixels: DataFrame, near_road: DataFrame) -> DataFrame:
    """Flame-coloured pixels on or near the road."""
    fire = pixels.filter(fire_pixel(F.col("r"), F.col("g"), F.col("b")))
    return fire.select("video_id", "cue_idx", "t_us", "y", "x").join(near_road, ["video_id", "y", "x"], "left_semi")


def flame_flags(blobs: DataFrame, cues: DataFrame, size: DataFrame, window: float, min_area: float, max_drift: float,
                min_cv: float) -> DataFrame:
    """Cues whose trailing window shows a flickering flame at a fixed place."""
    from . import timeseries as ts
    from .slices import own_rows, slice_rows
    rows = (cues.select("video_id", "cue_idx", "t_us").join(size, "video_id")
            .join(blobs.select("video_id", "cue_idx", "area", "cx", "cy"), ["video_id", "cue_idx"], "left")
            .withColumn("a", F.coalesce("area", F.lit(0)) / (F.col("width") * F.col("height"))))
    rows = slice_rows(rows, ts.us(window))
    by = ["video_id", "slice"]
    r = lambda agg: ts.over_range(agg, -window, 0, by)
    rows = (rows.withColumn("n", r(F.count("*"))).withColumn("med", ts.range_median("a", -window, 0, by))
            .withColumn("drift", F.greatest(r(F.stddev_pop("cx")), r(F.stddev_pop("cy"))) / F.col("width"))
            .withColumn("cv", r(F.stddev_pop("a")) / (r(F.avg("a")) + F.lit(1e-9))))
    ok = (F.col("n") >= 4) & (F.col("med") >= min_area) & (F.col("drift") <= max_drift) & (F.col("cv") >= min_cv)
    return own_rows(rows).filter(ok)



"""Exploratory series and dashboards."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CATEGORIES, GRID_X, GRID_Y
from ..functions.motion import is_two_wheeler, is_vehicle
from ..operators.intervals import points_in
from ..operators.signals import head_state
from ..operators.slices import SLICE_US
from ..operators.tracks import KEY

US = 1_000_000


def n_bins(duration="duration") -> Column:
    """Whole seconds the footage reaches into."""
    return F.greatest(F.lit(1), F.ceil(F.col(duration))).cast("int")


def bins(videos: DataFrame) -> DataFrame:
    return videos.select("video_id", F.explode(F.sequence(F.lit(0), n_bins() - 1)).alias("bin"))


def bin_of(videos: DataFrame, rows: DataFrame) -> DataFrame:
    """One-second bin of each row; the last bin also takes what lies behind it."""
    b = videos.select("video_id", n_bins().alias("_nb"))
    return rows.join(b, "video_id").withColumn("bin", F.least(F.floor(F.col("t_us") / US), F.col("_nb") - 1).cast("int")).drop("_nb")


def frames_per_bin(frames: DataFrame, videos: DataFrame) -> DataFrame:
    return bin_of(videos, frames.select("video_id", "t_us")).groupBy("video_id", "bin").agg(F.count("*").alias("n_frames"))


def counts_over_time(detections: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Mean detections per frame by class in 1 s bins; classes never seen in a video are left out."""
    per = bin_of(videos, detections.select("video_id", "category", "t_us")).groupBy("video_id", "category", "bin").agg(F.count("*").alias("n"))
    seen = per.select("video_id", "category").distinct().filter(F.col("category").isin(CATEGORIES))
    grid = bins(videos).join(seen, "video_id").join(frames_per_bin(frames, videos), ["video_id", "bin"], "left")
    rate = F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("n_frames", F.lit(0)), F.lit(1))
    return (grid.join(per, ["video_id", "category", "bin"], "left")
            .select("video_id", "category", "bin", F.bround(rate, 2).alias("per_frame")))


def zone_occupancy(samples: DataFrame, scene: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Vehicles and two-wheelers per road zone and second, and their median speed (NULL when empty)."""
    users = bin_of(videos, samples.filter(is_vehicle() | is_two_wheeler()).select("video_id", "zone", "speed", "t_us"))
    per = users.groupBy("video_id", "zone", "bin").agg(F.count("*").alias("n"), F.median("speed").alias("v"))
    zones = scene.select("video_id", F.explode(F.transform("roads", lambda z: z["name"])).alias("zone"))
    grid = bins(videos).join(zones, "video_id").join(frames_per_bin(frames, videos), ["video_id", "bin"], "left")
    rate = F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("n_frames", F.lit(0)), F.lit(1))
    return (grid.join(per, ["video_id", "zone", "bin"], "left")
            .select("video_id", "zone", "bin", F.bround(rate, 2).alias("vehicles"), F.bround("v", 2).alias("median_speed")))


def speed_histogram(samples: DataFrame) -> DataFrame:
    """Vehicle speeds per video in 30 bins on [0, 6] (the last one closed)."""
    v = samples.filter(is_vehicle() & (F.col("speed") >= 0) & (F.col("speed") <= 6))
    b = F.least(F.floor(F.col("speed") * 5.0), F.lit(29)).cast("int")
    return v.groupBy("video_id", b.alias("bin")).agg(F.count("*").alias("n"))


def stationary_fraction(samples: DataFrame) -> DataFrame:
    still = F.avg(F.when(F.col("speed") < 0.12, 1.0).otherwise(0.0))
    return samples.filter(is_vehicle()).groupBy("video_id").agg(F.bround(still, 3).alias("stationary_fraction"))


def track_summary(samples: DataFrame, videos: DataFrame, lighting: DataFrame | None = None) -> DataFrame:
    """Tracks per category with the video's facts (one row per video and category)."""
    n = samples.groupBy("video_id", "category", "track_id").agg(F.count("*").alias("_n")).groupBy("video_id", "category").agg(F.count("*").alias("n_tracks"))
    out = n.join(videos, "video_id").select("video_id", "category", "n_tracks", "width", "height",
                                            F.bround("fps", 2).alias("fps"), F.bround("duration", 2).alias("duration"), "n_frames")
    if lighting is not None:
        b = lighting.groupBy("video_id").agg(F.bround(F.avg("brightness"), 1).alias("mean_brightness"))
        out = out.join(b, "video_id", "left")
    return out


def ranked(samples: DataFrame, keys: list[str], slice_us: int = SLICE_US) -> DataFrame:
    """0-based position ``idx`` of each row in its series: rank in the time slice plus the slices before."""
    s = samples.withColumn("slice", F.floor(F.col("t_us") / slice_us))
    before = (s.groupBy(*keys, "slice").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c"))
    rn = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("t_us"))
    return (s.withColumn("_rn", rn).join(before, [*keys, "slice"])
            .withColumn("idx", F.col("_rn") - 1 + F.col("_base")).drop("_rn", "_base", "slice"))


def trajectories(samples: DataFrame, min_duration: float = 2.0, step: int = 3) -> DataFrame:
    """Every third ground point of longer tracks, normalised to the frame (one row per point)."""
    keep = samples.filter((F.col("last_us") - F.col("first_us") >= int(min_duration * US)) & (F.col("category") != "animal"))
    thin = ranked(keep, KEY).filter(F.col("idx") % step == 0)
    return thin.select(*KEY, F.col("category").alias("cls"), F.bround(F.col("first_us") / US, 2).alias("t0"), "idx",
                       F.bround(F.col("px") / F.col("width"), 4).alias("nx"), F.bround(F.col("py") / F.col("height"), 4).alias("ny"))


def heat_grid(samples: DataFrame, cell: int = 4) -> DataFrame:
    """Moving samples per 4-px cell inside the frame."""
    x, y = F.col("px"), F.col("py")
    inside = (F.col("speed") > 0.3) & (x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height"))
    return (samples.filter(inside).groupBy("video_id", F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"))
            .agg(F.count("*").alias("n")))


def direction_field(samples: DataFrame, min_n: int = 5, min_coherence: float = 0.3) -> DataFrame:
    """Mean heading of moving vehicles on a 32 x 18 grid, where it is coherent."""
    norm = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) + F.lit(1e-9)
    gx, gy = F.col("px") / F.col("width") * GRID_X, F.col("py") / F.col("height") * GRID_Y
    # cells are cut towards zero, so the strip just outside the near borders counts as cell 0
    v = (samples.filter(is_vehicle() & (F.col("speed") > 0.3)).withColumn("gx", gx.cast("int")).withColumn("gy", gy.cast("int"))
         .filter((F.col("gx") >= 0) & (F.col("gx") < GRID_X) & (F.col("gy") >= 0) & (F.col("gy") < GRID_Y)))
    cells = v.groupBy("video_id", "gx", "gy").agg(F.count("*").alias("n"), F.avg(F.col("vx") / norm).alias("ux"), F.avg(F.col("vy") / norm).alias("uy"))
    coh = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))
    ang = F.pmod(F.degrees(F.atan2("uy", "ux")) + 360.0, F.lit(360.0))
    return (cells.withColumn("coherence", coh).filter((F.col("n") >= min_n) & (F.col("coherence") >= min_coherence))
            .select("video_id", "gx", "gy", "n", "coherence", ang.alias("angle")))


def zone_counts(detections: DataFrame, scene: DataFrame) -> DataFrame:
    """Detections per frame, zone of the ground point (``off_road`` without one) and class (``n``), and of the class in all zones (``n_class``)."""
    from ..functions.geometry import zone_of
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    z = zone_of(F.col("islands"), F.col("roads"), F.col("crosswalks"), x, y)
    n = (detections.join(scene.select("video_id", "islands", "roads", "crosswalks"), "video_id")
         .withColumn("zone", F.coalesce(z, F.lit("off_road")))
         .groupBy("video_id", "frame_idx", "zone", "category").agg(F.count("*").alias("n")))
    return n.withColumn("n_class", F.sum("n").over(Window.partitionBy("video_id", "frame_idx", "category")))


def frame_stats(detections: DataFrame, scene: DataFrame, pixels: DataFrame, layout: DataFrame, approach: str) -> DataFrame:
    """All statistics of every frame with detections or pixels: ``zone_counts`` beside the frame's own facts.

    These are the size, registration and stop line of its view (``line``, with its shift dx, dy against the layout), brightness and contrast of
    its pixels (video_id, frame_idx, x, y, gray, r, g, b; NULL without any) and ``signals``, the state of each head by name. A frame
    without detections has one row without zone and class.
    """
    frame = ["video_id", "frame_idx"]
    grey = still_stats(pixels.withColumnRenamed("frame_idx", "cue_idx")).withColumnRenamed("cue_idx", "frame_idx")
    states = (head_state(pixels, scene.select("video_id", F.inline("heads"))).groupBy(*frame)
              .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("head", "state")))).alias("signals")))
    line = F.filter("approaches", lambda a: a["name"] == approach)[0]
    view = scene.select("video_id", "width", "height", "registered", "inliers", F.array(*[F.bround(line[c], 1) for c in ("lx0", "ly0", "lx1", "ly1")]).alias("line"))
    view = view.join(stop_line_offset(scene, layout, approach), "video_id", "left")
    rows = zone_counts(detections, scene).join(grey, frame, "full").join(states, frame, "left")
    return rows.fillna(0, ["n", "n_class"]).join(view, "video_id")


def still_stats(pixels: DataFrame) -> DataFrame:
    """Brightness and contrast of each image."""
    return pixels.groupBy("video_id", "cue_idx").agg(F.bround(F.avg("gray"), 1).alias("brightness"),
                                                     F.bround(F.stddev_pop("gray"), 1).alias("contrast"))


def stop_line_offset(scene: DataFrame, layout: DataFrame, approach: str) -> DataFrame:
    """Shift of an approach's stop line against the layout scaled to the video's width."""
    a = scene.select("video_id", "scene_id", "width", F.explode("approaches").alias("a")).filter(F.col("a.name") == approach)
    ref = layout.select("scene_id", F.col("ref_size")[0].alias("rw"), F.col("approaches")[approach]["stop_line"][0].alias("p"))
    k = F.col("width") / F.col("rw")
    return a.join(ref, "scene_id").select("video_id", F.bround(F.col("a.lx0") - F.col("p")[0] * k, 1).alias("dx"),
                                          F.bround(F.col("a.ly0") - F.col("p")[1] * k, 1).alias("dy"))


def dashboard_classes(events: DataFrame) -> DataFrame:
    """Events and total seconds per class, most frequent first."""
    return (events.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("seconds"))
            .orderBy(F.desc("n"), "label"))


def dashboard_videos(events: DataFrame, videos: DataFrame) -> DataFrame:
    """Events per minute of each video (videos without events included)."""
    n = events.groupBy("video_id").agg(F.count("*").alias("n"))
    return (videos.join(n, "video_id", "left")
            .select("video_id", F.coalesce("n", F.lit(0)).alias("n"),
                    (F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1.0), F.col("duration") / 60.0)).alias("per_minute")))


def dashboard_totals(events: DataFrame, videos: DataFrame) -> DataFrame:
    v = videos.agg(F.count("*").alias("n_videos"), (F.sum("duration") / 60.0).alias("minutes"))
    n = events.join(videos.select("video_id"), "video_id", "left_semi").agg(F.count("*").alias("n_events"))
    return v.join(n).withColumn("per_minute", F.col("n_events") / F.greatest(F.lit(1.0), F.col("minutes")))


def class_examples(events: DataFrame) -> DataFrame:
    """Per class the event of median length: position floor(n/2) in order of length, then of appearance.

    Ranks are counted per length bin first; only the bin that holds the wanted
    rank is sorted.
    """
    rows = events.withColumn("len", F.col("end_sec") - F.col("start_sec")).withColumn("bin", F.floor(F.col("len") * 10))
    h = rows.groupBy("label", "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("label")
    h = (h.withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(
        w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("want", F.floor(F.col("n") / 2)))
    h = h.filter((F.col("want") >= F.col("before")) & (F.col("want") < F.col("before") + F.col("c")))
    rn = F.row_number().over(Window.partitionBy("label").orderBy("len", "video_id", "pos"))
    mmss = lambda c: F.format_string("%d:%02d", F.floor(F.col(c) / 60), F.floor(F.col(c) % 60))
    return (rows.join(h, ["label", "bin"]).withColumn("rn", rn).filter(F.col("rn") - 1 == F.col("want") - F.col("before"))
            .select("label", "n", "video_id", "start_sec", "end_sec", mmss("start_sec").alias("from_text"), mmss("end_sec").alias("to_text")))


def active_events(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Labels active at each frame (start <= t <= end), one row per frame and label."""
    hit = points_in(frames.select("video_id", "frame_idx", "t"), events.select("video_id", "start_sec", "end_sec", "label"),
                    ["video_id"], "t", "start_sec", "end_sec", 10.0)
    return hit.groupBy("video_id", "frame_idx", "label").agg(F.count("*").alias("n"))


def annotate_frames(frames: DataFrame, samples: DataFrame, risk: DataFrame | None = None, tolerance: float = 0.2,
                    trail: float = 2.0) -> DataFrame:
    """What an annotated frame shows: the tracks of the next track frame within 0.2 s,
    the length of their 2 s trails and the risk value.

    Frames look ahead at most ``tolerance``, so the as-of join is a join of
    each frame with the track frames of that span.
    """
    from ..operators import timeseries as ts
    from ..operators.slices import own_rows, slice_rows
    by = ["video_id", "track_id", "slice"]
    tr = own_rows(slice_rows(samples.select("video_id", "track_id", "category", "t_us", "px", "py"), ts.us(trail))
                  .withColumn("trail_points", ts.over_range(F.count("*"), -trail, 0, by)))
    keys = samples.select("video_id", F.col("t_us").alias("near_us")).distinct()
    last = keys.groupBy("video_id").agg(F.max("near_us").alias("end_us"))
    tol = int(tolerance * US)
    f = (frames.select("video_id", "frame_idx", "t_us").join(last, "video_id")
         .withColumn("hi", F.col("t_us") + tol).withColumn("lo", F.least("t_us", "end_us")))
    near = (points_in(keys, f.withColumnRenamed("t_us", "f_us"), ["video_id"], "near_us", "lo", "hi", 10 * US)
            .filter(F.abs(F.col("near_us") - F.col("f_us")) <= tol)
            .groupBy("video_id", "frame_idx", "f_us").agg(F.min("near_us").alias("t_us")))
    out = near.join(tr, ["video_id", "t_us"]).select("video_id", "frame_idx", "track_id", "category", "px", "py", "trail_points")
    if risk is not None:
        out = out.join(risk.select("video_id", F.col("pos").alias("frame_idx"), "score"), ["video_id", "frame_idx"], "left")
    return out


def apply_time_budget(rows: DataFrame, log: DataFrame, factor: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Drop the rows of videos whose processing took over ``factor`` x their length; second table logs them.

    ``log``: video_id, duration, total_sec.
    """
    over = log.filter(F.col("total_sec") > factor * F.col("duration"))
    note = over.select("video_id", "total_sec", (factor * F.col("duration")).alias("budget_sec"), F.lit("over time budget").alias("problem"))
    return rows.join(over.select("video_id"), "video_id", "left_anti"), note



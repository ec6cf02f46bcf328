"""Track table, kinematics and track filters."""
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import CATEGORIES, MIN_SIZE_FRAC, MIN_TRACK_SAMPLES
from ..functions import geometry as G
from ..functions.motion import is_two_wheeler, is_vehicle
from . import timeseries as ts
from .kernels import covered_counts, motion
from .medians import exact_median
from .slices import SLICE_US, slice_rows

KEY = ["video_id", "track_id"]
# the stitcher never bridges more, so no track has a longer hole between samples
MAX_HOLE = 8.0
COVER_FRAMES = 16   # frames of a block in which persons meet vehicles


def majority_category(obs: DataFrame) -> DataFrame:
    """One row per track: most frequent category (first seen wins ties), samples, first and last time."""
    votes = obs.groupBy(*KEY, "category").agg(
        F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    return votes.groupBy(*KEY).agg(
        F.max_by("category", F.struct(F.col("n"), -F.col("first_us"))).alias("category"),
        F.sum("n").alias("n_obs"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def min_samples(tracks: DataFrame, n: int = MIN_TRACK_SAMPLES) -> DataFrame:
    return tracks.filter(F.col("n_obs") >= n)


def kinematics(obs: DataFrame, tracks: DataFrame, videos: DataFrame, slice_us: int = SLICE_US,
               pos_sigma: float = 0.25, vel_window: float = 0.4) -> DataFrame:
    """Smoothed position, size, velocity, speed, acceleration and heading per sample.

    One shuffle on (video, track, slice): the track table is spread over the
    slices its track touches, so the join that attaches it has the same key as
    the windows. Speeds are in body sizes per second, headings NULL at rest.
    """
    reach = ts.us(3.0 + 2 * MAX_HOLE + 2.0)
    dims = (tracks.join(videos.select("video_id", "width", "height"), "video_id")
            .withColumn("slice", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("first_us") - reach) / slice_us),
                                                      F.floor((F.col("last_us") + reach) / slice_us)))))
    by = [*KEY, "slice"]
    rows = slice_rows(obs.drop("category"), reach, slice_us).join(dims.hint("shuffle_hash"), by)
    kept = [f for f in rows.schema.fields if f.name not in ("own", "slice")]
    made = [T.StructField("dt_us", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in (
        "px", "py", "size", "vx", "vy", "speed", "accel", "heading")]]
    moved = rows.groupBy(*by).applyInArrow(lambda t: motion(t, pos_sigma, vel_window), T.StructType([*kept, *made]))
    return moved.withColumn("at_edge", G.edge_flag(F.col("width"), F.col("height")))


def track_stats(samples: DataFrame) -> DataFrame:
    """Median smoothed size and median time step of every track."""
    size = exact_median(samples, KEY, "size", "n_obs", width=0.25).withColumnRenamed("median", "med_size")
    steps = (samples.filter("dt_us is not null").groupBy(*KEY, "dt_us").agg(F.count("*").alias("n"))
             .groupBy(*KEY).agg(F.percentile("dt_us", F.lit(0.5), F.col("n")).alias("step_us")))
    return size.join(steps, KEY, "left").withColumn("step_us", F.coalesce("step_us", F.lit(0.0)))


def with_stats(samples: DataFrame, stats: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Attach the track statistics; joined per slice so a long track spreads over tasks."""
    cut = F.floor(F.col("t_us") / slice_us)
    spans = samples.groupBy(*KEY, cut.alias("slice")).agg(F.count("*").alias("_n")).drop("_n")
    return (samples.withColumn("slice", cut).join(spans.join(stats, KEY).hint("shuffle_hash"), [*KEY, "slice"]).drop("slice"))


def large_enough(frac: float = MIN_SIZE_FRAC) -> Column:
    return F.col("med_size") >= frac * F.col("width")


def vehicle_tracks(samples: DataFrame, two_wheelers: bool = True) -> DataFrame:
    """Samples of vehicles (and two-wheelers) large enough to trust."""
    kind = is_vehicle() | is_two_wheeler() if two_wheelers else is_vehicle()
    return samples.filter(kind & large_enough())


def covered_share(samples: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Per person track: share of samples covered by a vehicle or two-wheeler box of the same frame.

    Boxes meet in a sweep over their x ranges, by blocks of frames; only the counts leave a block.
    """
    box = ["x1", "y1", "x2", "y2"]
    person = F.col("category") == "person"
    rows = samples.filter(person | is_vehicle() | is_two_wheeler()).select(
        "video_id", "track_id", "frame_idx", *[F.col(c).cast("double").alias(c) for c in box], person.alias("person"), F.expr(f"frame_idx div {COVER_FRAMES}").alias("_block"))
    counts = rows.groupBy("video_id", "_block").applyInArrow(
        lambda block: covered_counts(block, overlap), T.StructType([*[rows.schema[c] for c in KEY], T.StructField("n", T.LongType()), T.StructField("n_hit", T.LongType())]))
    return counts.groupBy(*KEY).agg((F.sum("n_hit") / F.sum("n")).alias("covered"))


def pedestrians(samples: DataFrame) -> DataFrame:
    """Samples of persons who are neither riders nor passengers."""
    riders = covered_share(samples).filter(F.col("covered") >= 0.5)
    return samples.filter(F.col("category") == "person").join(riders, KEY, "left_anti")


FRAME_PIECE = 50_000


def frame_grid(videos: DataFrame, rate: float, override: int = 0) -> DataFrame:
    """One row per processed frame, with or without detections."""
    from ..functions.motion import stride_for
    # pieces first, dealt out anew, then their frames: a year of one camera is neither one array nor one task
    piece = F.lit(FRAME_PIECE) * F.col("stride")
    pieces = (videos.withColumn("stride", stride_for(F.col("fps"), rate, override)).filter("n_frames > 0")
              .withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1, piece)))
              .repartition("video_id", "_first"))
    return (pieces.withColumn("frame_idx", F.explode(F.sequence(
                F.col("_first"), F.least(F.col("_first") + piece, F.col("n_frames")) - 1, F.col("stride"))))
            .select("video_id", "frame_idx", "stride", "fps",
                    (F.col("frame_idx") / F.col("fps")).alias("t"),
                    F.bround(F.col("frame_idx") / F.col("fps") * 1e6, 0).cast("long").alias("t_us")))


def sample_frames(rows: DataFrame, videos: DataFrame, rate: float, override: int = 0) -> DataFrame:
    """Keep the rows of every stride-th frame."""
    from ..functions.motion import stride_for
    keep = videos.select("video_id", stride_for(F.col("fps"), rate, override).alias("_stride"))
    return rows.join(keep, "video_id").filter(F.col("frame_idx") % F.col("_stride") == 0).drop("_stride")


def detection_counts(detections: DataFrame, grid: DataFrame) -> DataFrame:
    """Per processed frame, detections of every category, zeros kept."""
    per = (detections.groupBy("video_id", "frame_idx").pivot("category", CATEGORIES).agg(F.count(F.lit(1))))
    out = grid.select("video_id", "frame_idx", "t").join(per, ["video_id", "frame_idx"], "left")
    return out.select("video_id", "frame_idx", "t",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in CATEGORIES])

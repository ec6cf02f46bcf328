"""Steps shared by the rules."""
from pyspark.sql import DataFrame, functions as F

from ..operators.intervals import US

BLOCK_US = 60 * US


def events(df: DataFrame, label: str) -> DataFrame:
    """start_us / end_us rows -> video_id, start_sec, end_sec, label."""
    return df.select("video_id", (F.col("start_us") / US).alias("start_sec"),
                     (F.col("end_us") / US).alias("end_sec"), F.lit(label).alias("label"))


def samples_in(spans: DataFrame, samples: DataFrame, cols: list[str]) -> DataFrame:
    """The track's own samples inside each span, joined on (track, minute)."""
    blk = lambda c: F.floor(F.col(c) / BLOCK_US)
    s = samples.select("video_id", "track_id", "t_us", *cols).withColumn("_blk", blk("t_us"))
    q = spans.withColumn("_blk", F.explode(F.sequence(blk("start_us"), blk("end_us"))))
    return (q.join(s, ["video_id", "track_id", "_blk"])
            .filter((F.col("t_us") >= F.col("start_us")) & (F.col("t_us") <= F.col("end_us"))).drop("_blk"))


def extend_to_track_end(slack: float):
    """End of the track when it disappears within ``slack`` seconds of the span's end."""
    return F.when(F.col("last_us") - F.col("end_us") <= int(slack * US), F.col("last_us")).otherwise(F.col("end_us"))

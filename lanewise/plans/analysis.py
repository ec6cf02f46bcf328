"""Everything the rules read about a set of videos."""
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..constants import ANALYSIS_RATE
from ..functions import geometry as G
from ..operators import tracks as T
from ..operators.signals import signal_timeline
from ..operators.slices import SLICE_US
from ..session import materialise, sized


@dataclass
class Analysis:
    """Lazy tables of one run over many videos."""
    videos: DataFrame        # video_id, fps, n_frames, width, height, duration, scene_id
    scene: DataFrame         # one row per video, see sources.layout
    samples: DataFrame       # track samples with kinematics, zone and track statistics
    frames: DataFrame        # every processed frame
    signals: DataFrame | None = None   # video_id, head, frame_idx, t_us, code
    pixels: DataFrame | None = None    # cue pixels
    cue_boxes: DataFrame | None = None
    cues: DataFrame | None = None      # video_id, cue_idx, t_us
    drift: DataFrame | None = None


def with_zone(samples: DataFrame, scene: DataFrame) -> DataFrame:
    """Zone of the ground point. The scene has one row per video; Spark broadcasts it while it is small."""
    shapes = scene.select("video_id", "islands", "roads", "crosswalks")
    z = G.zone_of(F.col("islands"), F.col("roads"), F.col("crosswalks"), F.col("px"), F.col("py"))
    return samples.join(shapes, "video_id").withColumn("zone", z).drop("islands", "roads", "crosswalks")


def prepare(videos: DataFrame, scene: DataFrame, obs: DataFrame, states: DataFrame | None = None,
            rate: float = ANALYSIS_RATE, slice_us: int = SLICE_US, **cues) -> Analysis:
    """Track observations and signal readings -> the tables the rules share.

    Samples feed all rules, so they are written to the shared checkpoint
    folder once instead of being recomputed by each of them.
    """
    scene = sized(materialise(scene))
    tracks = materialise(T.min_samples(T.majority_category(obs)))
    base = materialise(with_zone(T.kinematics(obs, tracks, videos, slice_us), scene))
    samples = materialise(T.with_stats(base, T.track_stats(base), slice_us))
    return Analysis(videos=videos, scene=scene, samples=samples, frames=T.frame_grid(videos, rate),
                    signals=materialise(signal_timeline(states)) if states is not None else None, **cues)

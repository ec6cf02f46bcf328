"""All rules over all videos."""
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.intervals import finalize_events
from . import conflicts, junction, pedestrians, scene_events, vehicles
from .analysis import Analysis

# a rule is any function Analysis -> (video_id, start_sec, end_sec, label); add your own here
RULES: dict[str, Callable[[Analysis], DataFrame]] = {
    "red_light": junction.red_light,
    "wrong_way": vehicles.wrong_way,
    "illegal_u_turn": vehicles.illegal_u_turn,
    "stopped_vehicle": vehicles.stopped_vehicle,
    "jaywalking": pedestrians.jaywalking,
    "failure_to_yield": pedestrians.failure_to_yield,
    "illegal_turn": vehicles.illegal_turn,
    "solid_line_crossing": vehicles.solid_line_crossing,
    "stop_line": junction.stop_line,
    "congestion": junction.congestion,
    "road_obstacle": scene_events.road_obstacle,
    "fire_smoke": scene_events.fire_smoke,
}
PAIR_RULES = {"accident": conflicts.accident, "near_miss": conflicts.near_miss}


def union_events(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def raw_events(an: Analysis, classes: list[str] | None = None) -> DataFrame:
    """Union of the chosen rules; rules without their input table (signals, pixels) are left out."""
    wanted = [c for c in [*PAIR_RULES, *RULES] if classes is None or c in classes]
    skip = set()
    if an.signals is None:
        skip.add("red_light")
    if an.pixels is None:
        skip.add("fire_smoke")
    wanted = [c for c in wanted if c not in skip]
    parts = [RULES[c](an) for c in wanted if c in RULES]
    pairs = [c for c in wanted if c in PAIR_RULES]
    if pairs:
        # both pair rules come out of one walk over the pairs
        found = conflicts.conflict_events(an, near_misses="near_miss" in pairs)
        parts.append(found.filter(F.col("label").isin(pairs)))
    return union_events(parts)


def detect(an: Analysis, classes: list[str] | None = None) -> DataFrame:
    """Clean events: merged per class, clipped to the video, short ones dropped, sorted by start and label."""
    return finalize_events(raw_events(an, classes), an.videos).orderBy("video_id", "start_sec", "label")

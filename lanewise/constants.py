"""Class names, metric parameters and rule thresholds.

They have to equal the published rule set for results to be comparable.
Lengths are in body sizes (sqrt of box area), angles in degrees, times in
seconds unless a name says otherwise.
"""
from dataclasses import dataclass

CLASSES = [
    "accident", "near_miss", "red_light", "wrong_way", "illegal_u_turn",
    "stopped_vehicle", "jaywalking", "failure_to_yield", "illegal_turn",
    "solid_line_crossing", "stop_line", "congestion", "road_obstacle", "fire_smoke",
]

CATEGORIES = ["person", "bicycle", "car", "motorcycle", "bus", "truck", "animal"]
VEHICLES = ["car", "bus", "truck"]
TWO_WHEELERS = ["bicycle", "motorcycle"]
# detector model class id -> category; other ids are not road users
MODEL_CLASSES = {
    0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck",
    15: "animal", 16: "animal", 17: "animal", 18: "animal", 19: "animal",
}

# per class: bridge gaps up to MERGE_GAP seconds, then drop segments under MIN_LEN
MERGE_GAP = {"jaywalking": 1.5, "red_light": 2.0, "congestion": 5.0, "stopped_vehicle": 2.0,
             "accident": 2.0, "road_obstacle": 3.0, "fire_smoke": 3.0}
MIN_LEN = {"stopped_vehicle": 10.0, "congestion": 15.0, "jaywalking": 1.0, "red_light": 0.5,
           "accident": 0.5, "near_miss": 0.5, "failure_to_yield": 0.3}
DEFAULT_GAP, DEFAULT_MIN = 1.0, 0.5

TIOU_THRESHOLDS = (0.3, 0.5, 0.7)
HORIZON, ALARM_WINDOW, THETA, ALARM_GAP = 5.0, 10.0, 0.5, 2.0
WEIGHT_A, WEIGHT_B = 0.7, 0.3
W_AP, W_F1, W_MTTA = 0.4, 0.4, 0.2
TIME_FACTOR = 3.0

ANALYSIS_RATE, RISK_RATE = 12.5, 8.0
MIN_TRACK_SAMPLES = 5
MIN_SIZE_FRAC = 0.012
SIGNAL_STATES = ["unknown", "red", "amber", "green"]
MIN_LIT_PX = 4
MIN_INLIERS = 25
SCALE_RANGE = (0.7, 1.4)
CUE_PERIOD, CUE_WIDTH = 0.5, 384
GRID_X, GRID_Y = 32, 18
JUNCTION_ZONES = ["junction_box", "intersection", "crosswalk_main", "crosswalk_side"]


@dataclass(frozen=True)
class WrongWay:
    min_speed: float = 0.5
    max_cos: float = -0.5
    gap: float = 0.8
    min_duration: float = 1.2
    min_travel: float = 1.5


@dataclass(frozen=True)
class UTurn:
    window: float = 20.0
    min_turn: float = 150.0
    min_path: float = 2.5
    min_excursion: float = 1.0
    min_speed: float = 0.5
    max_pause: float = 3.0
    min_samples: int = 10
    turning_rate: float = 10.0
    trim_start: float = 15.0
    trim_end: float = 20.0


@dataclass(frozen=True)
class Stopped:
    max_speed: float = 0.12
    gap: float = 1.5
    min_duration: float = 15.0
    min_overtakes: int = 2
    min_size: float = 0.035
    zones: tuple = ("intersection", "side_road")
    zone_share: float = 0.8
    radius: float = 3.0


@dataclass(frozen=True)
class SolidLine:
    side_margin: float = 0.3
    max_duration: float = 4.0
    min_speed: float = 0.3


@dataclass(frozen=True)
class IllegalTurn:
    min_samples: int = 5
    rate: float = 8.0
    gap: float = 1.0
    net: float = 45.0


@dataclass(frozen=True)
class Jaywalk:
    min_duration: float = 1.0
    min_speed: float = 0.4
    max_speed: float = 1.6
    road_margin: float = 0.25
    crosswalk_margin: float = 0.35
    gap: float = 0.8


@dataclass(frozen=True)
class Yield:
    min_speed: float = 1.0
    ped_speed: float = 0.5
    reach: float = 1.5
    crosswalk_margin: float = 0.35
    gap: float = 0.5


@dataclass(frozen=True)
class RedLight:
    min_speed: float = 0.5
    red_before: float = 1.0
    min_cos: float = 0.5
    from_behind: float = 0.5


@dataclass(frozen=True)
class StopLine:
    max_speed: float = 0.12
    min_duration: float = 2.0
    past: float = 0.1
    gap: float = 1.0
    red_share: float = 0.5
    hold_speed: float = 0.15
    hold_depth: float = 3.0
    hold_ahead: float = 0.3


# direction -> zones, vehicles needed, slow speed, slow share, seconds
CONGESTION = {
    "towards_camera": (("approach_down", "junction_box", "intersection"), 8, 0.3, 0.75, 30.0),
    "away": (("upper",), 5, 0.3, 0.8, 30.0),
}


@dataclass(frozen=True)
class Conflict:
    candidate_dist: float = 2.0
    min_size: float = 0.045
    approach_dist: float = 1.5
    contact_dist: float = 0.8
    contact_iou: float = 0.10
    pre_speed: float = 1.5
    pre_closing: float = 0.8
    keep: float = 0.2
    deflect: float = 45.0
    stop_speed: float = 0.2
    rest: float = 2.0
    rest_dist: float = 1.2
    max_len: float = 10.0
    ttc: float = 1.0
    min_closing: float = 0.8
    max_gap: float = 1.8
    nm_keep: float = 0.4
    cpa: float = 0.5
    nm_speed: float = 1.5
    swerve: float = 60.0
    clear_dist: float = 2.5
    nm_max_len: float = 6.0


@dataclass(frozen=True)
class Obstacle:
    animal_duration: float = 1.0
    eval_period: float = 1.0
    past: tuple = (-40.0, -15.0)
    future: float = 8.0
    diff: float = 32.0
    coverage: float = 0.05
    area: tuple = (0.0006, 0.006)
    max_drift: float = 6.0
    min_response: float = 0.1
    min_fill: float = 0.35
    max_aspect: float = 4.0
    min_persist: float = 8.0
    pad: float = 0.15
    min_past: int = 8
    min_future: int = 4


@dataclass(frozen=True)
class Fire:
    window: float = 3.0
    min_area: float = 0.0004
    min_cv: float = 0.2
    max_drift: float = 0.02
    min_duration: float = 2.0
    gap: float = 2.0


@dataclass(frozen=True)
class Risk:
    history: float = 4.0
    vel_window: float = 0.6
    tau: float = 1.5
    pair_dist: float = 3.0
    hit: float = 0.35
    tcpa: float = 1.0
    min_gap: float = 0.6
    static_speed: float = 0.3
    static_hit: float = 0.2
    wrong_way: float = 0.3


@dataclass(frozen=True)
class Tracking:
    high: float = 0.35
    low: float = 0.15
    new_track: float = 0.4
    match_iou: float = 0.2
    max_age: float = 1.5
    max_age_static: float = 6.0
    min_hits: int = 2
    horizon: float = 0.5
    max_speed: float = 8.0
    gate_dist: float = 0.8
    gate_size: tuple = (0.6, 1.6)
    stitch_gap: float = 8.0

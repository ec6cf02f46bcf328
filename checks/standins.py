"""Stand-in tables of the traffic domain, derived from the given tables by plain arithmetic.

The expressions are written once as text both engines understand, so a query
and its check read exactly the same rows.
"""
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanewise.plans.analysis import prepare
from lanewise.session import materialise, sized
from lanewise.sources.layout import layout_from_text, load_scene

FRAMES = 300
_PREPARED: dict = {}
W, H, FPS, DURATION = 1662, 924, 12.5, 24.0


def rect(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]


LAYOUT = {
    "ref_size": [W, H],
    "road": {"upper": rect(0, 0, W, 300), "intersection": rect(0, 300, W, H)},
    "islands": {"median": rect(600, 300, 800, 400)},
    "crosswalks": {"main": rect(900, 0, 1000, H)},
    "approaches": {
        "east": {"zone": "intersection", "direction": [1, 0], "stop_line": [[850, 0], [850, H]],
                 "box_zone": rect(850, 0, 1250, H), "signal_head": "h0"},
        "north": {"zone": "intersection", "direction": [0, -1], "stop_line": [[100, 500], [1500, 500]],
                  "box_zone": rect(100, 200, 1500, 500)}},
    "wrong_way_zones": {"all": {"polygon": rect(0, 0, W, H), "direction": [1, 0]}},
    "signal_lights": {"_note": "x", "h0": {"box": [1, 1, 7, 7], "kind": "vehicle"}},
    "solid_lines": {"_note": "x", "mid": [[300, 0], [340, 500], [300, H]]},
    "forbidden_movements": {"pairs": [["upper", "intersection"]]},
}

# text valid in both engines; 8e-2 style literals are doubles in both
TRACKS = """
SELECT CONCAT('v', CAST(s_suppkey % 4 AS VARCHAR(9))) AS video_id, CAST(s_suppkey AS BIGINT) AS track_id, CAST(f AS INT) AS frame_idx,
  f * 8e-2 AS t, CAST(f * 80000 AS BIGINT) AS t_us,
  CASE s_suppkey % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'motorcycle' WHEN 3 THEN 'bus' WHEN 4 THEN 'truck' ELSE 'car' END AS category,
  gx - w / 2e0 AS x1, gy - 65e-2 * w AS y1, gx + w / 2e0 AS x2, gy AS y2
FROM (SELECT s_suppkey, f, 40e0 + s_suppkey % 120 AS w,
        (s_suppkey * 97 % 1400) + 100e0 + (s_nationkey - 12) * 12e0 * k * 8e-2 AS gx,
        (s_suppkey * 53 % 700) + 150e0 + (s_suppkey % 5 - 2) * 15e0 * k * 8e-2 AS gy
      FROM (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, f,
              LEAST(f, 100 + s_suppkey % 150) AS k
            FROM {frames}) a
      WHERE (f * 31 + s_suppkey * 17) % 11 <> 0) b
"""
RISK = """
SELECT CONCAT('v', CAST(user_id % 8 AS VARCHAR(9))) AS video_id, CAST(event_id AS BIGINT) AS pos,
  {epoch} / 3600e0 AS t, CAST({epoch} * 1000000 AS BIGINT) AS t_us, LEAST(1e0, value / 1e2) AS score
FROM events
"""
SIGNAL = """
SELECT CONCAT('v', CAST(user_id % 4 AS VARCHAR(9))) AS video_id, CONCAT('h', CAST(user_id % 3 AS VARCHAR(9))) AS head,
  CAST(event_id AS INT) AS frame_idx, CAST({epoch} * 1000 AS BIGINT) AS t_us,
  CASE event_type WHEN 'click' THEN 'green' WHEN 'view' THEN 'red' WHEN 'purchase' THEN 'amber' WHEN 'signup' THEN 'red' ELSE 'unknown' END AS state
FROM events
"""
LABELS = "CASE {k} % 3 WHEN 0 THEN 'accident' WHEN 1 THEN 'near_miss' ELSE 'red_light' END"
PRED = f"""
SELECT CONCAT('v', CAST(l_suppkey % 20 AS VARCHAR(9))) AS video_id, {LABELS.format(k='l_linenumber')} AS label,
  {{days}} % 600 + l_orderkey % 18 * 6e2 AS start_sec, {{days}} % 600 + l_orderkey % 18 * 6e2 + l_quantity / 1e1 AS end_sec,
  CAST(l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(ROUND(l_extendedprice * 1e2) AS BIGINT) % 100000000 AS BIGINT) AS pos
FROM lineitem
"""
TRUTH = f"""
SELECT CONCAT('v', CAST(o_custkey % 20 AS VARCHAR(9))) AS video_id, {LABELS.format(k='o_orderkey')} AS label,
  {{days}} % 600 + o_orderkey % 18 * 6e2 AS start_sec, {{days}} % 600 + o_orderkey % 18 * 6e2 + 1e0 + o_orderkey % 5 AS end_sec, CAST(o_orderkey AS BIGINT) AS pos
FROM orders
"""
PIXELS = """
SELECT CONCAT('v', CAST(vec_id % 4 AS VARCHAR(9))) AS video_id, CAST(vec_id AS BIGINT) AS cue_idx, CAST(vec_id * 500000 AS BIGINT) AS t_us,
  CAST(i % 8 AS INT) AS x, CAST(FLOOR(i / 8) AS INT) AS y, 128e0 + 200e0 * CAST(v AS DOUBLE) AS gray,
  CAST(ABS(FLOOR(CAST(v AS DOUBLE) * 1e4)) % 256 AS INT) AS r, CAST(ABS(FLOOR(CAST(v AS DOUBLE) * 7e3)) % 256 AS INT) AS g,
  CAST(ABS(FLOOR(CAST(v AS DOUBLE) * 3e3)) % 128 AS INT) AS b
FROM {pixels}
"""
DET = "SELECT *, 1e-1 + ((track_id * 13 + frame_idx * 7) % 90) / 1e2 AS score FROM s_tracks"


def duck() -> dict[str, str]:
    """CTE bodies for the checking engine."""
    epoch = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"
    return {
        "s_tracks": TRACKS.format(frames="supplier, range(0, 300) r(f)"),
        "s_det": DET,
        "s_risk": RISK.format(epoch=epoch), "s_signal": SIGNAL.format(epoch=epoch),
        "s_pred": PRED.format(days="date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"),
        "s_truth": TRUTH.format(days="date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"),
        "s_pixels": PIXELS.format(pixels="(SELECT vec_id, embedding[j + 1] AS v, j AS i FROM embeddings, range(0, 64) q(j))"),
        "s_videos": "SELECT DISTINCT video_id, 125e-1 AS fps, 300 AS n_frames, 1662 AS width, 924 AS height, 24e0 AS duration FROM s_tracks",
        "s_gt_videos": "SELECT DISTINCT CONCAT('v', CAST(c_custkey % 20 AS VARCHAR(9))) AS video_id, 108e2 AS duration, 25e0 AS fps FROM customer",
    }


def tables(spark: SparkSession, sf: str):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(spark, text, **views):
    return spark.sql(text, **views)


def each_frame(spark, sf) -> DataFrame:
    """Every supplier in every frame, as a join: its estimated size counts the frames, an ``explode``'s doesn't and would be broadcast.

    The suppliers are a small file, so they are dealt out before they grow.
    """
    sup = tables(spark, sf)("supplier").select("s_suppkey", "s_nationkey")
    dealt = sup.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    return dealt.crossJoin(F.broadcast(spark.range(FRAMES).withColumnRenamed("id", "f")))


def tracks(spark, sf) -> DataFrame:
    return _sql(spark, TRACKS.format(frames="{sup}"), sup=each_frame(spark, sf))


def det(spark, sf) -> DataFrame:
    return _sql(spark, DET.replace("s_tracks", "{t}"), t=tracks(spark, sf))


EPOCH = "(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) / 1e6"


def risk(spark, sf) -> DataFrame:
    return _sql(spark, RISK.format(epoch=EPOCH).replace("FROM events", "FROM {e}"), e=tables(spark, sf)("events"))


def signal(spark, sf) -> DataFrame:
    return _sql(spark, SIGNAL.format(epoch=EPOCH).replace("FROM events", "FROM {e}"), e=tables(spark, sf)("events"))


def pred(spark, sf) -> DataFrame:
    return _sql(spark, PRED.format(days="datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01')").replace("FROM lineitem", "FROM {l}"),
                l=tables(spark, sf)("lineitem"))


def truth(spark, sf) -> DataFrame:
    return _sql(spark, TRUTH.format(days="datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01')").replace("FROM orders", "FROM {o}"),
                o=tables(spark, sf)("orders"))


def pixels(spark, sf) -> DataFrame:
    e = tables(spark, sf)("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return _sql(spark, PIXELS.format(pixels="{e}"), e=e)


def videos(spark, sf) -> DataFrame:
    v = tables(spark, sf)("supplier").select(F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string")).alias("video_id")).distinct()
    return v.selectExpr("video_id", "125e-1 AS fps", "300 AS n_frames", "1662 AS width", "924 AS height", "24e0 AS duration", "'flat' AS scene_id")


def gt_videos(spark, sf) -> DataFrame:
    v = tables(spark, sf)("customer").select(F.concat(F.lit("v"), (F.col("c_custkey") % 20).cast("string")).alias("video_id")).distinct()
    return v.selectExpr("video_id", "108e2 AS duration", "25e0 AS fps")


def scene(spark, sf) -> DataFrame:
    """Scene rows of a folder, loaded once per session."""
    key = (spark.sparkContext.applicationId, sf, "scene")
    if key not in _PREPARED:
        _PREPARED[key] = _load(spark, sf)
    return _PREPARED[key]


def _load(spark, sf) -> DataFrame:
    lay = layout_from_text(spark.createDataFrame([("flat", json.dumps(LAYOUT))], "scene_id string, doc string"), "doc")
    return sized(materialise(load_scene(lay, videos(spark, sf))))


def heads(spark, sf) -> DataFrame:
    """Head h0 of each video: the colour of each 50-frame block follows from its number of events."""
    e = tables(spark, sf)("events")
    return _sql(spark, HEADS.format(e="{e}", frames="(SELECT b, explode(sequence(b * 50, b * 50 + 49)) AS f, video_id, n FROM ({blocks}))"
                                    .format(blocks=HEAD_BLOCKS.format(e="{e}"))), e=e)


HEAD_BLOCKS = ("SELECT CONCAT('v', CAST(user_id % 4 AS VARCHAR(9))) AS video_id, event_id % 6 AS b, COUNT(*) AS n FROM {e} GROUP BY 1, 2")
HEADS = """
SELECT video_id, 'h0' AS head, CAST(f AS INT) AS frame_idx, CAST(f * 80000 AS BIGINT) AS t_us,
  CASE WHEN f % 11 = 0 THEN 'unknown' WHEN n % 3 = 0 THEN 'green' ELSE 'red' END AS state
FROM {frames}
"""


def duck_heads() -> str:
    blocks = HEAD_BLOCKS.format(e="events")
    return HEADS.format(frames=f"(SELECT b, b * 50 + j AS f, video_id, n FROM ({blocks}) k, range(0, 50) q(j)) z")


def analysis(spark, sf):
    """The shared analysis of a folder, prepared once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        _PREPARED[key] = prepare(videos(spark, sf), scene(spark, sf), tracks(spark, sf), heads(spark, sf))
    return _PREPARED[key]



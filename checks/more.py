"""Risk, EDA, pixel cues, tracking and streaming."""
from pyspark.sql import functions as F

from checks import standins as S
from checks.basic import rd, recursive
from checks.motion import ZONE, sd
from checks.registry import SQL, define, query, r, with_steps
from lanewise.constants import Fire, Obstacle
from lanewise.functions import motion as M
from lanewise.operators import backgrounds as BG, cues as C, signals as SG, tracks as T
from lanewise.operators.tracking import stitch_static, track_detections
from lanewise.plans import eda, risk as RK, scene_events as SE
from lanewise.plans.analysis import Analysis
from lanewise.session import materialise
from lanewise.streaming import jobs, runner

# ---- risk -------------------------------------------------------------------
define("rk0", """SELECT *, (x1 + x2) / 2e0 AS px, y2 AS py, SQRT(GREATEST(1e0, (x2 - x1) * (y2 - y1))) AS size, category IN ('car', 'bus', 'truck', 'bicycle', 'motorcycle') AS mobile,
ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY t_us) >= 3 AS ready FROM s_tracks WHERE frame_idx % 2 = 0""", "s_tracks")
RW = "(PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)"
define("rk1", f"""SELECT *, COUNT(*) OVER {RW} AS n, CASE WHEN COUNT(*) OVER {RW} >= 3 THEN REGR_SLOPE(px, t_us / 1e6) OVER {RW} ELSE 0e0 END AS vx,
CASE WHEN COUNT(*) OVER {RW} >= 3 THEN REGR_SLOPE(py, t_us / 1e6) OVER {RW} ELSE 0e0 END AS vy FROM rk0""", "rk0")
define("rk2", "SELECT *, SQRT(vx * vx + vy * vy) / size AS speed FROM rk1", "rk1")
define("rk3", f"""SELECT *, CASE WHEN n >= 3 THEN (speed - FIRST_VALUE(speed) OVER {RW}) / GREATEST((t_us - FIRST_VALUE(t_us) OVER {RW}) / 1e6, 1e-3) ELSE 0e0 END AS decel FROM rk2""", "rk2")


def _live(spark, sf):
    return T.sample_frames(S.tracks(spark, sf), S.videos(spark, sf), 8.0)


def _states(spark, sf):
    return RK.user_states(_live(spark, sf), slice_us=6_000_000)


@query("track_velocity", f"SELECT video_id, track_id, t_us, {r('vx', 3)} AS vx, {r('vy', 3)} AS vy, {r('speed')} AS speed, ready FROM rk3", "rk3")
def track_velocity(spark, sf):
    return rd(rd(_states(spark, sf).select("video_id", "track_id", "t_us", "vx", "vy", "speed", "ready"), "vx", "vy", n=3), "speed")


@query("decel", f"SELECT video_id, track_id, t_us, {r('decel')} AS decel FROM rk3", "rk3")
def decel(spark, sf):
    return rd(_states(spark, sf).select("video_id", "track_id", "t_us", "decel"), "decel")


SG_ = lambda x: f"(1e0 / (1e0 + EXP(-({x}))))"
define("pr0", """SELECT a.video_id, a.frame_idx, a.track_id AS a_id, b.track_id AS b_id, LEAST(a.size, b.size) AS sc, b.px - a.px AS dx, b.py - a.py AS dy, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy,
LEAST(a.speed, b.speed) AS slow, LEAST(a.decel, b.decel) AS brake FROM rk3 a JOIN rk3 b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id
WHERE a.ready AND b.ready AND (a.mobile OR b.mobile)""", "rk3")
define("pr1", """SELECT *, SQRT(dx * dx + dy * dy) / sc AS gap, SQRT(dvx * dvx + dvy * dvy) / sc AS v, -(dx * dvx + dy * dvy) / NULLIF(dvx * dvx + dvy * dvy, 0) AS t FROM pr0""", "pr0")
define("pr2", """SELECT *, SQRT(POW((dx + dvx * t) / sc, 2) + POW((dy + dvy * t) / sc, 2)) AS d FROM pr1 WHERE gap <= 3e0 AND v >= 2e-1 AND t > 0 AND t <= 4e0""", "pr1")
define("pr3", f"SELECT *, {SG_('(CASE WHEN slow >= 3e-1 THEN 35e-2 ELSE 2e-1 END - d) / 12e-2')} * {SG_('(gap - 6e-1) / 1e-1')} AS course FROM pr2", "pr2")
RISK_ = f"course * {SG_('(1e0 - t) / 35e-2')} * {SG_('(v - 1e0) / 2e-1')}"
define("pr4", f"""SELECT video_id, frame_idx, a_id, b_id, CASE WHEN brake < -15e-1 AND course > 5e-1 AND t < 2e0 THEN GREATEST({RISK_}, 4e-1) ELSE {RISK_} END AS risk,
2e-1 * course * {SG_('(25e-1 - t) / 8e-1')} AS soft FROM pr3""", "pr3")


# the velocities are fits, whose last digits follow from the order of the sums: what lies within 1e-9 of a limit lies on it
define("pt2", """SELECT *, SQRT(POW((dx + dvx * t) / sc, 2) + POW((dy + dvy * t) / sc, 2)) AS d FROM pr1 WHERE gap <= 3e0 + 1e-9 AND v >= 2e-1 - 1e-9 AND t > 1e-9 AND t <= 4e0 + 1e-9""", "pr1")
define("pt3", f"SELECT *, {SG_('(CASE WHEN slow >= 3e-1 - 1e-9 THEN 35e-2 ELSE 2e-1 END - d) / 12e-2')} * {SG_('(gap - 6e-1) / 1e-1')} AS course FROM pt2", "pt2")
define("pt4", f"""SELECT video_id, frame_idx, a_id, b_id, CASE WHEN brake < -15e-1 - 1e-9 AND course > 5e-1 AND t < 2e0 - 1e-9 THEN GREATEST({RISK_}, 4e-1) ELSE {RISK_} END AS risk,
2e-1 * course * {SG_('(25e-1 - t) / 8e-1')} AS soft FROM pt3""", "pt3")


@query("pair_risk", f"SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, a_id, b_id, {r('risk', 5)} AS risk, {r('soft', 5)} AS soft FROM pt4", "pt4")
def pair_risk(spark, sf):
    p = RK.pair_risk(_states(spark, sf)).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    return rd(p, "risk", "soft", n=5)


define("wr", f"SELECT DISTINCT video_id, frame_idx FROM rk3 WHERE ready AND mobile AND speed > 5e-1 AND vx / (SQRT(vx * vx + vy * vy) + 1e-9) < -5e-1 AND {sd(0, 0, 1662, 924)} >= 0", "rk3")


@query("wrong_way_risk", "SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx FROM wr", "wr")
def wrong_way_risk(spark, sf):
    w = RK.wrong_way_risk(_states(spark, sf), S.scene(spark, sf))
    return w.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx")).distinct()


define("raw", """SELECT f.video_id, f.frame_idx, f.t_us, GREATEST(COALESCE(p.m, 0), CASE WHEN w.video_id IS NULL THEN 0e0 ELSE 3e-1 END) AS raw FROM (SELECT * FROM frames WHERE frame_idx % 2 = 0) f
LEFT JOIN (SELECT video_id, frame_idx, GREATEST(MAX(risk), MAX(soft)) AS m FROM pr4 GROUP BY 1, 2) p USING (video_id, frame_idx) LEFT JOIN wr w ON w.video_id = f.video_id AND w.frame_idx = f.frame_idx""", "frames", "pr4", "wr")
# frame after frame, as the score is defined
FILTER = """steps AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY t_us) AS n, LAG(raw) OVER (PARTITION BY video_id ORDER BY t_us) AS before FROM raw),
run AS (SELECT video_id, frame_idx, n, 5e-1 * raw AS score FROM steps WHERE n = 1
UNION ALL SELECT s.video_id, s.frame_idx, s.n, GREATEST(5e-1 * (s.raw + s.before), q.score * EXP(-16e-2 / 15e-1)) FROM run q JOIN steps s ON s.video_id = q.video_id AND s.n = q.n + 1)"""
SQL["risk_score"] = with_steps("", "raw", recursive=True).strip() + ",\n" + FILTER + f"\nSELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, {r('LEAST(1e0, GREATEST(0e0, score))', 6)} AS score FROM run"
SQL["risk_hold"] = with_steps("", "raw", recursive=True).strip() + ",\n" + FILTER + f"""
SELECT f.video_id, CAST(f.frame_idx AS BIGINT) AS pos, {r('f.frame_idx / 125e-1', 4)} AS t, {r('LEAST(1e0, GREATEST(0e0, score))', 4)} AS score FROM frames f JOIN run q ON q.video_id = f.video_id AND q.frame_idx = f.frame_idx - f.frame_idx % 2"""


def _score(spark, sf):
    return RK.risk_curve(_live(spark, sf), S.scene(spark, sf), T.frame_grid(S.videos(spark, sf), 8.0))


@query("risk_score")
def risk_score(spark, sf):
    return rd(_score(spark, sf).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "score"), "score", n=6)


@query("risk_hold")
def risk_hold(spark, sf):
    return RK.risk_hold(_score(spark, sf), S.videos(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query("risk_reset", """SELECT video_id, track_id, COUNT(*) AS n FROM (SELECT *, at_us - LAG(at_us) OVER (PARTITION BY video_id, track_id ORDER BY at_us) AS gap FROM (SELECT *, t_us + FLOOR(frame_idx / (20 + track_id % 80)) * 4000000 AS at_us FROM s_tracks)) WHERE gap IS NULL OR gap > 4000000 GROUP BY 1, 2""", "s_tracks")
def risk_reset(spark, sf):
    return RK.first_category(S.tracks(spark, sf).withColumn("t_us", F.expr("CAST(t_us + FLOOR(frame_idx / (20 + track_id % 80)) * 4000000 AS BIGINT)"))).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


# ---- EDA --------------------------------------------------------------------

@query("counts_over_time", f"""SELECT c.video_id, c.category, b AS bin, {r("COUNT(s.t_us) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM frames f WHERE f.video_id = c.video_id AND FLOOR(f.t_us / 1e6) = b)", 2)} AS per_frame
FROM (SELECT DISTINCT video_id, category FROM s_tracks) c CROSS JOIN range(0, 24) g(b) LEFT JOIN s_tracks s ON s.video_id = c.video_id AND s.category = c.category AND FLOOR(s.t_us / 1e6) = b GROUP BY 1, 2, 3""", "s_tracks", "frames")
def counts_over_time(spark, sf):
    v = S.videos(spark, sf)
    return eda.counts_over_time(S.tracks(spark, sf), T.frame_grid(v, 12.5), v).withColumn("bin", F.col("bin").cast("long"))


@query("zone_occupancy", f"""SELECT v.video_id, z.zone, b AS bin, {r("COUNT(s.t_us) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM frames f WHERE f.video_id = v.video_id AND FLOOR(f.t_us / 1e6) = b)", 2)} AS vehicles, {r('MEDIAN(s.speed)', 2)} AS median_speed
FROM s_videos v CROSS JOIN (VALUES ('upper'), ('intersection')) z(zone) CROSS JOIN range(0, 24) g(b) LEFT JOIN (SELECT * FROM smp WHERE category NOT IN ('person', 'animal')) s ON s.video_id = v.video_id AND s.zone = z.zone AND FLOOR(s.t_us / 1e6) = b GROUP BY 1, 2, 3""",
       "s_videos", "smp", "frames")
def zone_occupancy(spark, sf):
    an = S.analysis(spark, sf)
    return eda.zone_occupancy(an.samples, an.scene, an.frames, an.videos).withColumn("bin", F.col("bin").cast("long"))


CARS = "category IN ('car', 'bus', 'truck')"


@query("speed_histogram", f"SELECT video_id, CAST(LEAST(FLOOR(speed * 5e0), 29) AS BIGINT) AS bin, COUNT(*) AS n FROM smp WHERE {CARS} AND speed BETWEEN 0 AND 6 GROUP BY 1, 2", "smp")
def speed_histogram(spark, sf):
    return eda.speed_histogram(S.analysis(spark, sf).samples).withColumn("bin", F.col("bin").cast("long"))


@query("stationary_fraction", f"SELECT video_id, {r('AVG(CASE WHEN speed < 12e-2 THEN 1e0 ELSE 0e0 END)', 3)} AS stationary_fraction FROM smp WHERE {CARS} GROUP BY 1", "smp")
def stationary_fraction(spark, sf):
    return eda.stationary_fraction(S.analysis(spark, sf).samples)


@query("track_summary", "SELECT video_id, category, COUNT(DISTINCT track_id) AS n_tracks, 1662 AS width, 924 AS height, 125e-1 AS fps, 24e0 AS duration, 300 AS n_frames FROM smp GROUP BY 1, 2", "smp")
def track_summary(spark, sf):
    an = S.analysis(spark, sf)
    return eda.track_summary(an.samples, an.videos)


@query("trajectories", f"""SELECT video_id, track_id, category AS cls, {r('first_us / 1e6', 2)} AS t0, n - 1 AS idx, {r('px / 1662e0')} AS nx, {r('py / 924e0')} AS ny FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS n FROM smp WHERE last_us - first_us >= 2000000) WHERE (n - 1) % 3 = 0""", "smp")
def trajectories(spark, sf):
    return eda.trajectories(S.analysis(spark, sf).samples)


# positions of the stand-in sit on cell borders; a small shift keeps rounding noise out of the cells
@query("heat_grid", "SELECT video_id, CAST(FLOOR(px / 4) AS BIGINT) AS cx, CAST(FLOOR(py / 4) AS BIGINT) AS cy, COUNT(*) AS n FROM (SELECT video_id, speed, px + 137e-4 AS px, py + 137e-4 AS py FROM smp) WHERE speed > 3e-1 AND px >= 0 AND px < 1662 AND py >= 0 AND py < 924 GROUP BY 1, 2, 3", "smp")
def heat_grid(spark, sf):
    s = S.analysis(spark, sf).samples
    return eda.heat_grid(s.withColumns({c: F.col(c) + 137e-4 for c in ("px", "py")}))


@query("direction_field", f"""SELECT video_id, gx, gy, n, {r('SQRT(ux * ux + uy * uy)')} AS coherence, {r('MOD(DEGREES(ATAN2(uy, ux)) + 360e0, 360e0)', 2)} % 360 AS angle FROM (SELECT video_id, CAST(TRUNC(px / 1662e0 * 32) AS BIGINT) AS gx, CAST(TRUNC(py / 924e0 * 18) AS BIGINT) AS gy, COUNT(*) AS n,
AVG(vx / (SQRT(vx * vx + vy * vy) + 1e-9)) AS ux, AVG(vy / (SQRT(vx * vx + vy * vy) + 1e-9)) AS uy FROM smp WHERE {CARS} AND speed > 3e-1 GROUP BY 1, 2, 3)
WHERE n >= 5 AND SQRT(ux * ux + uy * uy) >= 3e-1 AND gx BETWEEN 0 AND 31 AND gy BETWEEN 0 AND 17""", "smp")
def direction_field(spark, sf):
    d = rd(rd(eda.direction_field(S.analysis(spark, sf).samples), "coherence"), "angle", n=2)
    return d.withColumn("angle", F.col("angle") % 360).withColumns({c: F.col(c).cast("long") for c in ("gx", "gy")})


@query("still_stats", f"SELECT video_id, cue_idx, {r('AVG(gray)', 1)} AS brightness, {r('STDDEV_POP(gray)', 1)} AS contrast FROM s_pixels GROUP BY 1, 2", "s_pixels")
def still_stats(spark, sf):
    return rd(eda.still_stats(S.pixels(spark, sf)), "brightness", "contrast", n=1)


@query("stop_line_offset", "SELECT video_id, 0e0 AS dx, 0e0 AS dy FROM s_videos", "s_videos")
def stop_line_offset(spark, sf):
    import json
    from lanewise.sources.layout import layout_from_text
    lay = layout_from_text(spark.createDataFrame([("flat", json.dumps(S.LAYOUT))], "scene_id string, doc string"), "doc")
    return eda.stop_line_offset(S.scene(spark, sf), lay, "east")


@query("annotate_frames", f"""SELECT f.video_id, CAST(f.frame_idx AS BIGINT) AS frame_idx, s.track_id, {r('s.px', 3)} AS px, s.trail_points FROM
(SELECT g.video_id, g.frame_idx, COALESCE((SELECT MIN(k.t_us) FROM smp k WHERE k.video_id = g.video_id AND k.t_us >= g.t_us), (SELECT MAX(k.t_us) FROM smp k WHERE k.video_id = g.video_id)) AS near_us, g.t_us
FROM frames g) f JOIN (SELECT *, COUNT(*) OVER (PARTITION BY video_id, track_id ORDER BY t_us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW) AS trail_points FROM smp) s
ON s.video_id = f.video_id AND s.t_us = near_us WHERE ABS(near_us - f.t_us) <= 200000""", "smp", "frames")
def annotate_frames(spark, sf):
    an = S.analysis(spark, sf)
    out = eda.annotate_frames(an.frames, an.samples)
    return rd(out.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "track_id", "px", "trail_points"), "px", n=3)


# ---- pixel cues -------------------------------------------------------------

@query("lighting", f"SELECT video_id, cue_idx, {r('AVG(gray)')} AS brightness FROM s_pixels GROUP BY 1, 2", "s_pixels")
def lighting(spark, sf):
    return rd(C.lighting(S.pixels(spark, sf)), "brightness")


MX, MN = "GREATEST(r, g, b)", "LEAST(r, g, b)"
HUE0 = f"CASE WHEN {MX} = {MN} THEN 0e0 WHEN {MX} = r THEN 60e0 * (g - b) / ({MX} - {MN}) WHEN {MX} = g THEN 120e0 + 60e0 * (b - r) / ({MX} - {MN}) ELSE 240e0 + 60e0 * (r - g) / ({MX} - {MN}) END"
define("hsv", f"""SELECT *, CAST(FLOOR(CASE WHEN h0 < 0 THEN h0 + 360e0 ELSE h0 END / 2e0 + 5e-1) AS BIGINT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE CAST(FLOOR(({MX} - {MN}) * 255e0 / v + 5e-1) AS BIGINT) END AS s FROM (
SELECT *, {HUE0} AS h0, {MX} AS v FROM s_pixels)""", "s_pixels")


@query("fire_pixel", "SELECT video_id, cue_idx, x, y FROM hsv WHERE r > 190 AND r >= g AND g > b AND r - b > 90 AND h <= 30 AND s > 90 AND v > 190", "hsv")
def fire_pixel(spark, sf):
    p = S.pixels(spark, sf)
    return p.filter(M.fire_pixel(F.col("r"), F.col("g"), F.col("b"))).select("video_id", "cue_idx", "x", "y")


ON = "v >= 90 AND s >= 120"


@query("head_state", f"""SELECT video_id, frame_idx, red, amber, green, CASE WHEN GREATEST(red, amber, green) < 4 THEN 'unknown' WHEN red = GREATEST(red, amber, green) THEN 'red' WHEN amber = GREATEST(red, amber, green) THEN 'amber' ELSE 'green' END AS state
FROM (SELECT video_id, cue_idx AS frame_idx, COUNT(*) FILTER ({ON} AND (h <= 12 OR h >= 160)) AS red, COUNT(*) FILTER ({ON} AND h > 12 AND h <= 30) AS amber, COUNT(*) FILTER ({ON} AND h BETWEEN 45 AND 100) AS green
FROM hsv WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1, 2)""", "hsv")
def head_state(spark, sf):
    heads = S.scene(spark, sf).select("video_id", F.inline("heads"))
    return SG.head_state(S.pixels(spark, sf).withColumnRenamed("cue_idx", "frame_idx"), heads).drop("head")


# a still is a frame with pixels: all its statistics beside its detections, and those of frames without pixels
define("hs", f"""SELECT video_id, frame_idx, CASE WHEN GREATEST(red, amber, green) < 4 THEN 'unknown' WHEN red = GREATEST(red, amber, green) THEN 'red' WHEN amber = GREATEST(red, amber, green) THEN 'amber' ELSE 'green' END AS signal
FROM (SELECT video_id, cue_idx AS frame_idx, COUNT(*) FILTER ({ON} AND (h <= 12 OR h >= 160)) AS red, COUNT(*) FILTER ({ON} AND h > 12 AND h <= 30) AS amber, COUNT(*) FILTER ({ON} AND h BETWEEN 45 AND 100) AS green
FROM hsv WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY 1, 2)""", "hsv")
define("grey", f"SELECT video_id, cue_idx AS frame_idx, {r('AVG(gray)', 1)} AS brightness, {r('STDDEV_POP(gray)', 1)} AS contrast FROM s_pixels GROUP BY 1, 2", "s_pixels")
define("zc", f"""SELECT *, CAST(SUM(n) OVER (PARTITION BY video_id, frame_idx, category) AS BIGINT) AS n_class FROM (
SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, COALESCE({ZONE}, 'off_road') AS zone, category, COUNT(*) AS n FROM gp GROUP BY 1, 2, 3, 4)""", "gp")


@query("frame_stats", """SELECT f.video_id, f.frame_idx, zone, category, COALESCE(n, 0) AS n, COALESCE(n_class, 0) AS n_class, CAST(v.width AS BIGINT) AS width, CAST(v.height AS BIGINT) AS height, FALSE AS registered,
CAST(0 AS BIGINT) AS inliers, 850e0 AS lx0, 0e0 AS ly0, 850e0 AS lx1, 924e0 AS ly1, 0e0 AS dx, 0e0 AS dy, brightness, contrast, signal
FROM (SELECT * FROM zc FULL JOIN grey USING (video_id, frame_idx)) f LEFT JOIN hs ON hs.video_id = f.video_id AND hs.frame_idx = f.frame_idx JOIN s_videos v ON v.video_id = f.video_id""", "zc", "grey", "hs", "s_videos")
def frame_stats(spark, sf):
    import json
    from lanewise.sources.layout import layout_from_text
    lay = layout_from_text(spark.createDataFrame([("flat", json.dumps(S.LAYOUT))], "scene_id string, doc string"), "doc")
    out = eda.frame_stats(S.tracks(spark, sf), S.scene(spark, sf), S.pixels(spark, sf).withColumnRenamed("cue_idx", "frame_idx"), lay, "east")
    line = [F.col("line")[k].alias(c) for k, c in enumerate(("lx0", "ly0", "lx1", "ly1"))]
    out = out.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "zone", "category", "n", "n_class", F.col("width").cast("long").alias("width"),
                     F.col("height").cast("long").alias("height"), "registered", F.col("inliers").cast("long").alias("inliers"), *line, "dx", "dy", "brightness", "contrast",
                     F.col("signals")["h0"].alias("signal"))
    return rd(out, "brightness", "contrast", n=1)


def _cues(spark, sf):
    return S.pixels(spark, sf).select("video_id", "cue_idx", "t_us").distinct()


define("cues", "SELECT DISTINCT video_id, cue_idx, t_us FROM s_pixels", "s_pixels")
define("ev0", """SELECT video_id, UNNEST(range(MIN(t_us) + 40000000, MAX(t_us) - 8000000, 1000000)) AS eval_us FROM cues GROUP BY 1 HAVING COUNT(*) >= 10""", "cues")
define("ev1", """SELECT e.video_id, eval_us, COUNT(*) FILTER (t_us BETWEEN eval_us - 40000000 AND eval_us - 15000000) AS n_past, COUNT(*) FILTER (t_us BETWEEN eval_us AND eval_us + 8000000) AS n_future
FROM ev0 e JOIN cues c USING (video_id) GROUP BY 1, 2""", "ev0", "cues")
define("evs", "SELECT * FROM ev1 WHERE n_past >= 8 AND n_future >= 4", "ev1")
define("past", "SELECT e.video_id, eval_us, y, x, MEDIAN(gray) AS gray FROM evs e JOIN s_pixels p ON p.video_id = e.video_id AND p.t_us BETWEEN eval_us - 40000000 AND eval_us - 15000000 GROUP BY ALL", "evs", "s_pixels")
define("fut", "SELECT e.video_id, eval_us, y, x, MEDIAN(gray) AS gray FROM evs e JOIN s_pixels p ON p.video_id = e.video_id AND p.t_us BETWEEN eval_us AND eval_us + 8000000 GROUP BY ALL", "evs", "s_pixels")


@query("median_background", f"SELECT video_id, eval_us, {r('SUM(gray)', 3)} AS gray, COUNT(*) AS n FROM past GROUP BY 1, 2", "past")
def median_background(spark, sf):
    c = _cues(spark, sf)
    bg = BG.median_background(S.pixels(spark, sf), C.spans(C.eval_times(c)).filter("side = 'past'"), slice_us=60_000_000)
    return rd(bg.groupBy("video_id", "eval_us").agg(F.sum("gray").alias("gray"), F.count("*").alias("n")), "gray", n=3)


# the cue images as cameras give them: whole grey levels
define("levels", "SELECT * REPLACE (LEAST(255, GREATEST(0, CAST(FLOOR(gray) AS INT))) AS gray) FROM s_pixels", "s_pixels")
define("lmed", """SELECT video_id, eval_us, side, y, x, MEDIAN(gray) AS gray FROM (SELECT e.video_id, eval_us, 'past' AS side, y, x, gray FROM evs e JOIN levels p ON p.video_id = e.video_id AND p.t_us BETWEEN eval_us - 40000000 AND eval_us - 15000000
UNION ALL SELECT e.video_id, eval_us, 'future', y, x, gray FROM evs e JOIN levels p ON p.video_id = e.video_id AND p.t_us BETWEEN eval_us AND eval_us + 8000000) z GROUP BY ALL""", "evs", "levels")


def _levels(spark, sf):
    return S.pixels(spark, sf).withColumn("gray", F.least(F.lit(255), F.greatest(F.lit(0), F.floor("gray").cast("int"))))


@query("median_levels", "SELECT video_id, eval_us, side, y, x, gray FROM lmed", "lmed")
def median_levels(spark, sf):
    return BG.median_background(_levels(spark, sf), C.spans(C.eval_times(_cues(spark, sf))), slice_us=40_000_000)


# a drift for every evaluation time, up to three pixels in steps of 1/32; some too large, some unsure
DRIFT = "SELECT video_id, eval_us, ((eval_us / 1e6) * 37 % 105 - 52) / 16e0 AS dx, ((eval_us / 1e6) * 53 % 97 - 48) / 16e0 AS dy, CASE WHEN CAST(FLOOR(eval_us / 1e6) AS BIGINT) % 5 = 0 THEN 5e-2 ELSE 9e-1 END AS response FROM {t}"
define("drift", "SELECT *, response >= 1e-1 AND SQRT(dx * dx + dy * dy) <= 3e0 AS moves FROM (" + DRIFT.format(t="evs") + ") z", "evs")
define("weights", """SELECT video_id, eval_us, tx, ty, LEAST(7, GREATEST(0, tx + CAST(FLOOR(dx) AS INT) + a)) AS x, LEAST(7, GREATEST(0, ty + CAST(FLOOR(dy) AS INT) + b)) AS y,
CASE WHEN a = 1 THEN dx - FLOOR(dx) ELSE 1 - (dx - FLOOR(dx)) END * CASE WHEN b = 1 THEN dy - FLOOR(dy) ELSE 1 - (dy - FLOOR(dy)) END AS w
FROM (SELECT video_id, eval_us, CASE WHEN moves THEN dx ELSE 0e0 END AS dx, CASE WHEN moves THEN dy ELSE 0e0 END AS dy FROM drift) d, range(0, 8) p(tx), range(0, 8) q(ty), range(0, 2) s(a), range(0, 2) u(b)""", "drift")


@query("shift_by_drift", f"""SELECT video_id, eval_us, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, {r('SUM(w * gray)', 6)} AS gray FROM weights JOIN (SELECT * FROM lmed WHERE side = 'future') m USING (video_id, eval_us, x, y)
GROUP BY video_id, eval_us, ty, tx""", "weights", "lmed")
def shift_by_drift(spark, sf):
    times = materialise(C.eval_times(_cues(spark, sf)))
    cur = BG.median_background(_levels(spark, sf), C.spans(times).filter("side = 'future'")).drop("side")
    size = times.select("video_id", F.lit(8).alias("width"), F.lit(8).alias("height")).distinct()
    out = C.shift_by_drift(cur, spark.sql(DRIFT, t=times), size, Obstacle(max_drift=3.0))
    return rd(out.select("video_id", "eval_us", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "gray"), "gray", n=6)


# a box on every cue image, over a view of which the pixels show the left end
BOXES = "SELECT CONCAT('v', CAST(vec_id % 4 AS VARCHAR(9))) AS video_id, CAST(vec_id AS BIGINT) AS cue_idx, 2e0 * (vec_id % 60) AS x1, 0e0 + vec_id % 3 AS y1, 2e0 + 2e0 * (vec_id % 60) AS x2, 2e0 + vec_id % 3 AS y2 FROM {e}"


def _boxes(spark, sf):
    return spark.sql(BOXES, e=S.tables(spark, sf)("embeddings"))


define("cov", """SELECT DISTINCT video_id, cue_idx, y, x FROM (""" + BOXES.format(e="embeddings") + """) b, range(-1, 9) gy(y), range(-1, 124) gx(x) WHERE x BETWEEN TRUNC(x1 - 15e-2 * (x2 - x1)) AND TRUNC(x2 + 15e-2 * (x2 - x1)) AND y BETWEEN TRUNC(y1 - 15e-2 * (y2 - y1)) AND TRUNC(y2 + 15e-2 * (y2 - y1))""")
define("covp", "SELECT e.video_id, eval_us, y, x, COUNT(*) AS n_cov FROM evs e JOIN cues c ON c.video_id = e.video_id AND c.t_us BETWEEN eval_us - 40000000 AND eval_us - 15000000 JOIN cov v ON v.video_id = c.video_id AND v.cue_idx = c.cue_idx GROUP BY ALL", "evs", "cues", "cov")
define("covf", "SELECT e.video_id, eval_us, y, x, COUNT(*) AS n_cov FROM evs e JOIN cues c ON c.video_id = e.video_id AND c.t_us BETWEEN eval_us AND eval_us + 8000000 JOIN cov v ON v.video_id = c.video_id AND v.cue_idx = c.cue_idx GROUP BY ALL", "evs", "cues", "cov")


@query("box_coverage", "SELECT video_id, eval_us, y, x, n_cov FROM covp", "covp")
def box_coverage(spark, sf):
    c = _cues(spark, sf)
    m = C.windows(c, C.eval_times(c)).filter("side = 'past'")
    out = C.box_coverage(_boxes(spark, sf), m, ["eval_us"])
    return out.withColumns({k: F.col(k).cast("long") for k in ("y", "x")})


# carriageway: everything but the first two columns; its 3x3 erosion also loses column 2
define("chg", """SELECT f.video_id, f.eval_us, f.y, f.x FROM fut f JOIN (SELECT a.video_id, a.eval_us, a.y, a.x, MAX(b.gray) AS hi, MIN(b.gray) AS lo FROM past a JOIN past b ON a.video_id = b.video_id AND a.eval_us = b.eval_us
AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL) g USING (video_id, eval_us, y, x) LEFT JOIN covp p USING (video_id, eval_us, y, x) LEFT JOIN covf q USING (video_id, eval_us, y, x) JOIN evs e USING (video_id, eval_us)
WHERE (gray > hi - 8e0 OR gray < lo + 8e0) AND f.x > 2 AND COALESCE(p.n_cov, 0) / CAST(n_past AS DOUBLE) < 5e-2 AND COALESCE(q.n_cov, 0) / CAST(n_future AS DOUBLE) < 5e-2""", "fut", "past", "covp", "covf", "evs")


@query("change_mask", """SELECT DISTINCT m.video_id, m.eval_us, CAST(m.y AS BIGINT) AS y, CAST(m.x AS BIGINT) AS x FROM chg m JOIN (SELECT a.video_id, a.eval_us, a.y, a.x FROM chg a JOIN chg b ON b.video_id = a.video_id AND b.eval_us = a.eval_us AND b.y BETWEEN a.y - 1 AND a.y AND b.x BETWEEN a.x - 1 AND a.x
GROUP BY ALL HAVING COUNT(*) = CASE WHEN a.y = 0 THEN 1 ELSE 2 END * CASE WHEN a.x = 0 THEN 1 ELSE 2 END) c ON c.video_id = m.video_id AND c.eval_us = m.eval_us AND m.y BETWEEN c.y - 1 AND c.y AND m.x BETWEEN c.x - 1 AND c.x""", "chg")
def change_mask(spark, sf):
    c = _cues(spark, sf)
    times = C.eval_times(c)
    m = C.windows(c, times)
    bg = materialise(BG.median_background(S.pixels(spark, sf), C.spans(times)))
    cov = C.box_coverage(_boxes(spark, sf), m, ["eval_us", "side"])
    road = S.pixels(spark, sf).filter("x > 1").select("video_id", "y", "x").distinct().withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    side = lambda d, s: d.filter(F.col("side") == s).drop("side")
    out = C.change_mask(side(bg, "past"), side(bg, "future"), road, side(cov, "past"), side(cov, "future"), times, None, Obstacle(diff=-8.0))
    return out.withColumns({k: F.col(k).cast("long") for k in ("y", "x")})


BLOBS = "SELECT video_id, cue_idx, t_us, CAST(y AS BIGINT) + 1 AS blob, COUNT(*) AS area, AVG(x) AS cx, AVG(0e0 + y) AS cy FROM {p} WHERE gray > 128 GROUP BY video_id, cue_idx, t_us, y"
define("lb", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, cue_idx ORDER BY area DESC, blob) AS n FROM (" + BLOBS.format(p="s_pixels") + ")) WHERE n = 1", "s_pixels")


def _largest(spark, sf):
    b = spark.sql(BLOBS, p=S.pixels(spark, sf))
    return C.largest_blob(b, ["video_id", "cue_idx"])


@query("largest_blob", f"SELECT video_id, cue_idx, blob, area, {r('cx')} AS cx FROM lb", "lb")
def largest_blob(spark, sf):
    return rd(_largest(spark, sf).select("video_id", "cue_idx", "blob", "area", "cx"), "cx")


FW = "(PARTITION BY video_id ORDER BY t_us RANGE BETWEEN 20000000 PRECEDING AND CURRENT ROW)"
define("ff0", f"""SELECT *, COUNT(*) OVER {FW} AS n, MEDIAN(a) OVER {FW} AS med, GREATEST(STDDEV_POP(cx) OVER {FW}, STDDEV_POP(cy) OVER {FW}) / 8e0 AS drift, STDDEV_POP(a) OVER {FW} / (AVG(a) OVER {FW} + 1e-9) AS cv
FROM (SELECT c.video_id, c.cue_idx, c.t_us, COALESCE(area, 0) / 64e0 AS a, cx, cy FROM cues c LEFT JOIN lb USING (video_id, cue_idx))""", "cues", "lb")


@query("flame_flags", "SELECT video_id, cue_idx FROM ff0 WHERE n >= 4 AND med >= 5e-2 AND drift <= 3e-1 AND cv >= 1e-1", "ff0")
def flame_flags(spark, sf):
    size = S.videos(spark, sf).select("video_id", F.lit(8).alias("width"), F.lit(8).alias("height"))
    return C.flame_flags(_largest(spark, sf), _cues(spark, sf), size, 20.0, 0.05, 0.3, 0.1).select("video_id", "cue_idx")


# blobs by spreading from every pixel to later ones; a blob's first pixel names it
SPREAD = """px AS MATERIALIZED (SELECT video_id, cue_idx, t_us, y, x, y * 8 + x AS k FROM s_pixels WHERE gray > 150),
reach AS (SELECT video_id, cue_idx, k AS root, k, y, x FROM px UNION SELECT p.video_id, p.cue_idx, a.root, p.k, p.y, p.x FROM reach a JOIN px p ON p.video_id = a.video_id AND p.cue_idx = a.cue_idx
AND ABS(p.y - a.y) <= 1 AND ABS(p.x - a.x) <= 1 AND p.k > a.root),
rooted AS MATERIALIZED (SELECT video_id, cue_idx, k, MIN(root) AS root FROM reach GROUP BY ALL),
blobs AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, cue_idx ORDER BY root) AS blob FROM (SELECT video_id, cue_idx, MIN(t_us) AS t_us, root, COUNT(*) AS area,
MIN(x) AS x1, MIN(y) AS y1, MAX(x) AS x2, MAX(y) AS y2, AVG(x) AS cx, AVG(y) AS cy FROM px JOIN rooted USING (video_id, cue_idx, k) GROUP BY video_id, cue_idx, root) z)"""
SQL["label_blobs"] = recursive(SPREAD + f"""
SELECT video_id, cue_idx, CAST(blob AS INT) AS blob, area, x1, y1, x2, y2, {r('cx')} AS cx, {r('cy')} AS cy FROM blobs""", "s_pixels")


@query("label_blobs")
def label_blobs(spark, sf):
    return rd(C.label_blobs(S.pixels(spark, sf).filter("gray > 150").select("video_id", "cue_idx", "y", "x"), ["video_id", "cue_idx"]), "cx", "cy")


# one hit after the other joins the first place near it that is not too old, or opens one
SQL["persistent_objects"] = recursive(SPREAD + """,
hits AS MATERIALIZED (SELECT video_id, t_us, cx, cy, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY t_us, blob) AS n FROM blobs
WHERE area / 64e2 BETWEEN 6e-4 AND 6e-3 AND CAST(area AS DOUBLE) / ((x2 - x1 + 1) * (y2 - y1 + 1)) >= 35e-2 AND GREATEST(x2 - x1, y2 - y1) + 1 <= 4 * (LEAST(x2 - x1, y2 - y1) + 1)),
fold AS (SELECT video_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, a BIGINT, b BIGINT)[]) AS places FROM (SELECT DISTINCT video_id FROM hits) v
UNION ALL SELECT video_id, n, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(places, {'x': cx, 'y': cy, 'a': t_us, 'b': t_us})
ELSE list_concat(places[:pos - 1], [{'x': places[pos].x, 'y': places[pos].y, 'a': places[pos].a, 'b': t_us}], places[pos + 1:]) END
FROM (SELECT h.*, places, list_position(list_transform(places, lambda g: h.t_us - g.b <= 8000000 AND (g.x - h.cx) * (g.x - h.cx) + (g.y - h.cy) * (g.y - h.cy) < 16e-1 * 16e-1), true) AS pos
FROM fold f JOIN hits h ON h.video_id = f.video_id AND h.n = f.n + 1) z)
SELECT video_id, g.a + 4000000 AS start_us, g.b + 4000000 AS end_us FROM (SELECT video_id, UNNEST(places) AS g FROM (SELECT video_id, places, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY n DESC) AS k FROM fold) y WHERE k = 1) x
WHERE g.b - g.a >= 8000000""", "s_pixels")


@query("persistent_objects")
def persistent_objects(spark, sf):
    b = C.label_blobs(S.pixels(spark, sf).filter("gray > 150").select("video_id", F.col("t_us").alias("eval_us"), "y", "x"), ["video_id", "eval_us"])
    size = S.videos(spark, sf).select("video_id", F.lit(80).alias("width"), F.lit(80).alias("height"))
    return C.persistent_objects(b, size, Obstacle(eval_period=4.0))


def _pixel_analysis(spark, sf):
    v = S.videos(spark, sf)
    return Analysis(videos=v, scene=S.scene(spark, sf), samples=S.analysis(spark, sf).samples, frames=T.frame_grid(v, 12.5),
                    pixels=S.pixels(spark, sf), cue_boxes=_boxes(spark, sf), cues=_cues(spark, sf))


@query("road_obstacle")
def road_obstacle(spark, sf):
    return SE.road_obstacle(_pixel_analysis(spark, sf), Obstacle(diff=-8.0, area=(0.0, 1.0), min_fill=0.1, min_persist=1.0))


@query("fire_smoke")
def fire_smoke(spark, sf):
    return SE.fire_smoke(_pixel_analysis(spark, sf), Fire(window=20.0, min_area=0.0, min_cv=0.0, max_drift=9.0))


# ---- tracking and streams ---------------------------------------------------

def _det(spark, sf):
    return S.det(spark, sf).withColumn("det_id", F.col("track_id")).drop("track_id")


@query("track_stream")
def track_stream(spark, sf):
    return track_detections(_det(spark, sf)).groupBy("video_id", "track_id").agg(
        F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("stitch_static")
def stitch(spark, sf):
    pieces = S.tracks(spark, sf).filter("frame_idx % 100 < 60").withColumn("track_id", F.col("track_id") * 10 + F.floor(F.col("frame_idx") / 100))
    return stitch_static(pieces).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


def _timed(df):
    return df.withColumn("event_time", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("t_us")))


@query("live_counts", "SELECT video_id, CAST(FLOOR(t_us / 1e6) AS BIGINT) AS sec, category, COUNT(*) AS n FROM s_tracks GROUP BY 1, 2, 3", "s_tracks")
def live_counts(spark, sf):
    d = _timed(S.tracks(spark, sf)).select("video_id", "category", "t_us", "event_time")
    out = runner.drain(jobs.live_counts(runner.open_stream(spark, runner.stage(d), d)))
    return out.select("video_id", (F.unix_seconds("second") - 1_704_067_200).alias("sec"), "category", "n")


# the stream finds the alarms of the batch operator
@query("live_alarms", f"SELECT video_id, {r('t', 6)} AS t FROM alarms", "alarms")
def live_alarms(spark, sf):
    d = _timed(S.risk(spark, sf).withColumn("t_us", F.round(F.col("t") * 1e6).cast("long"))).select("video_id", "pos", "t_us", "score", "event_time")
    out = runner.drain(jobs.live_alarms(runner.open_stream(spark, runner.stage(d), d)))
    return out.select("video_id", F.round(F.col("start_us") / 1e6, 6).alias("t"))


@query("risk_stream")
def risk_stream(spark, sf):
    d = _timed(_det(spark, sf)).select("video_id", "frame_idx", "t_us", "det_id", "x1", "y1", "x2", "y2", "score", "category", "event_time")
    out = runner.drain(jobs.track_and_risk(runner.open_stream(spark, runner.stage(d), d)))
    return out.filter("track_id is null").select("video_id", "frame_idx", "t_us", "score")



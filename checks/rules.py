"""Event rules on the stand-ins. Clips last 24 s, so rules with longer minimums run with shorter ones here."""
from pyspark.sql import functions as F

from checks import standins as S
from checks.basic import GAPS, MINS, merge_sql, rd, runs_sql
from checks.motion import DEPTH, MAIN, SIGNED, grad, sd, unwrap
from checks.registry import SQL, define, query, r, with_steps
from lanewise.constants import Conflict, IllegalTurn, Stopped, Yield
from lanewise.functions import geometry as G
from lanewise.functions.motion import closest_approach
from lanewise.operators import pairs as P
from lanewise.operators.tracks import KEY
from lanewise.plans import conflicts as C, junction as J, pedestrians as PD, vehicles as V
from lanewise.plans.analysis import Analysis
from lanewise.plans.detect import detect

TK = ["video_id", "track_id"]
SECS = "start_us / 1e6 AS start_sec, end_us / 1e6 AS end_sec"
EV = lambda src, label, end="end_us": f"SELECT video_id, start_us / 1e6 AS start_sec, ({end}) / 1e6 AS end_sec, '{label}' AS label FROM {src}"

# ---- wrong way --------------------------------------------------------------
define("ww0", f"SELECT * FROM veh WHERE NOT at_edge AND speed >= 5e-1 AND vx / (SQRT(vx * vx + vy * vy) + 1e-9) <= -5e-1 AND {sd(0, 0, 1662, 924)} >= 0", "veh")
define("ww1", runs_sql("ww0", TK, 800000, "last_us"), "ww0")
define("ww2", """SELECT w.*, (SELECT MEDIAN(size) FROM smp s WHERE s.video_id = w.video_id AND s.track_id = w.track_id AND s.t_us BETWEEN start_us AND end_us) AS m,
SQRT(POW(b.px - a.px, 2) + POW(b.py - a.py, 2)) AS dist FROM ww1 w JOIN smp a ON a.video_id = w.video_id AND a.track_id = w.track_id AND a.t_us = start_us
JOIN smp b ON b.video_id = w.video_id AND b.track_id = w.track_id AND b.t_us = end_us WHERE end_us - start_us >= 1200000""", "ww1", "smp")


@query("wrong_way", EV("(SELECT * FROM ww2 WHERE dist / m >= 15e-1) z", "wrong_way", "CASE WHEN last_us - end_us <= 1000000 THEN last_us ELSE end_us END"), "ww2")
def wrong_way(spark, sf):
    return V.wrong_way(S.analysis(spark, sf))


@query("extend_to_track_end", "SELECT video_id, track_id, start_us, CASE WHEN last_us - end_us <= 1000000 THEN last_us ELSE end_us END AS end_us FROM ww1", "ww1")
def extend_to_track_end(spark, sf):
    from lanewise.operators.intervals import runs
    from lanewise.plans.common import extend_to_track_end as ext
    segs = runs(V.wrong_way_samples(S.analysis(spark, sf)), KEY, 0.8, carry=("last_us",))
    return segs.withColumn("end_us", ext(1.0)).select("video_id", "track_id", "start_us", "end_us")


# vehicles on circles: the heading is known in closed form, some pause for two or four seconds, some crawl
TURN = """
SELECT CONCAT('v', CAST(s_suppkey % 4 AS VARCHAR(9))) AS video_id, CAST(s_suppkey AS BIGINT) AS track_id, CAST(f AS INT) AS frame_idx, CAST(f * 80000 AS BIGINT) AS t_us,
  'car' AS category, 8e2 + r * COS(a) AS px, 45e1 + r * SIN(a) AS py, a AS theta, ATAN2(COS(a), -SIN(a)) AS heading, 3e-1 + s_suppkey % 4 * 4e-1 AS speed,
  5e1 AS size, 1e2 AS med_size, 1662 AS width, 924 AS height, 775e0 + r * COS(a) AS x1, 4e2 + r * SIN(a) AS y1, 825e0 + r * COS(a) AS x2, 45e1 + r * SIN(a) AS y2
FROM (SELECT s_suppkey, f, 6e1 + s_suppkey % 5 * 3e1 AS r, (s_suppkey % 7) * 73e-1 * PI() / 18e1 * f * 8e-2 AS a FROM {frames}) b
WHERE NOT (f > 100 AND f < 100 + s_suppkey % 3 * 25)
"""
define("s_turn", TURN.format(frames="(SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, f FROM supplier, range(0, 300) r(f)) z"))
define("ut1", """SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n, t_us - LAG(t_us) OVER w AS gap, theta - LAG(theta) OVER w AS dth,
SQRT(POWER(px - LAG(px) OVER w, 2) + POWER(py - LAG(py) OVER w, 2)) AS hop FROM s_turn WHERE speed >= 5e-1 WINDOW w AS (PARTITION BY track_id ORDER BY t_us)""", "s_turn")
define("ut2", """SELECT j.video_id, j.track_id, j.t_us AS e, ARG_MIN(a.t_us, (-ABS(a.theta - j.theta), a.t_us)) AS s, MAX(ABS(a.theta - j.theta)) AS swing FROM ut1 j JOIN ut1 a USING (track_id)
WHERE a.t_us BETWEEN j.t_us - 20000000 AND j.t_us AND j.n >= 10 GROUP BY 1, 2, 3""", "ut1")
define("ut3", """SELECT c.video_id, c.track_id, c.s, c.e, MAX(CASE WHEN k.t_us > c.s THEN k.gap END) AS gap, SUM(CASE WHEN k.t_us > c.s THEN k.hop ELSE 0 END) AS path,
MAX(SQRT(POWER(k.px - a.px, 2) + POWER(k.py - a.py, 2))) AS away FROM ut2 c JOIN ut1 a ON a.track_id = c.track_id AND a.t_us = c.s JOIN ut1 k ON k.track_id = c.track_id AND k.t_us BETWEEN c.s AND c.e
WHERE c.swing >= 15e1 * PI() / 18e1 GROUP BY 1, 2, 3, 4""", "ut1", "ut2")
define("ut4", "SELECT video_id, track_id, ARG_MIN(s, e) AS s, MIN(e) AS e FROM ut3 WHERE (gap IS NULL OR gap <= 3000000) AND path / 5e1 >= 25e-1 AND away / 5e1 >= 1e0 GROUP BY 1, 2", "ut3")
define("ut5", """SELECT f.video_id, f.track_id, f.s, f.e, COALESCE(MIN(CASE WHEN k.t_us > f.e AND ABS(k.dth) <= 1e1 * PI() / 18e1 * k.gap / 1e6 THEN k.t_us END), 9000000000) AS stop,
MIN(CASE WHEN k.t_us <= f.e AND ABS(k.theta - a.theta) > 15e0 * PI() / 18e1 THEN k.t_us END) AS first FROM ut4 f JOIN ut1 a ON a.track_id = f.track_id AND a.t_us = f.s
JOIN ut1 k ON k.track_id = f.track_id AND k.t_us >= f.s GROUP BY 1, 2, 3, 4""", "ut1", "ut4")
define("ut6", "SELECT f.video_id, f.track_id, f.first, MAX(k.t_us) AS last FROM ut5 f JOIN ut1 k ON k.track_id = f.track_id AND k.t_us >= f.e AND k.t_us < f.stop GROUP BY 1, 2, 3", "ut1", "ut5")


@query("illegal_u_turn", f"""SELECT f.video_id, {r('f.first / 1e6')} AS start_sec,
{r('GREATEST(MIN(CASE WHEN k.t_us <= f.last AND ABS(k.theta - z.theta) < 2e1 * PI() / 18e1 THEN k.t_us END), COALESCE(MIN(CASE WHEN k.t_us > f.first THEN k.t_us END), 0)) / 1e6')} AS end_sec, 'illegal_u_turn' AS label
FROM ut6 f JOIN ut1 z ON z.track_id = f.track_id AND z.t_us = f.last JOIN ut1 k ON k.track_id = f.track_id AND k.t_us >= f.first GROUP BY f.video_id, f.track_id, f.first""", "ut1", "ut6")
def illegal_u_turn(spark, sf):
    turns = spark.sql(TURN.format(frames="{sup}"), sup=S.each_frame(spark, sf))
    found = V.illegal_u_turn(Analysis(videos=None, scene=None, samples=turns, frames=None))
    return found.withColumns({c: F.round(c, 4) for c in ("start_sec", "end_sec")})


# ---- stopped vehicle --------------------------------------------------------
define("st0", "SELECT * FROM cars WHERE category <> 'bus' AND last_us - first_us >= 2000000 AND med_size >= 12e-3 * 1662 AND speed < 12e-2", "cars")
define("st1", runs_sql("st0", TK, 1500000, "last_us, med_size"), "st0")
define("st2", """SELECT q.video_id, q.track_id, start_us, end_us, q.last_us, q.med_size, ARG_MIN(px, t_us) AS sx, ARG_MIN(py, t_us) AS sy, 12e0 * MEDIAN(size) AS radius
FROM st1 q JOIN smp s ON s.video_id = q.video_id AND s.track_id = q.track_id AND s.t_us BETWEEN start_us AND end_us WHERE end_us - start_us >= 2000000
GROUP BY ALL HAVING AVG(CASE WHEN zone IN ('intersection', 'side_road') THEN 1e0 ELSE 0e0 END) >= 3e-1""", "st1", "smp")
define("st3", """SELECT *, CASE WHEN n >= 3 THEN bx / (SQRT(bx * bx + by_ * by_) + 1e-9) ELSE fx / NULLIF(SQRT(fx * fx + fy * fy), 0) END AS dx,
CASE WHEN n >= 3 THEN by_ / (SQRT(bx * bx + by_ * by_) + 1e-9) ELSE fy / NULLIF(SQRT(fx * fx + fy * fy), 0) END AS dy FROM (
SELECT q.*, b.n, b.bx, b.by_, o.fx, o.fy FROM st2 q,
LATERAL (SELECT COUNT(*) AS n, AVG(vx) AS bx, AVG(vy) AS by_ FROM smp s WHERE s.video_id = q.video_id AND s.track_id = q.track_id AND s.t_us >= start_us - 3000000 AND s.t_us < start_us AND speed > 5e-1) b,
LATERAL (SELECT SUM(vx / (SQRT(vx * vx + vy * vy) + 1e-9)) AS fx, SUM(vy / (SQRT(vx * vx + vy * vy) + 1e-9)) AS fy FROM smp s WHERE s.video_id = q.video_id AND s.track_id <> q.track_id
AND category IN ('car', 'bus', 'truck') AND s.t_us BETWEEN start_us AND end_us AND speed > 1e0 AND SQRT(POW(px - sx, 2) + POW(py - sy, 2)) < radius) o)""", "st2", "smp")
SHORT = Stopped(min_duration=2.0, min_size=0.012, zone_share=0.3, radius=12.0, min_overtakes=1)


@query("travel_direction", f"SELECT video_id, track_id, start_us, end_us, {r('dx', 5)} AS dx, {r('dy', 5)} AS dy FROM st3 WHERE dx IS NOT NULL", "st3")
def travel_direction(spark, sf):
    an = S.analysis(spark, sf)
    d = V.travel_direction(V.stop_candidates(an, SHORT), an)
    return rd(d.select("video_id", "track_id", "start_us", "end_us", "dx", "dy"), "dx", "dy", n=5)


define("st4", """SELECT q.video_id, q.track_id, start_us, end_us, q.last_us, med_size, s.track_id AS other, MIN((px - sx) * dx + (py - sy) * dy) AS lo, MAX((px - sx) * dx + (py - sy) * dy) AS hi
FROM st3 q JOIN (SELECT video_id, track_id, t_us, px, py, vx, vy, speed, category FROM smp) s ON s.video_id = q.video_id AND s.track_id <> q.track_id AND s.t_us BETWEEN start_us AND end_us
WHERE category IN ('car', 'bus', 'truck', 'bicycle', 'motorcycle') AND speed > 8e-1 AND ABS(-(px - sx) * dy + (py - sy) * dx) < radius AND (vx * dx + vy * dy) / (SQRT(vx * vx + vy * vy) + 1e-9) > 7e-1 GROUP BY ALL""", "st3", "smp")


@query("overtakers", "SELECT video_id, track_id, start_us, COUNT(*) AS n_over FROM st4 WHERE lo < -5e-1 * med_size AND hi > 5e-1 * med_size GROUP BY ALL", "st4")
def overtakers(spark, sf):
    an = S.analysis(spark, sf)
    o = V.overtakers(V.travel_direction(V.stop_candidates(an, SHORT), an), an)
    return o.select("video_id", "track_id", "start_us", "n_over")


@query("stopped_vehicle", EV("(SELECT video_id, track_id, start_us, end_us, last_us, COUNT(*) AS n FROM st4 WHERE lo < -5e-1 * med_size AND hi > 5e-1 * med_size GROUP BY ALL HAVING COUNT(*) >= 1) z",
                             "stopped_vehicle", "CASE WHEN last_us - end_us <= 2000000 THEN last_us ELSE end_us END"), "st4")
def stopped_vehicle(spark, sf):
    return V.stopped_vehicle(S.analysis(spark, sf), SHORT)


# ---- lines and turns --------------------------------------------------------
define("sl0", f"SELECT *, {SIGNED} AS signed, x2 - x1 AS bw FROM veh", "veh")
define("sl1", "SELECT *, CASE WHEN signed <= -3e-1 * bw THEN -1 WHEN signed >= 3e-1 * bw THEN 1 END AS side FROM sl0 WHERE signed IS NOT NULL", "sl0")
define("sl2", """SELECT * FROM (SELECT video_id, track_id, t_us AS e, speed, side, LAG(side) OVER w AS p_side, LAG(t_us) OVER w AS s FROM sl1 WHERE side IS NOT NULL WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t_us))
WHERE side <> p_side AND e - s <= 4000000 AND speed > 3e-1""", "sl1")
define("sl3", """SELECT f.video_id, f.track_id, COALESCE(MIN(t_us), s) AS start_us, COALESCE(MAX(t_us), e) AS end_us FROM sl2 f LEFT JOIN sl0 q ON q.video_id = f.video_id AND q.track_id = f.track_id
AND t_us BETWEEN s AND e AND ABS(signed) <= 5e-1 * bw GROUP BY f.video_id, f.track_id, s, e""", "sl2", "sl0")


@query("solid_line_crossing", EV("sl3", "solid_line_crossing") + " WHERE end_us > start_us", "sl3")
def solid_line_crossing(spark, sf):
    return V.solid_line_crossing(S.analysis(spark, sf))


define("it0", "SELECT video_id, track_id FROM veh WHERE zone IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 2 AND ARG_MIN(zone, t_us) = 'upper' AND ARG_MAX(zone, t_us) = 'intersection'", "veh")
define("it1", unwrap("heading", "(SELECT * FROM veh SEMI JOIN it0 USING (video_id, track_id)) v0", "video_id, track_id"), "veh", "it0")
define("it2", f"SELECT *, ABS({grad('theta')}) AS rate, t_us - LAG(t_us) OVER (PARTITION BY video_id, track_id ORDER BY t_us) AS h_dt FROM it1", "it1")
define("it3", "SELECT video_id, track_id, MEDIAN(h_dt) AS h_step FROM it2 GROUP BY 1, 2 HAVING COUNT(*) >= 5", "it2")
define("it4", "SELECT * FROM it2 JOIN it3 USING (video_id, track_id) WHERE rate > RADIANS(-1e0)", "it2", "it3")
define("it5", runs_sql("it4", TK, 1000000, step="h_step"), "it4")


@query("illegal_turn", EV("(SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY end_us - start_us DESC, start_us) AS n FROM it5) z", "illegal_turn") + " WHERE n = 1", "it5")
def illegal_turn(spark, sf):
    return V.illegal_turn(S.analysis(spark, sf), IllegalTurn(rate=-1.0, net=-1.0))


@query("longest_run", "SELECT video_id, track_id, start_us, end_us FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, track_id ORDER BY end_us - start_us DESC, start_us) AS n FROM ww1) WHERE n = 1", "ww1")
def longest_run(spark, sf):
    from lanewise.operators.intervals import runs
    segs = runs(V.wrong_way_samples(S.analysis(spark, sf)), KEY, 0.8)
    return V.longest_run(segs).select("video_id", "track_id", "start_us", "end_us")


# ---- pedestrians ------------------------------------------------------------
define("jw0", f"SELECT * FROM peds WHERE {DEPTH} >= 25e-2 * (y2 - y1) AND {sd(*MAIN)} < -35e-2 * (y2 - y1)", "peds")
define("jw1", runs_sql("jw0", TK, 800000), "jw0")
define("jw2", """SELECT j.video_id, j.track_id, start_us, end_us, MEDIAN(speed) AS v FROM jw1 j JOIN smp s ON s.video_id = j.video_id AND s.track_id = j.track_id AND t_us BETWEEN start_us AND end_us
WHERE end_us - start_us >= 1000000 GROUP BY ALL""", "jw1", "smp")


@query("jaywalking", EV("jw2", "jaywalking") + " WHERE v BETWEEN 4e-1 AND 16e-1", "jw2")
def jaywalking(spark, sf):
    return PD.jaywalking(S.analysis(spark, sf))


NX, NY = "5e-1 * size * vx / (SQRT(vx * vx + vy * vy) + 1e-9)", "5e-1 * size * vy / (SQRT(vx * vx + vy * vy) + 1e-9)"
define("fy0", f"""SELECT * FROM veh WHERE {sd(*MAIN)} >= 0 OR {sd(*MAIN, x=f'(px + {NX})', y=f'(py + {NY})')} >= 0 OR {sd(*MAIN, x=f'(px - {NX})', y=f'(py - {NY})')} >= 0""", "veh")
define("fy1", runs_sql("fy0", TK, 500000), "fy0")
define("fy2", """SELECT f.video_id, f.track_id, start_us, end_us, MEDIAN(speed) AS v, MEDIAN(size) AS m FROM fy1 f JOIN smp s ON s.video_id = f.video_id AND s.track_id = f.track_id AND t_us BETWEEN start_us AND end_us
GROUP BY ALL HAVING MEDIAN(speed) >= 3e-1""", "fy1", "smp")
define("fy3", f"""SELECT DISTINCT f.video_id, f.track_id, start_us, end_us FROM fy2 f JOIN smp s ON s.video_id = f.video_id AND s.track_id = f.track_id AND s.t_us BETWEEN start_us AND end_us
JOIN (SELECT video_id, frame_idx, track_id AS ped, px AS qx, py AS qy FROM peds WHERE speed >= 1e-1 AND {sd(*MAIN)} >= -35e-2 * (y2 - y1)) p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx
WHERE SQRT(POW(px - qx, 2) + POW(py - qy, 2)) < 8e0 * m GROUP BY f.video_id, f.track_id, start_us, end_us, ped HAVING COUNT(*) >= 2""", "fy2", "smp", "peds")
CREEP = Yield(min_speed=0.3, ped_speed=0.1, reach=8.0)


@query("pedestrian_near", "SELECT video_id, track_id, start_us, end_us FROM fy3", "fy3")
def pedestrian_near(spark, sf):
    an = S.analysis(spark, sf)
    return PD.pedestrian_near(PD.crosswalk_passages(an, CREEP), an, CREEP).select("video_id", "track_id", "start_us", "end_us")


@query("failure_to_yield", EV("fy3", "failure_to_yield"), "fy3")
def failure_to_yield(spark, sf):
    return PD.failure_to_yield(S.analysis(spark, sf), CREEP)


# ---- junction ---------------------------------------------------------------
define("rl0", """SELECT *, LAG(prog) OVER w AS prev, MIN(prog) OVER (PARTITION BY video_id, track_id ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back
FROM app WHERE approach = 'east' WINDOW w AS (PARTITION BY video_id, track_id ORDER BY t_us)""", "app")
define("rl1", """SELECT video_id, track_id, head, MIN(t_us) AS t_us, ANY_VALUE(last_us) AS last_us FROM rl0 WHERE prev < 0 AND prog >= 0 AND in_span AND vx / (SQRT(vx * vx + vy * vy) + 1e-9) > 5e-1
AND speed >= 5e-1 AND back <= -5e-1 * size GROUP BY 1, 2, 3""", "rl0")
define("readable", "SELECT video_id, head FROM tl GROUP BY 1, 2 HAVING AVG(CASE WHEN code <> 0 THEN 1e0 ELSE 0e0 END) > 5e-1", "tl")
define("rl2", """SELECT c.video_id, c.track_id, c.t_us AS start_us, COALESCE((SELECT MIN(s.t_us) FROM smp s WHERE s.video_id = c.video_id AND s.track_id = c.track_id AND s.t_us > c.t_us
AND (zone IS NULL OR zone NOT IN ('junction_box', 'intersection', 'crosswalk_main', 'crosswalk_side'))), c.last_us) AS end_us FROM rl1 c SEMI JOIN readable USING (video_id, head)
WHERE (SELECT BOOL_AND(code = 1) FROM tl WHERE tl.video_id = c.video_id AND tl.head = c.head AND tl.t_us BETWEEN c.t_us - 1000000 AND c.t_us)""", "rl1", "readable", "smp", "tl")


@query("red_light", EV("rl2", "red_light"), "rl2")
def red_light(spark, sf):
    return J.red_light(S.analysis(spark, sf))


define("hold", """SELECT video_id, frame_idx, track_id FROM app WHERE approach = 'north' AND category IN ('car', 'bus', 'truck') AND prog / size > -3e0 AND prog / size < 3e-1 AND speed < 15e-2 AND in_span""", "app")
define("sp0", f"""SELECT * FROM app WHERE category IN ('car', 'bus', 'truck') AND prog / size > 1e-1 AND speed < 12e-2 AND CASE approach WHEN 'east' THEN {sd(850, 0, 1250, 924)} ELSE {sd(100, 200, 1500, 500)} END >= 0""", "app")
define("sp1", "SELECT * FROM (" + runs_sql("sp0", ["video_id", "track_id", "approach"], 1000000, "head") + ") z WHERE end_us - start_us >= 2000000", "sp0")
# a frame counts from the start up to the first one at or after the end
define("qh", """SELECT s.video_id, s.track_id, s.approach, start_us, end_us, AVG(CASE WHEN EXISTS (SELECT 1 FROM hold h WHERE h.video_id = s.video_id AND h.frame_idx = f.frame_idx AND h.track_id <> s.track_id) THEN 1e0 ELSE 0e0 END) AS share
FROM sp1 s JOIN frames f ON f.video_id = s.video_id AND f.t_us >= start_us AND (f.t_us - 80000 < end_us) WHERE s.approach = 'north' GROUP BY ALL""", "sp1", "hold", "frames")
define("hf", """SELECT s.video_id, s.track_id, s.approach, start_us, end_us, AVG(CASE WHEN code = 1 THEN 1e0 ELSE 0e0 END) AS share FROM sp1 s SEMI JOIN readable USING (video_id, head)
JOIN tl ON tl.video_id = s.video_id AND tl.head = s.head AND tl.t_us >= start_us AND COALESCE(prev_us, -1) < end_us GROUP BY ALL""", "sp1", "readable", "tl")


@query("queue_holding", f"SELECT video_id, track_id, start_us, end_us, {r('share', 6)} AS share FROM qh", "qh")
def queue_holding(spark, sf):
    an = S.analysis(spark, sf)
    q = J.queue_holding(J.stops_past_line(an).filter("head is null").select(*J.APP, "start_us", "end_us"), an)
    return rd(q.select("video_id", "track_id", "start_us", "end_us", "share"), "share", n=6)


@query("stop_line", EV("(SELECT * FROM qh UNION ALL SELECT * FROM hf) z", "stop_line") + " WHERE share >= 5e-1", "qh", "hf")
def stop_line(spark, sf):
    return J.stop_line(S.analysis(spark, sf))


JAM = {"towards_camera": (("intersection",), 4, 0.3, 0.4, 3.0), "away": (("upper",), 2, 0.3, 0.4, 3.0)}
define("cg0", """SELECT f.video_id, d.zone, d.mn, f.frame_idx, f.t_us, COUNT(c.track_id) AS total, COUNT(*) FILTER (c.speed < 3e-1) AS slow FROM frames f CROSS JOIN (VALUES ('intersection', 4), ('upper', 2)) d(zone, mn)
LEFT JOIN cars c ON c.video_id = f.video_id AND c.frame_idx = f.frame_idx AND c.zone = d.zone GROUP BY ALL""", "frames", "cars")
define("cg1", """SELECT *, SUM(total) OVER w / 25e0 AS tot, SUM(slow) OVER w / 25e0 AS slo, 80000e0 AS step_us FROM cg0 WINDOW w AS (PARTITION BY video_id, zone ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""", "cg0")
define("cg2", "SELECT * FROM cg1 WHERE tot >= mn AND slo >= 4e-1 * GREATEST(tot, 1e-6)", "cg1")
define("cg3", runs_sql("cg2", ["video_id", "zone"], 5000000), "cg2")


@query("congestion", EV("cg3", "congestion") + " WHERE end_us - start_us >= 3000000", "cg3")
def congestion(spark, sf):
    return J.congestion(S.analysis(spark, sf), JAM)


# ---- pairs ------------------------------------------------------------------
define("users", "SELECT *, FALSE AS person FROM veh WHERE med_size >= 45e-3 * 1662 UNION ALL SELECT *, TRUE FROM peds WHERE med_size >= 45e-3 * 1662", "veh", "peds")
define("pairs", """SELECT DISTINCT a.video_id, a.track_id AS a_id, b.track_id AS b_id FROM users a JOIN users b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx
AND (a.person < b.person OR (a.person = b.person AND a.track_id < b.track_id)) AND NOT (a.person AND b.person)
WHERE SQRT(POW(a.px - b.px, 2) + POW(a.py - b.py, 2)) < 2e0 * 5e-1 * (a.size + b.size)""", "users")
COLS = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("px", "py", "vx", "vy", "size", "speed", "heading", "last_us", "v_before", "v_after"))
INTER = "GREATEST(0, LEAST(a.x2, b.x2) - GREATEST(a.x1, b.x1)) * GREATEST(0, LEAST(a.y2, b.y2) - GREATEST(a.y1, b.y1))"
define("ud", "SELECT * FROM users JOIN drops USING (video_id, track_id, t_us)", "users", "drops")
define("ps0", f"""SELECT *, COUNT(*) OVER (PARTITION BY video_id, a_id, b_id) AS n_common FROM (SELECT p.*, a.frame_idx, a.t_us, {COLS}, NOT a.at_edge AND NOT b.at_edge AS ok,
SQRT(POW(a.px - b.px, 2) + POW(a.py - b.py, 2)) / (5e-1 * (a.size + b.size)) AS raw,
{INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER} + 1e-9) AS iou
FROM pairs p JOIN ud a ON a.video_id = p.video_id AND a.track_id = p.a_id JOIN ud b ON b.video_id = p.video_id AND b.track_id = p.b_id AND b.frame_idx = a.frame_idx)""", "pairs", "ud")
W3 = "EXP(-5e-1 * POW((b.t_us - a.t_us) / 15e4, 2))"
define("ps1", f"""SELECT a.video_id, a.a_id, a.b_id, a.t_us, SUM({W3} * b.raw) / SUM({W3}) AS dist FROM ps0 a JOIN ps0 b ON a.video_id = b.video_id AND a.a_id = b.a_id AND a.b_id = b.b_id
AND b.t_us BETWEEN a.t_us - 450000 AND a.t_us + 450000 GROUP BY 1, 2, 3, 4""", "ps0")
PBY = "PARTITION BY video_id, a_id, b_id ORDER BY t_us"
define("ps", f"SELECT *, -({grad('dist', PBY)}) AS closing, t_us - LAG(t_us) OVER ({PBY}) AS dt_us FROM ps0 JOIN ps1 USING (video_id, a_id, b_id, t_us) WHERE n_common >= 4", "ps0", "ps1")


@query("candidate_pairs", "SELECT * FROM pairs", "pairs")
def candidate_pairs(spark, sf):
    return P.candidate_pairs(P.conflict_users(S.analysis(spark, sf).samples))


@query("pair_series", f"SELECT video_id, a_id, b_id, t_us, {r('dist', 4)} AS dist, {r('closing', 3)} AS closing, {r('iou', 4)} AS iou, ok FROM ps", "ps")
def pair_series(spark, sf):
    s = C.conflict_series(S.analysis(spark, sf), cols=[])
    return rd(rd(s.select("video_id", "a_id", "b_id", "t_us", "dist", "closing", "iou", "ok"), "dist", "iou"), "closing", n=3)


@query("box_iou", f"SELECT video_id, a_id, b_id, {r('MAX(iou)', 5)} AS iou FROM ps0 GROUP BY 1, 2, 3", "ps0")
def box_iou(spark, sf):
    users = P.conflict_users(S.analysis(spark, sf).samples)
    return rd(P.pair_ious(users), "iou", n=5)


RX, RY, UX, UY = (f"((b_{c} - a_{c}) / LEAST(a_size, b_size))" for c in ("px", "py", "vx", "vy"))
CPA = f"SELECT *, SQRT({UX} * {UX} + {UY} * {UY}) AS v_rel, -({RX} * {UX} + {RY} * {UY}) / NULLIF({UX} * {UX} + {UY} * {UY}, 0) AS t0, {RX} AS rx, {RY} AS ry, {UX} AS ux, {UY} AS uy FROM ps"
define("cpa", f"SELECT *, CASE WHEN v_rel >= 2e-1 AND t0 > 0 AND t0 <= 2e0 THEN t0 END AS t_cpa, CASE WHEN v_rel >= 2e-1 AND t0 > 0 AND t0 <= 2e0 THEN SQRT(POW(rx + ux * t0, 2) + POW(ry + uy * t0, 2)) END AS d_cpa FROM ({CPA}) z", "ps")


# positions are sums in no fixed order: what lies within 1e-9 of a limit lies on it, and results have 9 digits before they are rounded to 3
OK9 = "v_rel >= 2e-1 - 1e-9 AND t0 > 1e-9 AND t0 <= 2e0 + 1e-9"
define("cpa9", f"SELECT *, CASE WHEN {OK9} THEN t0 END AS t_cpa, CASE WHEN {OK9} THEN SQRT(POW(rx + ux * t0, 2) + POW(ry + uy * t0, 2)) END AS d_cpa FROM ({CPA}) z", "ps")
R9 = lambda x: f"(CAST(ROUND(CAST({x} AS DECIMAL(18, 9)), 3) AS DOUBLE) + 0e0)"


@query("closest_approach", f"SELECT video_id, a_id, b_id, t_us, {R9('t_cpa')} AS t_cpa, {R9('d_cpa')} AS d_cpa FROM cpa9", "cpa9")
def closest_approach_q(spark, sf):
    s = C.conflict_series(S.analysis(spark, sf), cols=["px", "py", "vx", "vy", "size"])
    d = lambda c: (F.col("b_" + c) - F.col("a_" + c)) / F.least("a_size", "b_size")
    c = closest_approach(d("px"), d("py"), d("vx"), d("vy"), 2.0)
    out = s.select("video_id", "a_id", "b_id", "t_us", c.alias("c")).select("video_id", "a_id", "b_id", "t_us", "c.t_cpa", "c.d_cpa")
    return rd(rd(out, "t_cpa", "d_cpa", n=9), "t_cpa", "d_cpa", n=3)


# parked neighbours instead of crashes: what the stand-in has to offer
SOFT = Conflict(contact_dist=1.5, contact_iou=-1.0, approach_dist=1.0, pre_speed=0.3, pre_closing=-9.0, deflect=-1.0, rest=1.0, stop_speed=0.8, rest_dist=4.0,
                ttc=9.0, min_closing=0.05, max_gap=9.0, cpa=9.0, nm_keep=1.05, nm_speed=0.3)
for u in "ab":
    define(f"th_{u}", f"SELECT video_id, a_id, b_id, t_us, theta AS th_{u} FROM (" + unwrap(f"{u}_heading", "ps", "video_id, a_id, b_id") + ") z", "ps")


def rg(lo, hi):
    f = lambda v: f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING" if v else "CURRENT ROW"
    return f"({PBY} RANGE BETWEEN {f(lo)} AND {f(hi)})"


REST = "a_speed < 8e-1 AND b_speed < 8e-1 AND dist < 4e0"
define("ac0", f"""SELECT *, MAX(dist) OVER {rg(-3000000, 0)} AS far, GREATEST(MAX(a_speed) OVER {rg(-1500000, 0)}, MAX(b_speed) OVER {rg(-1500000, 0)}) AS fast, MAX(closing) OVER {rg(-1500000, 0)} AS closing_in,
GREATEST(CASE WHEN COUNT(th_a) OVER {rg(-500000, 1500000)} >= 2 THEN MAX(th_a) OVER {rg(-500000, 1500000)} - MIN(th_a) OVER {rg(-500000, 1500000)} ELSE 0 END,
CASE WHEN COUNT(th_b) OVER {rg(-500000, 1500000)} >= 2 THEN MAX(th_b) OVER {rg(-500000, 1500000)} - MIN(th_b) OVER {rg(-500000, 1500000)} ELSE 0 END) AS swing,
COUNT(*) FILTER ({REST}) OVER {rg(0, 3000000)} AS n_rest, MIN(CASE WHEN {REST} THEN t_us END) OVER {rg(0, 3000000)} AS rest_us, MEDIAN(dt_us) OVER (PARTITION BY video_id, a_id, b_id) AS step
FROM ps LEFT JOIN th_a USING (video_id, a_id, b_id, t_us) LEFT JOIN th_b USING (video_id, a_id, b_id, t_us)""", "ps", "th_a", "th_b")
define("ac1", """SELECT video_id, a_id, b_id, MIN(t_us) AS start_us, ARG_MIN(rest_us, t_us) AS rest_us FROM ac0 WHERE dist < 15e-1 AND iou > -1 AND ok AND far >= 1e0 AND fast >= 3e-1 AND closing_in >= -9
AND ((a_v_before >= 3e-1 AND a_v_after <= 2e-1 * a_v_before) OR (b_v_before >= 3e-1 AND b_v_after <= 2e-1 * b_v_before) OR swing >= RADIANS(-1e0)) AND n_rest * step >= 1e6 GROUP BY 1, 2, 3""", "ac0")


@query("accident", EV("ac1", "accident", "LEAST(GREATEST(rest_us, start_us + 500000), start_us + 10000000)"), "ac1")
def accident(spark, sf):
    return C.accident(S.analysis(spark, sf), p=SOFT)


for u in "ab":
    define(f"rt0_{u}", f"SELECT *, COALESCE({u}_heading, AVG({u}_heading) OVER (PARTITION BY video_id, a_id, b_id), 0e0) AS hf FROM ps", "ps")
    define(f"rt_{u}", f"SELECT video_id, a_id, b_id, t_us, ABS({grad('theta', PBY)}) AS {u}_rate FROM (" + unwrap("hf", f"rt0_{u}", "video_id, a_id, b_id") + ") z", f"rt0_{u}")
define("nm0", f"""SELECT *, MAX(dist) OVER {rg(-3000000, 0)} AS far, MIN(dist) OVER {rg(0, 2000000)} AS low, closing > 5e-2 AND GREATEST(dist - 15e-1, 5e-2) / GREATEST(closing, 1e-6) < 9e0 AND ok AND COALESCE(d_cpa <= 9e0, FALSE) AS danger
FROM cpa JOIN rt_a USING (video_id, a_id, b_id, t_us) JOIN rt_b USING (video_id, a_id, b_id, t_us) ANTI JOIN ac1 USING (video_id, a_id, b_id)""", "cpa", "rt_a", "rt_b", "ac1")
define("nm1", """SELECT video_id, a_id, b_id, MIN(t_us) AS k_us, ARG_MIN(far, t_us) AS far, ARG_MIN(low, t_us) AS low FROM nm0 WHERE danger GROUP BY 1, 2, 3""", "nm0")
define("nm2", """SELECT k.*, (SELECT MIN(t_us) FROM nm0 s WHERE s.video_id = k.video_id AND s.a_id = k.a_id AND s.b_id = k.b_id AND s.t_us BETWEEN k_us AND k_us + 2000000 AND s.dist = k.low) AS min_us
FROM nm1 k WHERE far >= 1e0 AND low >= 15e-1 AND low <= 9e0""", "nm1", "nm0")
EVADE = " OR ".join(f"({u}_v_before >= 3e-1 AND {u}_v_after <= 105e-2 * {u}_v_before) OR ({u}_rate >= RADIANS(60e0) AND {u}_speed >= 3e-1)" for u in "ab")
define("nm3", f"""SELECT k.video_id, k.a_id, k.b_id, min_us, MIN(t_us) FILTER (({EVADE}) AND t_us BETWEEN k_us - 1000000 AND min_us + 500000) AS start_us,
MIN(t_us) FILTER (t_us > min_us AND dist > 25e-1) AS clear, MIN(a_last_us) AS ae, MIN(b_last_us) AS be FROM nm2 k JOIN nm0 s ON s.video_id = k.video_id AND s.a_id = k.a_id AND s.b_id = k.b_id GROUP BY 1, 2, 3, 4""", "nm2", "nm0")


@query("near_miss", EV("nm3", "near_miss", "LEAST(COALESCE(clear, LEAST(ae, be, min_us + 2000000)), start_us + 6000000)") + " WHERE start_us IS NOT NULL", "nm3")
def near_miss(spark, sf):
    return C.near_miss(S.analysis(spark, sf), p=SOFT)


@query("detect")
def detect_all(spark, sf):
    return detect(S.analysis(spark, sf))


# the rules that are checked one by one with their own limits, cleaned together
TOGETHER = ["wrong_way", "solid_line_crossing", "jaywalking", "red_light", "stop_line"]


@query("detect_cleaned")
def detect_cleaned(spark, sf):
    return detect(S.analysis(spark, sf), TOGETHER)


SQL["detect_cleaned"] = f"""WITH found AS MATERIALIZED ({' UNION ALL '.join(f'SELECT video_id, start_sec, end_sec, label FROM ({SQL[q]})' for q in TOGETHER)}),
lengths AS MATERIALIZED (SELECT video_id, duration FROM ({with_steps('SELECT * FROM s_videos', 's_videos')}))
SELECT video_id, label, {r('s', 2)} AS start_sec, {r('e', 2)} AS end_sec FROM (
SELECT video_id, label, GREATEST(0e0, start_sec) AS s, LEAST(duration, end_sec) AS e FROM ({merge_sql('found', ['video_id', 'label'], GAPS)}) z JOIN lengths USING (video_id)) y
WHERE e - s >= {MINS}"""

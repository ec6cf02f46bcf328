"""Kinematics, geometry, signals and time series."""
from pyspark.sql import functions as F

from checks import standins as S
from checks.basic import rd
from checks.registry import define, query, r
from lanewise.functions import geometry as G, motion as M
from lanewise.operators import signals as SG, timeseries as ts, tracks as T
from lanewise.operators.pairs import unwrap_heading
from lanewise.plans import junction as J
from lanewise.sources.layout import accept_transform, layout_from_text, load_scene

K = "video_id, track_id"
BY = "PARTITION BY video_id, track_id ORDER BY t_us"


def gauss(cols: dict, sigma: float, src: str, keep: str, keys=("video_id", "track_id")) -> str:
    """Weighted mean over +-3 sigma by a self join."""
    w = f"EXP(-5e-1 * ((b.t_us - a.t_us) / (1e6 * {sigma}e0)) * ((b.t_us - a.t_us) / (1e6 * {sigma}e0)))"
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    out = ", ".join(f"SUM({w} * b.{c}) / SUM({w}) AS {n}" for n, c in cols.items())
    grp = ", ".join(f"a.{c}" for c in keep.split(", "))
    return f"SELECT {grp}, {out} FROM {src} a JOIN {src} b ON {on} AND b.t_us BETWEEN a.t_us - {int(3e6 * sigma)} AND a.t_us + {int(3e6 * sigma)} GROUP BY {grp}"


def deriv(x: str, half: int, by=BY) -> str:
    w = f"({by} RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    lo_t, hi_t = f"FIRST_VALUE(t_us) OVER {w}", f"LAST_VALUE(t_us) OVER {w}"
    pick = lambda v, end, side, fn: f"CASE WHEN {end} = t_us THEN COALESCE({fn}({v}) OVER ({by}), {v}) ELSE {side}({v}) OVER {w} END"
    x0, x1 = pick(x, lo_t, "FIRST_VALUE", "LAG"), pick(x, hi_t, "LAST_VALUE", "LEAD")
    t0, t1 = pick("t_us", lo_t, "FIRST_VALUE", "LAG"), pick("t_us", hi_t, "LAST_VALUE", "LEAD")
    return f"COALESCE((({x1}) - ({x0})) / NULLIF((({t1}) - ({t0})) / 1e6, 0), 0e0)"


def sd(x0, y0, x1, y1, x="px", y="py") -> str:
    """Signed distance to a rectangle."""
    x0, y0, x1, y1 = (f"{v}e0" for v in (x0, y0, x1, y1))
    return (f"(CASE WHEN {x} BETWEEN {x0} AND {x1} AND {y} BETWEEN {y0} AND {y1} THEN LEAST({x} - {x0}, {x1} - {x}, {y} - {y0}, {y1} - {y}) "
            f"ELSE -SQRT(POW(GREATEST({x0} - {x}, 0, {x} - {x1}), 2) + POW(GREATEST({y0} - {y}, 0, {y} - {y1}), 2)) END)")


UPPER, CROSS, ISLE, INTER, MAIN = (0, 0, 1662, 300), (0, 0, 1662, 924), (600, 300, 800, 400), (0, 300, 1662, 924), (900, 0, 1000, 924)
ZONE = f"CASE WHEN {sd(*ISLE)} >= 0 THEN NULL WHEN {sd(*UPPER)} >= 0 THEN 'upper' WHEN {sd(*INTER)} >= 0 THEN 'intersection' WHEN {sd(*MAIN)} >= 0 THEN 'crosswalk_main' END"
DEPTH = f"CASE WHEN {sd(*ISLE)} >= 0 THEN -{sd(*ISLE)} ELSE GREATEST({sd(*UPPER)}, {sd(*INTER)}, {sd(*MAIN)}) END"

define("k0", "SELECT *, (x1 + x2) / 2e0 AS gx, y2 AS gy, SQRT(GREATEST(1e0, (x2 - x1) * (y2 - y1))) AS raw FROM s_tracks", "s_tracks")
define("k1", gauss({"px": "gx", "py": "gy"}, 0.25, "k0", "video_id, track_id, frame_idx, t_us, category, x1, y1, x2, y2"), "k0")
define("k2", gauss({"size": "raw"}, 1, "k0", "video_id, track_id, t_us"), "k0")
define("k3", f"SELECT *, {deriv('px', 400000)} AS vx, {deriv('py', 400000)} AS vy, t_us - LAG(t_us) OVER ({BY}) AS dt_us FROM k1 JOIN k2 USING (video_id, track_id, t_us)", "k1", "k2")
define("k4", "SELECT *, SQRT(vx * vx + vy * vy) / size AS speed FROM k3", "k3")
define("k5", gauss({"ss": "speed"}, 0.2, "k4", "video_id, track_id, t_us"), "k4")
define("k6", f"SELECT *, {deriv('ss', 300000)} AS accel FROM k4 JOIN k5 USING (video_id, track_id, t_us)", "k4", "k5")
define("kin", f"""SELECT k6.*, CASE WHEN speed >= 15e-2 THEN ATAN2(vy, vx) END AS heading, {ZONE} AS zone,
(x1 <= 1662e-2 OR y1 <= 1662e-2 OR x2 >= 1662e0 - 1662e-2 OR y2 >= 924e0 - 1662e-2) AS at_edge FROM k6""", "k6")
define("stats", f"SELECT {K}, MEDIAN(size) AS med_size, COALESCE(MEDIAN(dt_us), 0) AS step_us, MIN(t_us) AS first_us, MAX(t_us) AS last_us, COUNT(*) AS n_obs FROM kin GROUP BY 1, 2", "kin")
define("smp", "SELECT * FROM kin JOIN stats USING (video_id, track_id)", "kin", "stats")
define("veh", "SELECT * FROM smp WHERE category IN ('car', 'bus', 'truck', 'bicycle', 'motorcycle') AND med_size >= 12e-3 * 1662", "smp")
define("cars", "SELECT * FROM veh WHERE category IN ('car', 'bus', 'truck')", "veh")


@query("kinematics", f"""SELECT video_id, track_id, CAST(frame_idx AS BIGINT) AS frame_idx, {r('px', 3)} AS px, {r('py', 3)} AS py, {r('size', 3)} AS size, {r('vx', 3)} AS vx, {r('vy', 3)} AS vy,
{r('speed', 4)} AS speed, {r('accel', 4)} AS accel, at_edge FROM kin""", "kin")
def kinematics(spark, sf):
    o = S.tracks(spark, sf)
    k = T.kinematics(o, T.min_samples(T.majority_category(o)), S.videos(spark, sf))
    k = rd(rd(k, "px", "py", "size", "vx", "vy", n=3), "speed", "accel")
    return k.select("video_id", "track_id", F.col("frame_idx").cast("long").alias("frame_idx"), "px", "py", "size", "vx", "vy", "speed", "accel", "at_edge")


@query("gaussian_smooth", "SELECT video_id, track_id, t_us, " + r("sx", 3) + " AS sx FROM (" + gauss({"sx": "gx"}, 0.5, "k0", "video_id, track_id, t_us") + ") z", "k0")
def gaussian_smooth(spark, sf):
    o = S.tracks(spark, sf).withColumn("gx", F.expr("(x1 + x2) / 2e0"))
    from lanewise.operators.slices import own_rows, slice_rows
    by = [*T.KEY, "slice"]
    out = own_rows(slice_rows(o, 1_500_000, 8_000_000).withColumn("sx", ts.gaussian_smooth(["gx"], 0.5, by)["gx"]))
    return rd(out.select(*T.KEY, "t_us", "sx"), "sx", n=3)


@query("derivative", f"SELECT video_id, track_id, t_us, {r(deriv('gx', 100000), 3)} AS d FROM k0", "k0")
def derivative(spark, sf):
    o = S.tracks(spark, sf).withColumn("gx", F.expr("(x1 + x2) / 2e0"))
    return rd(o.select(*T.KEY, "t_us", ts.derivative("gx", 0.1, T.KEY).alias("d")), "d", n=3)


def grad(x: str, by=BY) -> str:
    p, n = f"LAG({x}) OVER ({by})", f"LEAD({x}) OVER ({by})"
    hs, hd = f"((t_us - LAG(t_us) OVER ({by})) / 1e6)", f"((LEAD(t_us) OVER ({by}) - t_us) / 1e6)"
    return (f"CASE WHEN {p} IS NULL AND {n} IS NULL THEN 0e0 WHEN {p} IS NULL THEN ({n} - {x}) / {hd} WHEN {n} IS NULL THEN ({x} - {p}) / {hs} "
            f"ELSE ({hs} * {hs} * {n} + ({hd} * {hd} - {hs} * {hs}) * {x} - {hd} * {hd} * {p}) / ({hs} * {hd} * ({hd} + {hs})) END")


@query("gradient", f"SELECT video_id, track_id, t_us, {r(grad('gx'), 3)} AS g FROM k0", "k0")
def gradient(spark, sf):
    o = S.tracks(spark, sf).withColumn("gx", F.expr("(x1 + x2) / 2e0"))
    return rd(o.select(*T.KEY, "t_us", ts.gradient(F.col("gx"), T.KEY).alias("g")), "g", n=3)


def unwrap(h: str, src: str, keys: str, where: str = "TRUE") -> str:
    """Continuous angle as a running sum of wrapped steps."""
    o = f"PARTITION BY {keys} ORDER BY t_us"
    step = "d - 2e0 * PI() * FLOOR((d + PI()) / (2e0 * PI()))"
    return f"""SELECT *, f0 + SUM(COALESCE({step}, 0)) OVER ({o} ROWS UNBOUNDED PRECEDING) AS theta FROM (
SELECT *, {h} - LAG({h}) OVER ({o}) AS d, FIRST_VALUE({h}) OVER ({o}) AS f0 FROM {src} WHERE {h} IS NOT NULL AND {where}) u0"""


define("unw", unwrap("heading", "veh", K), "veh")


# relative to the first sample: the whole turns an unwrapped angle starts with are arbitrary
@query("unwrap_heading", f"SELECT video_id, track_id, t_us, {r(f'theta - FIRST_VALUE(theta) OVER ({BY})')} AS turned FROM unw", "unw")
def unwrap_q(spark, sf):
    an = S.analysis(spark, sf)
    th = unwrap_heading(T.vehicle_tracks(an.samples))
    return rd(th.select(*T.KEY, "t_us", (F.col("theta") - F.first("theta").over(ts.win(T.KEY))).alias("turned")), "turned")


@query("vehicle_tracks", "SELECT video_id, category, COUNT(DISTINCT track_id) AS n_tracks, COUNT(*) AS n FROM veh GROUP BY 1, 2", "veh")
def vehicle_tracks(spark, sf):
    v = T.vehicle_tracks(S.analysis(spark, sf).samples)
    return v.groupBy("video_id", "category").agg(F.countDistinct("track_id").alias("n_tracks"), F.count("*").alias("n"))


define("cover", """SELECT p.video_id, p.track_id, AVG(CASE WHEN EXISTS (SELECT 1 FROM smp v WHERE v.video_id = p.video_id AND v.frame_idx = p.frame_idx AND v.category IN ('car', 'bus', 'truck', 'bicycle', 'motorcycle')
AND GREATEST(0, LEAST(p.x2, v.x2) - GREATEST(p.x1, v.x1)) * GREATEST(0, LEAST(p.y2, v.y2) - GREATEST(p.y1, v.y1)) / GREATEST(1e-6, (p.x2 - p.x1) * (p.y2 - p.y1)) > 3e-1) THEN 1e0 ELSE 0e0 END) AS covered
FROM smp p WHERE p.category = 'person' GROUP BY 1, 2""", "smp")
define("peds", "SELECT s.* FROM smp s JOIN cover USING (video_id, track_id) WHERE covered < 5e-1", "cover", "smp")


@query("pedestrians", f"SELECT video_id, track_id, {r('covered')} AS covered FROM cover", "cover")
def pedestrians(spark, sf):
    return rd(T.covered_share(S.analysis(spark, sf).samples), "covered")


@query("median_size", f"SELECT video_id, track_id, {r('med_size')} AS med_size, {r('step_us', 1)} AS step_us FROM stats", "stats")
def median_size(spark, sf):
    from lanewise.operators.medians import exact_median
    s = S.analysis(spark, sf).samples
    m = exact_median(s, T.KEY, "size", "n_obs", width=0.25, hot=100).withColumnRenamed("median", "med_size")
    return rd(rd(m.join(s.select(*T.KEY, "step_us").distinct(), T.KEY), "med_size"), "step_us", n=1)


# ---- geometry ---------------------------------------------------------------

def _with_scene(spark, sf):
    return S.tracks(spark, sf).selectExpr("*", "(x1 + x2) / 2e0 AS px", "y2 AS py").join(S.scene(spark, sf), "video_id")


define("gp", "SELECT *, (x1 + x2) / 2e0 AS px, y2 AS py FROM s_tracks", "s_tracks")


@query("zone_of", f"SELECT video_id, track_id, COALESCE({ZONE}, 'none') AS zone, COUNT(*) AS n FROM gp GROUP BY 1, 2, 3", "gp")
def zone_of(spark, sf):
    z = G.zone_of(F.col("islands"), F.col("roads"), F.col("crosswalks"), F.col("px"), F.col("py"))
    return (_with_scene(spark, sf).withColumn("zone", F.coalesce(z, F.lit("none")))
            .groupBy("video_id", "track_id", "zone").agg(F.count("*").alias("n")))


@query("polygon_distance", f"SELECT video_id, track_id, CAST(frame_idx AS BIGINT) AS frame_idx, {r(sd(*MAIN), 4)} AS d FROM gp", "gp")
def polygon_distance(spark, sf):
    d = G.polygon_distance(F.col("crosswalks")[0]["edges"], F.col("px"), F.col("py"))
    return rd(_with_scene(spark, sf).select("video_id", "track_id", F.col("frame_idx").cast("long").alias("frame_idx"), d.alias("d")), "d")


@query("road_depth", f"SELECT video_id, track_id, {r(f'SUM({DEPTH})', 3)} AS depth FROM gp GROUP BY 1, 2", "gp")
def road_depth(spark, sf):
    d = G.road_depth(F.col("islands"), F.col("roads"), F.col("crosswalks"), F.col("px"), F.col("py"))
    return rd(_with_scene(spark, sf).groupBy("video_id", "track_id").agg(F.sum(d).alias("depth")), "depth", n=3)


@query("transform_points", f"""SELECT video_id, {r('2e0 * 900 + 1e-1 * 0 + 5', 4)} AS x, {r('-1e-1 * 900 + 2e0 * 0 + n', 4)} AS y, n >= 25 AS registered FROM (
SELECT video_id, COUNT(*) % 50 AS n FROM s_tracks GROUP BY 1) WHERE n >= 25
UNION ALL SELECT video_id, 18e2, 0e0, FALSE FROM (SELECT video_id, COUNT(*) % 50 AS n FROM s_tracks GROUP BY 1) WHERE n < 25""", "s_tracks")
def transform_points(spark, sf):
    import json
    lay = layout_from_text(spark.createDataFrame([("flat", json.dumps(S.LAYOUT))], "scene_id string, doc string"), "doc")
    v = S.videos(spark, sf).withColumn("width", F.lit(3324)).withColumn("height", F.lit(1848))
    n = S.tracks(spark, sf).groupBy("video_id").agg((F.count("*") % 50).alias("inliers"))
    views = n.selectExpr("video_id", "2e0 AS m00", "1e-1 AS m01", "5e0 AS m02", "-1e-1 AS m10", "2e0 AS m11", "cast(inliers as double) AS m12", "cast(inliers as int) AS inliers")
    s = load_scene(lay, v.join(n.select("video_id"), "video_id", "left_semi"), views)
    e = F.col("crosswalks")[0]["edges"][0]
    return s.select("video_id", F.round(e["ax"], 4).alias("x"), F.round(e["ay"], 4).alias("y"), "registered")


def _corners() -> str:
    """Every corner of the layout's areas as SQL rows."""
    rows = [(kind, name, n, x, y) for kind in ("road", "islands", "crosswalks") for name, poly in S.LAYOUT[kind].items() for n, (x, y) in enumerate(poly)]
    rows += [("box", name, n, x, y) for name, a in S.LAYOUT["approaches"].items() for n, (x, y) in enumerate(a["box_zone"])]
    return ", ".join(f"('{k}', '{m}', {n}, {x}e0, {y}e0)" for k, m, n, x, y in rows)


# views of two sizes that depend on the data
@query("read_scene", f"""SELECT video_id, kind, name, CAST(corner AS BIGINT) AS corner, {r('x * k')} AS x, {r('y * k')} AS y
FROM (SELECT video_id, 1 + COUNT(*) % 3 AS k FROM s_tracks GROUP BY 1), (VALUES {_corners()}) c(kind, name, corner, x, y)""", "s_tracks")
def read_scene(spark, sf):
    import json
    lay = layout_from_text(spark.createDataFrame([("flat", json.dumps(S.LAYOUT))], "scene_id string, doc string"), "doc")
    k = S.tracks(spark, sf).groupBy("video_id").agg((1 + F.count("*") % 3).alias("k"))
    v = S.videos(spark, sf).join(k, "video_id").withColumn("width", (S.W * F.col("k")).cast("int")).withColumn("height", (S.H * F.col("k")).cast("int"))
    s = load_scene(lay, v)
    areas = [s.select("video_id", F.lit(kind).alias("kind"), F.explode(c).alias("z")) for kind, c in (("road", "roads"), ("islands", "islands"), ("crosswalks", "crosswalks"))]
    out = s.select("video_id", F.lit("box").alias("kind"), F.explode(F.transform("approaches", lambda a: a["box"])).alias("z"))
    for a in areas:
        out = out.unionByName(a)
    out = out.select("video_id", "kind", "z.name", F.posexplode("z.edges").alias("corner", "e"))
    return rd(out.select("video_id", "kind", "name", F.col("corner").cast("long").alias("corner"), F.col("e.ax").alias("x"), F.col("e.ay").alias("y")), "x", "y")


@query("accept_transform", """SELECT track_id, COUNT(*) >= 25 AND COUNT(*) / 272e0 * 11e-1 > 7e-1 AND COUNT(*) / 272e0 * 11e-1 < 14e-1 AS registered FROM s_tracks
WHERE (frame_idx * 3 + track_id) % 100 < 100 - track_id % 60 GROUP BY 1""", "s_tracks")
def accept(spark, sf):
    n = S.tracks(spark, sf).filter("(frame_idx * 3 + track_id) % 100 < 100 - track_id % 60").groupBy("track_id").agg(F.count("*").alias("inliers"))
    v = n.selectExpr("track_id", "inliers", "inliers / 272e0 * 11e-1 AS m00", "0e0 AS m10", "1e0 AS expected_scale")
    return accept_transform(v).select("track_id", "registered")


# approach north: line (100, 500) -> (1500, 500), direction (0, -1); east: line (850, 0) -> (850, 924), direction (1, 0)
define("app", """SELECT *, -(fy - 500e0) AS prog, (px - 1e2) / 14e2 BETWEEN -1e-1 AND 11e-1 AS in_span FROM (SELECT *, 'north' AS approach, CAST(NULL AS VARCHAR) AS head, px AS fx, py - 7e-1 * size AS fy FROM veh) a1
UNION ALL SELECT *, fx - 850e0, py / 924e0 BETWEEN -1e-1 AND 11e-1 FROM (SELECT *, 'east' AS approach, 'h0' AS head, px AS fx, py AS fy FROM veh) a2""", "veh")


@query("line_progress", f"SELECT approach, video_id, track_id, {r('SUM(prog)', 2)} AS prog FROM app GROUP BY 1, 2, 3", "app")
def line_progress(spark, sf):
    a = J.approach_samples(S.analysis(spark, sf))
    return rd(a.groupBy("approach", "video_id", "track_id").agg(F.sum("prog").alias("prog")), "prog", n=2)


@query("within_line_span", "SELECT approach, video_id, COUNT(*) FILTER (in_span) AS n FROM app GROUP BY 1, 2", "app")
def within_line_span(spark, sf):
    return J.approach_samples(S.analysis(spark, sf)).groupBy("approach", "video_id").agg(F.count_if("in_span").alias("n"))


@query("front_point", f"SELECT video_id, track_id, {r('SUM(py - 7e-1 * size)', 2)} AS fy FROM veh GROUP BY 1, 2", "veh")
def front_point(spark, sf):
    an = S.analysis(spark, sf)
    a = an.scene.select("video_id", F.explode("approaches").alias("a")).filter("a.name = 'north'")
    _, fy = G.front_point(F.col("a"), F.col("px"), F.col("py"), F.col("size"))
    return rd(T.vehicle_tracks(an.samples).join(a, "video_id").groupBy("video_id", "track_id").agg(F.sum(fy).alias("fy")), "fy", n=2)


@query("side_of_line", f"SELECT video_id, track_id, {r('SUM((14e2 * (py - 100e0) - 300e0 * (px - 50e0)) / (SQRT(14e2 * 14e2 + 300e0 * 300e0) + 1e-9))', 3)} AS side FROM gp GROUP BY 1, 2", "gp")
def side_of_line(spark, sf):
    s = G.side_of_line(F.lit(50.0), F.lit(100.0), F.lit(1450.0), F.lit(400.0), F.col("px"), F.col("py"))
    return rd(_with_scene(spark, sf).groupBy("video_id", "track_id").agg(F.sum(s).alias("side")), "side", n=3)


def seg(ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    u = f"(((px - {ax}e0) * {dx}e0 + (py - {ay}e0) * {dy}e0) / ({dx * dx + dy * dy}e0 + 1e-9))"
    d = f"SQRT(POW(px - {ax}e0 - {u} * {dx}e0, 2) + POW(py - {ay}e0 - {u} * {dy}e0, 2))"
    return f"(CASE WHEN {u} >= 0 AND {u} <= 1 THEN {d} END)", f"SIGN({dx}e0 * (py - {ay}e0) - {dy}e0 * (px - {ax}e0))"


(D1, S1), (D2, S2) = seg(300, 0, 340, 500), seg(340, 500, 300, 924)
SIGNED = f"CASE WHEN {D1} IS NULL THEN {D2} * {S2} WHEN {D2} IS NULL OR {D1} <= {D2} THEN {D1} * {S1} ELSE {D2} * {S2} END"


@query("polyline_distance", f"SELECT video_id, track_id, COUNT(d) AS n, {r('SUM(d)', 3)} AS total FROM (SELECT *, {SIGNED} AS d FROM gp) GROUP BY 1, 2", "gp")
def polyline_distance(spark, sf):
    o = G.polyline_offset(F.col("solid_lines")[0]["edges"], F.col("px"), F.col("py"))
    d = _with_scene(spark, sf).withColumn("o", o).withColumn("d", F.col("o.dist") * F.col("o.sign"))
    return rd(d.groupBy("video_id", "track_id").agg(F.count("d").alias("n"), F.sum("d").alias("total")), "total", n=3)


@query("moving_toward", "SELECT video_id, track_id, COUNT(*) AS n FROM smp WHERE speed >= 4e-1 AND vx / (SQRT(vx * vx + vy * vy) + 1e-9) > 3e-1 GROUP BY 1, 2", "smp")
def moving_toward(spark, sf):
    m = M.moving_toward(F.col("vx"), F.col("vy"), F.col("speed"), F.lit(1.0), F.lit(0.0))
    return S.analysis(spark, sf).samples.filter(m).groupBy("video_id", "track_id").agg(F.count("*").alias("n"))


@query("angle_diff", f"SELECT video_id, track_id, t_us, {r('(heading - 25e-1 + PI()) - 2e0 * PI() * FLOOR((heading - 25e-1 + PI()) / (2e0 * PI())) - PI()', 4)} AS d FROM smp WHERE heading IS NOT NULL", "smp")
def angle_diff(spark, sf):
    s = S.analysis(spark, sf).samples.filter("heading is not null")
    return rd(s.select("video_id", "track_id", "t_us", M.angle_diff(F.col("heading"), F.lit(2.5)).alias("d")), "d")


# ---- signals ----------------------------------------------------------------

define("sg0", """SELECT *, CASE state WHEN 'red' THEN 1 WHEN 'amber' THEN 2 WHEN 'green' THEN 3 ELSE 0 END AS c0 FROM s_heads""", "s_heads")
define("sg1", """SELECT *, CASE WHEN c0 > 0 THEN c0 WHEN t_us - MAX(CASE WHEN c0 > 0 THEN t_us END) OVER w <= 2000000 THEN LAST_VALUE(CASE WHEN c0 > 0 THEN c0 END IGNORE NULLS) OVER w ELSE 0 END AS c1
FROM sg0 WINDOW w AS (PARTITION BY video_id, head ORDER BY t_us ROWS UNBOUNDED PRECEDING)""", "sg0")
# 80 ms steps: the filter is 13 rows wide
define("sg2", """SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, head ORDER BY t_us) AS n, COUNT(*) OVER (PARTITION BY video_id, head) AS total FROM sg1""", "sg1")
define("sg3", """SELECT a.video_id, a.head, a.frame_idx, a.t_us, b.c1 AS c, COUNT(*) AS votes FROM sg2 a, range(-6, 7) o(k), sg2 b
WHERE b.video_id = a.video_id AND b.head = a.head AND b.n = LEAST(GREATEST(a.n + k, 1), a.total) GROUP BY 1, 2, 3, 4, 5""", "sg2")
define("tl", """SELECT video_id, head, frame_idx, t_us, c AS code, LAG(t_us) OVER (PARTITION BY video_id, head ORDER BY t_us) AS prev_us FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id, head, frame_idx ORDER BY votes DESC, c) AS rn FROM sg3) WHERE rn = 1""", "sg3")


def _tl(spark, sf):
    return SG.signal_timeline(S.heads(spark, sf), slice_us=40_000_000)


@query("signal_timeline", "SELECT video_id, head, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(code AS BIGINT) AS code FROM tl", "tl")
def signal_timeline(spark, sf):
    return _tl(spark, sf).select("video_id", "head", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("code").cast("long").alias("code"))


@query("signal_readable", """SELECT video_id, head, ROUND(AVG(CASE WHEN state <> 'unknown' THEN 1e0 ELSE 0e0 END), 6) AS known, AVG(CASE WHEN state <> 'unknown' THEN 1e0 ELSE 0e0 END) > 5e-1 AS readable FROM s_signal GROUP BY 1, 2""", "s_signal")
def signal_readable(spark, sf):
    return rd(SG.signal_readable(S.signal(spark, sf).withColumn("code", SG.code_of())), "known", n=6)


PROBE = "SELECT video_id, 'h0' AS head, CAST(track_id AS BIGINT) AS track_id, CAST(t_us + 13000 + track_id AS BIGINT) AS t_us FROM {t}"


@query("signal_at", """SELECT q.video_id, q.track_id, q.t_us, CAST(COALESCE((SELECT ARG_MIN(code, t.t_us) FROM tl t WHERE t.video_id = q.video_id AND t.head = q.head AND t.t_us >= q.t_us),
(SELECT ARG_MAX(code, t.t_us) FROM tl t WHERE t.video_id = q.video_id AND t.head = q.head), 0) AS BIGINT) AS code FROM (""" + PROBE.format(t="s_tracks") + ") q", "tl", "s_tracks")
def signal_at(spark, sf):
    q = spark.sql(PROBE.format(t="{t}"), t=S.tracks(spark, sf))
    return SG.signal_at(q, _tl(spark, sf), block_us=2_000_000).select("video_id", "track_id", "t_us", F.col("code").cast("long").alias("code"))


@query("signal_held", """SELECT q.video_id, q.track_id, q.t_us, COALESCE((SELECT BOOL_AND(code = 1) FROM tl t WHERE t.video_id = q.video_id AND t.head = q.head AND t.t_us BETWEEN q.t_us - 1000000 AND q.t_us), FALSE) AS held
FROM (""" + PROBE.format(t="s_tracks") + ") q", "tl", "s_tracks")
def signal_held(spark, sf):
    q = spark.sql(PROBE.format(t="{t}"), t=S.tracks(spark, sf))
    return SG.signal_held(q, _tl(spark, sf), 1, 1.0, block_us=2_000_000).select("video_id", "track_id", "t_us", "held")


SPANS = "SELECT video_id, 'h0' AS head, CAST(track_id AS BIGINT) AS track_id, CAST(MIN(t_us) + track_id % 17 * 100000 AS BIGINT) AS start_us, CAST(MIN(t_us) + track_id % 17 * 100000 + 500000 + track_id % 41 * 300000 AS BIGINT) AS end_us FROM {t} GROUP BY video_id, track_id"


@query("signal_fraction", f"""SELECT q.video_id, q.track_id, {r("COALESCE((SELECT AVG(CASE WHEN code = 1 THEN 1e0 ELSE 0e0 END) FROM tl t WHERE t.video_id = q.video_id AND t.head = q.head AND t.t_us >= q.start_us AND COALESCE(t.prev_us, -1) < q.end_us), 0)", 6)} AS share
FROM (""" + SPANS.format(t="s_tracks") + ") q", "tl", "s_tracks")
def signal_fraction(spark, sf):
    q = spark.sql(SPANS, t=S.tracks(spark, sf))
    return rd(SG.signal_fraction(q, _tl(spark, sf), 1, block_us=2_000_000).select("video_id", "track_id", "share"), "share", n=6)


# ---- windows ----------------------------------------------------------------

define("frames", "SELECT video_id, CAST(f AS INT) AS frame_idx, CAST(f * 80000 AS BIGINT) AS t_us FROM s_videos, range(0, 300) g(f)", "s_videos")


@query("moving_average", f"""SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, {r('s / 25e0', 6)} AS n FROM (SELECT video_id, frame_idx, SUM(n) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS s
FROM (SELECT f.video_id, f.frame_idx, COUNT(s.track_id) AS n FROM frames f LEFT JOIN s_tracks s ON s.video_id = f.video_id AND s.frame_idx = f.frame_idx GROUP BY 1, 2)) WHERE s > 0""", "frames", "s_tracks")
def moving_average(spark, sf):
    per = S.tracks(spark, sf).groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"))
    out = J.moving_average(per, ["video_id"], ["n"], T.frame_grid(S.videos(spark, sf), 12.5))
    return rd(out.select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), "n"), "n", n=6)


define("drops", """SELECT a.video_id, a.track_id, a.t_us, CASE WHEN COUNT(b.t_us) FILTER (b.t_us <= a.t_us - 500000) > 0 AND COUNT(b.t_us) FILTER (b.t_us >= a.t_us + 500000) > 0 THEN MEDIAN(b.speed) FILTER (b.t_us <= a.t_us - 500000) ELSE 0 END AS v_before,
CASE WHEN COUNT(b.t_us) FILTER (b.t_us <= a.t_us - 500000) > 0 AND COUNT(b.t_us) FILTER (b.t_us >= a.t_us + 500000) > 0 THEN MEDIAN(b.speed) FILTER (b.t_us >= a.t_us + 500000) ELSE 0 END AS v_after
FROM smp a JOIN smp b ON a.video_id = b.video_id AND a.track_id = b.track_id AND b.t_us BETWEEN a.t_us - 1100000 AND a.t_us + 1100000 GROUP BY 1, 2, 3""", "smp")


@query("speed_drop", f"SELECT video_id, track_id, t_us, {r('v_before')} AS v_before, {r('v_after')} AS v_after FROM drops", "drops")
def speed_drop(spark, sf):
    from lanewise.operators.pairs import speed_windows
    return rd(speed_windows(S.analysis(spark, sf).samples).select("video_id", "track_id", "t_us", "v_before", "v_after"), "v_before", "v_after")


@query("heading_rate", f"SELECT video_id, track_id, t_us, {r('ABS(' + grad('theta') + ')', 3)} AS rate FROM unw", "unw")
def heading_rate(spark, sf):
    th = unwrap_heading(T.vehicle_tracks(S.analysis(spark, sf).samples))
    return rd(th.select(*T.KEY, "t_us", F.abs(ts.gradient(F.col("theta"), T.KEY)).alias("rate")), "rate", n=3)


@query("heading_change", f"SELECT video_id, track_id, t_us, {r('MAX(theta) OVER w - MIN(theta) OVER w')} AS swing FROM unw WINDOW w AS ({BY} RANGE BETWEEN 500000 PRECEDING AND 1500000 FOLLOWING)", "unw")
def heading_change(spark, sf):
    th = unwrap_heading(T.vehicle_tracks(S.analysis(spark, sf).samples))
    rng = lambda a: ts.over_range(a, -0.5, 1.5, T.KEY)
    return rd(th.select(*T.KEY, "t_us", (rng(F.max("theta")) - rng(F.min("theta"))).alias("swing")), "swing")



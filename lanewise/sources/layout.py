"""Scene layouts: one row per video with the shapes mapped into its frame."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import MIN_INLIERS, SCALE_RANGE
from ..functions.geometry import ring

POLY = "array<array<double>>"
LAYOUT = (
    f"ref_size array<double>, road map<string,{POLY}>, islands map<string,{POLY}>, crosswalks map<string,{POLY}>,"
    f"approaches map<string,struct<zone:string,direction:array<double>,stop_line:{POLY},box_zone:{POLY},signal_head:string>>,"
    f"wrong_way_zones map<string,struct<polygon:{POLY},direction:array<double>>>,"
    "signal_lights map<string,string>, solid_lines map<string,string>,"
    "forbidden_movements struct<pairs:array<array<string>>>"
)
HEAD = "struct<box:array<double>,kind:string>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON with an explicit schema, map order kept; ``scene_id`` is the file's base name."""
    text = spark.read.text(path, wholetext=True).withColumn(
        "scene_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))
    return layout_from_text(text, "value")


def layout_from_text(df: DataFrame, col: str) -> DataFrame:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.from_json(col, LAYOUT).alias("l")).select(*keep, "l.*")


def accept_transform(views: DataFrame) -> DataFrame:
    """``registered``: enough inliers and a scale near the expected width ratio."""
    scale = F.hypot("m00", "m10")
    ok = ((F.col("inliers") >= MIN_INLIERS) & (scale > SCALE_RANGE[0] * F.col("expected_scale"))
          & (scale < SCALE_RANGE[1] * F.col("expected_scale")))
    return views.withColumn("registered", F.coalesce(ok, F.lit(False)))


def load_scene(layout: DataFrame, videos: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Scene row per video: zones, approaches, heads and lines through the video's 2x3 view transform.

    Videos name their layout by ``scene_id``. Those without an accepted
    transform in ``views`` fall back to rescaling each axis.
    """
    m = ["m00", "m01", "m02", "m10", "m11", "m12"]
    view = videos.select("video_id", "scene_id", "width", "height").join(layout.select("scene_id", "ref_size"), "scene_id")
    if views is None:
        view = view.withColumns({**{c: F.lit(None).cast("double") for c in m}, "inliers": F.lit(0)})
    else:
        view = view.join(views.select("video_id", *m, "inliers"), "video_id", "left")
    view = accept_transform(view.withColumn("expected_scale", F.col("width") / F.col("ref_size")[0]))
    plain = {"m00": F.col("width") / F.col("ref_size")[0], "m11": F.col("height") / F.col("ref_size")[1]}
    view = view.withColumns({c: F.when(F.col("registered"), F.col(c)).otherwise(plain.get(c, F.lit(0.0))) for c in m})
    # matrix on one side of the join, shapes on the other: the optimizer then keeps the matrix as plain columns
    base = view.drop("ref_size").join(layout.drop("ref_size"), "scene_id")

    def point(p):
        return F.struct((F.col("m00") * p[0] + F.col("m01") * p[1] + F.col("m02")).alias("x"),
                        (F.col("m10") * p[0] + F.col("m11") * p[1] + F.col("m12")).alias("y"))

    def unit(d):
        x, y = F.col("m00") * d[0] + F.col("m01") * d[1], F.col("m10") * d[0] + F.col("m11") * d[1]
        n = F.hypot(x, y) + F.lit(1e-9)
        return x / n, y / n

    def zone(name, poly, d=None):
        pts = F.transform(poly, point)
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        dx, dy = unit(d) if d is not None else (F.lit(None).cast("double"),) * 2
        return F.struct(name.alias("name"), ring(pts).alias("edges"),
                        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
                        dx.alias("dir_x"), dy.alias("dir_y"))

    def each(col, fn):
        return F.transform(F.map_entries(col), lambda e: fn(e["key"], e["value"]))

    def named(col):
        return F.filter(F.map_entries(col), lambda e: ~e["key"].startswith("_"))

    def approach(k, a):
        dx, dy = unit(a["direction"])
        p0, p1 = point(a["stop_line"][0]), point(a["stop_line"][1])
        return F.struct(k.alias("name"), a["zone"].alias("zone"), dx.alias("dir_x"), dy.alias("dir_y"),
                        p0["x"].alias("lx0"), p0["y"].alias("ly0"), p1["x"].alias("lx1"), p1["y"].alias("ly1"),
                        zone(k, a["box_zone"]).alias("box"), a["signal_head"].alias("signal_head"))

    def head(e):
        v = F.from_json(e["value"], HEAD)
        a, b = point(F.array(v["box"][0], v["box"][1])), point(F.array(v["box"][2], v["box"][3]))
        return F.struct(e["key"].alias("head"), v["kind"].alias("kind"),
                        F.least(a["x"], b["x"]).alias("x1"), F.least(a["y"], b["y"]).alias("y1"),
                        F.greatest(a["x"], b["x"]).alias("x2"), F.greatest(a["y"], b["y"]).alias("y2"))

    return base.select(
        "video_id", "scene_id", "width", "height", "registered", F.coalesce("inliers", F.lit(0)).alias("inliers"),
        each("road", zone).alias("roads"), each("islands", zone).alias("islands"),
        each("crosswalks", zone).alias("crosswalks"), each("approaches", approach).alias("approaches"),
        each("wrong_way_zones", lambda k, v: zone(k, v["polygon"], v["direction"])).alias("wrong_way"),
        F.transform(named("signal_lights"), head).alias("heads"),
        F.transform(named("solid_lines"), lambda e: F.struct(
            e["key"].alias("name"),
            ring(F.transform(F.from_json(e["value"], POLY), point), closed=False).alias("edges"))).alias("solid_lines"),
        F.transform(F.col("forbidden_movements.pairs"), lambda p: F.struct(
            p[0].alias("from_zone"), p[1].alias("to_zone"))).alias("forbidden"))

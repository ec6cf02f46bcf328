"""Readers and writers of the result files.

Predictions: {"team", "videos": {name: {"events": [[start, end, label]], "risk": [[t, score]]}}}.
Truth: {name: {"duration", "fps", "events"}}. A file holds one document, or one document a line; any number of files.
A document written here also has its "part": long lists are cut into parts of ``CHUNK`` items, so that no row
grows with a feed, and readers count positions on from part to part.
"""
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.slices import prefix_in_slices

ITEMS = "array<array<string>>"
PREDICTIONS = f"team string, part bigint, videos map<string,struct<events:{ITEMS},risk:array<array<double>>>>"
TRUTH = f"map<string,struct<duration:double,fps:double,part:bigint,events:{ITEMS}>>"
CHUNK = 20_000
PART = 100_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every document. A file with a line that is a whole object has a document a line, any other is one document."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    whole_line = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    by_line = lines.groupBy("file").agg(F.max(whole_line).alias("by_line"))
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return (lines.join(by_line.where("by_line"), "file", "left_semi")
            .unionByName(files.join(by_line.where("NOT by_line"), "file", "left_semi")).select("value"))


def _continued(entries: DataFrame, items: str) -> DataFrame:
    """(video_id, pos, item): items of all parts of a video; ``pos`` is the place in the whole list and breaks ties later."""
    size = F.when(F.col(items).isNotNull(), F.size(items)).otherwise(0).cast("long")
    w = Window.partitionBy("video_id").orderBy("part", F.xxhash64(items)).rowsBetween(Window.unboundedPreceding, -1)
    sized_parts = entries.withColumn("base", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return sized_parts.select("video_id", "base", F.posexplode(items).alias("p", "item")).select(
        "video_id", (F.col("base") + F.col("p")).alias("pos"), "item")


def _events(entries: DataFrame) -> DataFrame:
    e = F.col("item")
    return _continued(entries, "events").select("video_id", "pos", e[0].cast("double").alias("start_sec"),
                                                e[1].cast("double").alias("end_sec"), e[2].alias("label"))


def prediction_tables(docs: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, events, risk) of prediction documents."""
    entries = (docs.select(F.from_json(col, PREDICTIONS).alias("d"))
               .select(F.coalesce("d.part", F.lit(0)).alias("part"), F.explode("d.videos").alias("video_id", "entry"))
               .select("video_id", "part", "entry.events", "entry.risk"))
    risk = _continued(entries, "risk").select("video_id", "pos", F.col("item")[0].alias("t"), F.col("item")[1].alias("score"))
    return entries.select("video_id").distinct(), _events(entries), risk


def read_predictions(spark: SparkSession, path: str):
    return prediction_tables(read_documents(spark, path))


def truth_tables(docs: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(videos, events) of truth documents."""
    entries = docs.select(F.explode(F.from_json(col, TRUTH)).alias("video_id", "entry")).select(
        "video_id", "entry.duration", "entry.fps", F.coalesce("entry.part", F.lit(0)).alias("part"), "entry.events")
    return entries.groupBy("video_id").agg(F.max("duration").alias("duration"), F.max("fps").alias("fps")), _events(entries)


def read_ground_truth(spark: SparkSession, path: str):
    return truth_tables(read_documents(spark, path))


def import_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return label_tables(read_documents(spark, path))


def label_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos, events) of documents in either format; predictions get duration 0 and 25 fps."""
    is_pred = F.get_json_object("value", "$.videos").isNotNull()
    pv, pe, _ = prediction_tables(docs.filter(is_pred))
    tv, te = truth_tables(docs.filter(~is_pred))
    return (pv.select("video_id", F.lit(0.0).alias("duration"), F.lit(25.0).alias("fps")).unionByName(tv), pe.unionByName(te))


def raw_items(docs: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, entries, event items, risk items) with values kept as VARIANT, for format checks."""
    top = docs.select(F.from_json(col, "team variant, videos map<string,variant>").alias("d"))
    files = top.select(F.col("d.team").isNotNull().alias("has_team"), F.col("d.videos").isNotNull().alias("ok"))
    entries = top.select(F.explode("d.videos").alias("video_id", "entry"))
    lists = entries.select("video_id", "entry", F.expr("try_variant_get(entry, '$.events', 'array<variant>')").alias("ev"),
                           F.expr("try_variant_get(entry, '$.risk', 'array<variant>')").alias("rk"))
    item = lambda c: lists.select("video_id", F.posexplode(c).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))
    risk_ok = F.col("rk").isNotNull() | F.expr("try_variant_get(entry, '$.risk', 'variant') IS NULL")
    return files, lists.select("video_id", F.col("ev").isNotNull().alias("ok"), risk_ok.alias("risk_ok")), item("ev"), item("rk")


def upsert_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new segments; touching ones of one class become one."""
    from ..operators.intervals import merge_segments
    cols = ["video_id", "label", "start_sec", "end_sec"]
    return merge_segments(old.select(*cols).unionByName(new.select(*cols)), ["video_id", "label"], 0.0)


def _numbered(rows: DataFrame, order: list[str], t: str) -> DataFrame:
    """Rows with ``n``, their place in the video's list: by ``order``, counted in hours first so that a long feed is many tasks."""
    hour = F.floor(F.col(t) / 3600.0)
    if order[0] == "pos":  # given positions are kept in their order
        hour = F.floor(F.col("pos") / F.lit(1_000_000))
    counted = prefix_in_slices(rows, ["video_id"], F.lit(1).cast("long"), "sum", order, "n", hour)
    return counted.withColumn("n", F.col("n") - 1).withColumn("part", F.floor(F.col("n") / CHUNK))


def _text(c: str | Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
    return rows.groupBy("video_id", "part").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"]), ",").alias(name))


def _event_items(events: DataFrame) -> DataFrame:
    order = ["pos"] if "pos" in events.columns else ["start_sec", "end_sec", "label"]
    numbers = F.to_json(F.array("start_sec", "end_sec"))
    item = F.concat(F.substring(numbers, F.lit(1), F.char_length(numbers) - 1), F.lit(","), _text("label"), F.lit("]"))
    return _listed(_numbered(events, order, "start_sec"), item, "ev")


def _brackets(c: str) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.col(c), F.lit("")), F.lit("]"))


def prediction_documents(videos: DataFrame, events: DataFrame, risk: DataFrame, team: str) -> DataFrame:
    """One JSON document per video and part: {"team", "part", "videos": {name: {"events", "risk"}}}.

    Events are listed by ``pos`` where they have it, else by time. Videos without rows get empty lists.
    """
    ev = _event_items(events)
    rk = _listed(_numbered(risk, ["pos", "t"], "t"), F.to_json(F.array("t", "score")), "rk")
    first = videos.select("video_id", F.lit(0).cast("long").alias("part"))
    keys = first.unionByName(ev.select("video_id", "part")).unionByName(rk.select("video_id", "part")).distinct()
    d = keys.join(ev, ["video_id", "part"], "left").join(rk, ["video_id", "part"], "left")
    doc = F.concat(F.lit('{"team":'), _text(F.lit(team)), F.lit(',"part":'), F.col("part").cast("string"), F.lit(',"videos":{'),
                   _text("video_id"), F.lit(':{"events":'), _brackets("ev"), F.lit(',"risk":'), _brackets("rk"), F.lit("}}}"))
    return d.select("video_id", "part", doc.alias("value"))


def write_predictions(videos, events, risk, path: str, team: str = "unnamed") -> None:
    """Documents of all videos, one a line, for ``read_predictions``."""
    prediction_documents(videos, events, risk, team).select("value").write.mode("overwrite").text(path)


def write_events(events: DataFrame, path: str) -> None:
    """Event rows as JSON lines, one folder per video."""
    events.repartition("video_id").write.mode("overwrite").partitionBy("video_id").json(path)


def truth_documents(videos: DataFrame, events: DataFrame) -> DataFrame:
    """One truth document per video and part: {name: {"duration", "fps", "part", "events"}}."""
    ev = _event_items(events)
    first = videos.select("video_id", F.lit(0).cast("long").alias("part"))
    keys = first.unionByName(ev.select("video_id", "part")).distinct()
    d = keys.join(ev, ["video_id", "part"], "left").join(videos.select("video_id", "duration", "fps"), "video_id")
    doc = F.concat(F.lit("{"), _text("video_id"), F.lit(':{"duration":'), F.col("duration").cast("string"), F.lit(',"fps":'), F.col("fps").cast("string"),
                   F.lit(',"part":'), F.col("part").cast("string"), F.lit(',"events":'), _brackets("ev"), F.lit("}}"))
    return d.select("video_id", "part", doc.alias("value"))


def export_labels(videos: DataFrame, events: DataFrame, path: str) -> None:
    """Truth documents, one a line, for ``read_ground_truth`` and ``import_labels``."""
    truth_documents(videos, events).select("value").write.mode("overwrite").text(path)


def site_manifest(videos: DataFrame, events: DataFrame) -> DataFrame:
    """name, stem, duration and number of events per video."""
    n = events.groupBy("video_id").agg(F.count("*").alias("n_events"))
    return videos.join(n, "video_id", "left").select(
        F.col("video_id").alias("name"), F.regexp_replace("video_id", r"\.[^.]*$", "").alias("stem"), "duration",
        F.coalesce("n_events", F.lit(0)).alias("n_events"))


def thin_risk(risk: DataFrame, videos: DataFrame, hz: float = 5.0) -> DataFrame:
    """Risk curve at about ``hz`` points per second: every round(fps / hz)-th frame."""
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / hz, 0).cast("int"))
    v = videos.select("video_id", step.alias("_step"))
    return risk.join(v, "video_id").filter(F.col("pos") % F.col("_step") == 0).drop("_step")


def site_payload(videos: DataFrame, events: DataFrame, risk: DataFrame, points: DataFrame, minutes: int = 60) -> DataFrame:
    """Site JSON per video and hour of footage: events starting in it, thinned risk, trajectory points.

    The hour keeps each document bounded; clips shorter than that have one.
    """
    part = lambda t: F.floor(F.col(t) / (60.0 * minutes))
    ev = events.groupBy("video_id", part("start_sec").alias("part")).agg(F.sort_array(F.collect_list(F.struct("start_sec", "end_sec", "label"))).alias("events"))
    rk = (thin_risk(risk, videos).groupBy("video_id", part("t").alias("part"))
          .agg(F.sort_array(F.collect_list(F.struct("t", "score"))).alias("risk")))
    tr = (points.groupBy("video_id", part("t0").alias("part"), "track_id", "cls", "t0", F.floor(F.col("idx") / PART).alias("chunk"))
          .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "nx", "ny"))), lambda p: F.array(p["nx"], p["ny"])).alias("pts"))
          .groupBy("video_id", "part").agg(F.sort_array(F.collect_list(F.struct("track_id", "chunk", "cls", "t0", "pts"))).alias("trajectories")))
    keys = videos.select("video_id", F.lit(0).cast("long").alias("part"))
    for x in (ev, rk, tr):
        keys = keys.unionByName(x.select("video_id", "part"))
    d = keys.distinct()
    for x in (ev, rk, tr):
        d = d.join(x, ["video_id", "part"], "left")
    return d.select("video_id", "part", F.to_json(F.struct(F.col("video_id").alias("name"), "events", "risk", "trajectories")).alias("value"))

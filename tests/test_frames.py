"""Whole statistics of frames, and evaluation windows as a planner sees them."""
import pytest
from pyspark.sql import functions as F

from checks import more  # noqa: F401
from checks.registry import QUERIES, SQL
from lanewise.operators import cues as C


def test_frame_stats_hold_every_statistic_of_a_still(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(9).selectExpr("id AS s_suppkey", "CAST(id AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(250, 340).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST((id * 7919 + i * 104729) % 2000 / 1000 - 1 AS FLOAT)) AS embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("supplier", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(SQL["frame_stats"])
    cols = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = QUERIES["frame_stats"](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {"n_class", "brightness", "contrast", "signal", "registered", "lx0", "dx"} <= set(cols)
    # stills behind the last detection, and frames that are no stills
    assert any(r.zone is None and r.n == 0 and r.contrast > 0 for r in got) and any(r.brightness is None and r.n_class >= r.n > 0 for r in got)
    assert None in {r.signal for r in got} and len({r.signal for r in got}) > 2


def test_windows_of_cues_are_not_broadcast(spark):
    cues = spark.range(4000).select(F.lit("v").alias("video_id"), F.col("id").alias("cue_idx"), (F.col("id") * 500_000).alias("t_us"))
    times = C.eval_times(cues)
    plan = times._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    assert times.count() == 1952

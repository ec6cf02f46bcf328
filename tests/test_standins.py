"""The stand-ins of the checks as a planner sees them."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks import basic, rules, standins as S  # noqa: E402,F401
from checks.registry import QUERIES, SQL  # noqa: E402


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.fixture()
def folder(spark, tmp_path):
    spark.range(40).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_tracks_are_estimated_with_their_frames_and_dealt_out(spark, folder):
    rows = S.tracks(spark, folder)
    given = S.tables(spark, folder)("supplier")
    assert estimate(rows) >= S.FRAMES * estimate(given)
    assert rows.rdd.getNumPartitions() > given.rdd.getNumPartitions()
    assert rows.count() == rows.select("track_id", "frame_idx").distinct().count() > 40 * S.FRAMES * 0.8


def test_turning_tracks_are_estimated_with_their_frames(spark, folder):
    turns = spark.sql(rules.TURN.format(frames="{sup}"), sup=S.each_frame(spark, folder))
    assert estimate(turns) >= S.FRAMES * estimate(S.tables(spark, folder)("supplier"))


def test_average_precision_rounds_halves_as_its_sql(spark, tmp_path):
    """41 of 640 frames are positive: the rate ends in a half of the sixth digit, which a double's ROUND in the SQL took down."""
    duckdb = pytest.importorskip("duckdb")
    events = spark.range(640).selectExpr("id AS event_id", "0L AS user_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, IF(id < 41, 97, 50)) AS ts",
                                         "'view' AS event_type", "50e0 AS value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 0L AS o_orderkey, 0L AS o_custkey, DATE '1992-04-10' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(SQL["average_precision"])
    want = dict(zip([d[0] for d in cur.description], cur.fetchone()))
    got = QUERIES["average_precision"](spark, str(tmp_path)).first().asDict()
    assert got == want and got["positive_rate"] == 0.064063 and got["n_frames"] == 640


def test_average_precision_without_a_frame_to_score_as_its_sql(spark, tmp_path):
    """Every frame lies inside an accident: SQL's sums over no row are NULL."""
    duckdb = pytest.importorskip("duckdb")
    spark.range(5).selectExpr("id AS event_id", "0L AS user_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 97) AS ts",
                              "'view' AS event_type", "50e0 AS value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 0L AS o_orderkey, 0L AS o_custkey, DATE '1992-04-07' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(SQL["average_precision"])
    want = dict(zip([d[0] for d in cur.description], cur.fetchone()))
    got = QUERIES["average_precision"](spark, str(tmp_path)).first().asDict()
    assert got == want and got["n_frames"] is None and got["ap"] == 0.0

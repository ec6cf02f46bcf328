"""Time slices: windows over a long series without one task holding the series.

A series (one track, one camera, one signal head) is cut into slices of fixed
length and windows partition by (key, slice). Rows near a border are copied
into the neighbour slice, so a window that looks at most ``reach`` around a
row sees everything it needs; ``own`` marks the one copy that is kept. With an
hour per slice and seconds of reach the copies are well under one percent.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE_US = 3_600_000_000


def slice_rows(df: DataFrame, reach_us: int, slice_us: int = SLICE_US, t: str = "t_us") -> DataFrame:
    home = F.floor(F.col(t) / slice_us)
    lo = F.least(home, F.floor(F.greatest(F.lit(0), F.col(t) - reach_us) / slice_us))
    hi = F.floor((F.col(t) + reach_us) / slice_us)
    return (df.withColumn("slice", F.explode(F.sequence(lo, hi)))
            .withColumn("own", F.col("slice") == home))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("own").drop("own", "slice")


def lag_in_slices(df: DataFrame, keys: list[str], cols: dict[str, str], order: list[str],
                  t: str = "t_us", slice_us: int = SLICE_US) -> DataFrame:
    """Previous row's values over ``keys`` in ``order`` (whose first column is ``t``).

    Within a slice it is a plain ``lag``; the first row of a slice takes the
    last row of the previous non-empty one from a small per-slice table.
    """
    sliced = df.withColumn("slice", F.floor(F.col(t) / slice_us))
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    value = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    body = sliced.withColumn("_in", F.lag(value).over(w))
    rank = F.struct(*[F.col(o) for o in order])
    tails = (sliced.groupBy(*keys, "slice").agg(F.max_by(value, rank).alias("_tail"))
             .withColumn("_before", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("slice")))
             .drop("_tail").filter("_before is not null"))
    joined = body.join(tails, [*keys, "slice"], "left")
    prev = F.coalesce(F.col("_in"), F.col("_before"))
    return joined.select(*df.columns, *[prev[n].alias(n) for n in cols])


def neighbours_in_slices(df: DataFrame, keys: list[str], cols: list[str], lows: list[str] = (),
                         t: str = "t_us", slice_us: int = SLICE_US) -> DataFrame:
    """``_prev`` and ``_next``: ``t`` and ``cols`` of the rows before and after over ``keys``, and ``_low_x``: the least ``x`` of all rows before.

    Plain windows inside a slice; what lies beyond its borders comes from a table with a row per slice. ``t`` is unique per key.
    """
    sliced = df.withColumn("slice", F.floor(F.col(t) / slice_us))
    w = Window.partitionBy(*keys, "slice").orderBy(t)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(t, *cols)
    body = sliced.withColumns({"_prev": F.lag(row).over(w), "_next": F.lead(row).over(w)} | {f"_low_{c}": F.min(c).over(earlier) for c in lows})
    by_slice = Window.partitionBy(*keys).orderBy("slice")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    ends = (sliced.groupBy(*keys, "slice").agg(F.min(row).alias("_head"), F.max(row).alias("_tail"), *[F.min(c).alias(f"_least_{c}") for c in lows])
            .select(*keys, "slice", F.lag("_tail").over(by_slice).alias("_before"), F.lead("_head").over(by_slice).alias("_after"),
                    *[F.min(f"_least_{c}").over(before).alias(f"_below_{c}") for c in lows]))
    joined = body.join(ends, [*keys, "slice"])
    return joined.select(*df.columns, F.coalesce("_prev", "_before").alias("_prev"), F.coalesce("_next", "_after").alias("_next"),
                         *[F.least(f"_low_{c}", f"_below_{c}").alias(f"_low_{c}") for c in lows])


def prefix_in_slices(df: DataFrame, keys: list[str], value: Column, how: str, order: list[str],
                     name: str, slice_expr: Column) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` in two levels: inside a slice, plus the totals before it."""
    agg = {"sum": F.sum, "max": F.max}[how]
    sliced = df.withColumn("_v", value).withColumn("slice", slice_expr)
    w = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (sliced.groupBy(*keys, "slice").agg(agg("_v").alias("_tot"))
              .withColumn("_base", agg("_tot").over(before)).drop("_tot"))
    run = sliced.withColumn("_run", agg("_v").over(w)).join(totals, [*keys, "slice"], "left")
    out = (F.coalesce(F.col("_run"), F.lit(0)) + F.coalesce(F.col("_base"), F.lit(0)) if how == "sum"
           else F.greatest("_run", "_base"))
    return run.select(*df.columns, out.alias(name))


def running_sums(df: DataFrame, keys: list[str], values: dict[str, Column], order: list[str], slice_expr: Column) -> DataFrame:
    """Inclusive running sums of several values at once, in two levels like ``prefix_in_slices``."""
    sliced = df.withColumns({f"_v_{n}": c for n, c in values.items()}).withColumn("slice", slice_expr)
    w = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    base = totals.select(*keys, "slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    run = sliced.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(w) for n in values}).join(base, [*keys, "slice"])
    return run.select(*df.columns, *[(F.col(f"_v_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])

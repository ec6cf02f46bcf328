"""Exact medians for groups of any size."""
from pyspark.sql import DataFrame, Window, functions as F

HOT = 1_000_000


def exact_median(df: DataFrame, keys: list[str], value: str, n: str | None = None,
                 width: float = 1.0, hot: int = HOT) -> DataFrame:
    """``median`` per group. Groups over ``hot`` rows (column ``n`` tells) are never held in one buffer:
    a histogram with partial sums finds the bins holding the middle ranks, and only those bins are ranked.
    """
    if n is None:
        return df.groupBy(*keys).agg(F.median(value).alias("median"))
    small = df.filter(F.col(n) <= hot).groupBy(*keys).agg(F.median(value).alias("median"))
    return small.unionByName(_by_bins(df.filter(F.col(n) > hot), keys, value, width))


def _by_bins(df, keys, value, width):
    rows = df.select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bin"))
    counts = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    cum = F.sum("_n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = (counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_before", cum - F.col("_n"))
            .withColumn("_lo", F.floor((F.col("_all") + 1) / 2)).withColumn("_hi", F.floor(F.col("_all") / 2) + 1)
            .filter(((F.col("_lo") > F.col("_before")) & (F.col("_lo") <= F.col("_before") + F.col("_n")))
                    | ((F.col("_hi") > F.col("_before")) & (F.col("_hi") <= F.col("_before") + F.col("_n")))))
    # equal values collapse first, so a constant series stays one row
    tied = (rows.join(bins.select(*keys, "_bin", "_before", "_lo", "_hi"), [*keys, "_bin"])
            .groupBy(*keys, "_bin", "_before", "_lo", "_hi", "_v").agg(F.count("*").alias("_c")))
    up = F.col("_before") + F.sum("_c").over(
        Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = tied.withColumn("_up", up).withColumn("_low", F.col("_up") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col(r) > F.col("_low")) & (F.col(r) <= F.col("_up")), F.col("_v")))
    return ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias("median"))

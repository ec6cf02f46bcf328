"""Irregular-sampling time-series expressions over a (key, slice) window.

All take ``by``, the partition columns of the window, and order by the exact
integer time ``t_us``. Rows must be unique per time and key.
"""
import math

from pyspark.sql import Column, Window, functions as F

US = 1_000_000


def win(by: list[str]):
    return Window.partitionBy(*by).orderBy("t_us")


def us(seconds: float) -> int:
    return int(round(seconds * US))


def gaussian_smooth(cols: list[str], sigma: float, by: list[str], n: Column | None = None) -> Column:
    """struct of smoothed ``cols``: Gaussian weights over +-3 sigma; series under 3 samples stay as they are."""
    w = win(by).rangeBetween(-us(3 * sigma), us(3 * sigma))
    near = F.collect_list(F.struct("t_us", *cols)).over(w)
    start = F.struct(*[F.lit(0.0).alias(c) for c in ["w", *cols]])

    def add(acc, r):
        d = (r["t_us"] - F.col("t_us")).cast("double") / F.lit(float(US) * sigma)
        g = F.exp(F.lit(-0.5) * d * d)
        return F.struct((acc["w"] + g).alias("w"), *[(acc[c] + g * r[c]).alias(c) for c in cols])

    out = F.aggregate(near, start, add, lambda acc: F.struct(*[(acc[c] / acc["w"]).alias(c) for c in cols]))
    if n is None:
        return out
    return F.when(n < 3, F.struct(*[F.col(c).cast("double").alias(c) for c in cols])).otherwise(out)


def _ends(x: str, half: float, by):
    """Values at both ends of +-half seconds, each side at least one neighbour wide."""
    w = win(by)
    r = w.rangeBetween(-us(half), us(half))
    pair = F.struct(F.col("t_us").alias("t"), F.col(x).alias("x"))
    lo, hi = F.first(pair).over(r), F.last(pair).over(r)
    prev, nxt = F.lag(pair).over(w), F.lead(pair).over(w)
    t = F.col("t_us")
    return (F.when(lo["t"] == t, F.coalesce(prev, lo)).otherwise(lo),
            F.when(hi["t"] == t, F.coalesce(nxt, hi)).otherwise(hi))


def derivative(x: str, half: float, by: list[str]) -> Column:
    """Central difference over +-half seconds, clipped at the ends; 0 for a lone sample."""
    lo, hi = _ends(x, half, by)
    return F.coalesce(F.try_divide(hi["x"] - lo["x"], F.nullif(hi["t"] - lo["t"], F.lit(0)) / F.lit(float(US))), F.lit(0.0))


def gradient(x: Column, by: list[str]) -> Column:
    """Second-order difference on uneven steps, one-sided at the ends."""
    w = win(by)
    t = F.col("t_us").cast("double") / US
    return _slope(x, t - F.lag(t).over(w), F.lead(t).over(w) - t, F.lag(x).over(w), F.lead(x).over(w))


def gradient_between(x: str) -> Column:
    """``gradient`` of column ``x`` from the structs ``_prev`` and ``_next`` of its neighbours."""
    t = F.col("t_us").cast("double") / US
    return _slope(F.col(x), t - F.col("_prev.t_us") / US, F.col("_next.t_us") / US - t, F.col(f"_prev.{x}"), F.col(f"_next.{x}"))


def _slope(x: Column, hs: Column, hd: Column, xp: Column, xn: Column) -> Column:
    mid = (hs * hs * xn + (hd * hd - hs * hs) * x - hd * hd * xp) / (hs * hd * (hd + hs))
    return (F.when(hs.isNull() & hd.isNull(), F.lit(0.0)).when(hs.isNull(), (xn - x) / hd)
            .when(hd.isNull(), (x - xp) / hs).otherwise(mid))


def turn_fix(a: Column, prev: Column) -> Column:
    """Correction that keeps the step prev -> a inside (-pi, pi]; its running sum unwraps a heading."""
    d = a - prev
    m = F.pmod(d + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)
    m = F.when((m == F.lit(-math.pi)) & (d > 0), F.lit(math.pi)).otherwise(m)
    return F.when(prev.isNull() | (F.abs(d) < F.lit(math.pi)), F.lit(0.0)).otherwise(m - d)


def range_median(x: str, lo: float, hi: float, by: list[str]) -> Column:
    """Median of ``x`` over the samples within [t+lo, t+hi] seconds; NULL when there are none."""
    a = F.array_sort(F.collect_list(x).over(win(by).rangeBetween(us(lo), us(hi))))
    n = F.size(a)
    mid = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0
    return F.when(n > 0, mid)


def over_range(agg: Column, lo: float, hi: float, by: list[str]) -> Column:
    return agg.over(win(by).rangeBetween(us(lo), us(hi)))

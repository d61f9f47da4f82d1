"""Data-driven thresholds and shape checks over a whole point set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def valley_threshold(df: DataFrame, value: str, bins: int = 40, low: float = 0.02, high: float = 0.7) -> DataFrame:
    """One row (n, threshold): the emptiest bin between the two tallest peaks of the smoothed histogram of [0, 1].

    Fewer than 20 values, or fewer than two peaks of at least 5 % of the tallest bin, give the 20th
    percentile. The rows are reduced to `bins` counts before anything is compared.
    """
    v = df.select(c(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    inside = v.where("v >= 0 and v <= 1")
    hist = inside.groupBy(F.least(F.floor(c("v") * bins), F.lit(bins - 1)).cast("int").alias("b")).count()
    grid = df.sparkSession.range(bins).select(c("id").cast("int").alias("b"))
    w = W.orderBy("b")  # `bins` rows
    h = grid.join(F.broadcast(hist), "b", "left").select("b", F.coalesce("count", F.lit(0)).cast("double").alias("n"))
    h = h.withColumn("s", F.coalesce(F.lag("n").over(w), F.lit(0.0)) * 0.25 + c("n") * 0.5 + F.coalesce(F.lead("n").over(w), F.lit(0.0)) * 0.25)
    top = F.max("s").over(W.partitionBy())
    peak = c("b").between(1, bins - 2) & (c("s") > F.lag("s").over(w)) & (c("s") > F.lead("s").over(w)) & (c("s") >= top * 0.05)
    h = h.withColumn("peak", F.coalesce(peak, F.lit(False)))
    h = h.withColumn("rank", F.when(c("peak"), F.row_number().over(W.partitionBy("peak").orderBy(c("s").desc(), "b"))))
    ends = h.agg(F.min(F.when(c("rank") <= 2, c("b"))).alias("p1"), F.max(F.when(c("rank") <= 2, c("b"))).alias("p2"), F.count(F.when(c("peak"), 1)).alias("n_peaks"))
    between = h.crossJoin(F.broadcast(ends)).where(c("b").between(c("p1"), c("p2")))
    best = between.agg(F.min_by("b", F.struct("s", "b")).alias("valley"), F.max("n_peaks").alias("n_peaks"))
    stats = v.agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.2)).alias("p20"))
    centre = (c("valley").cast("double") + 0.5) / float(bins)
    valley = F.greatest(F.lit(low), F.least(F.lit(high), centre))
    return stats.crossJoin(F.broadcast(best)).select("n", F.when((c("n") >= 20) & (c("n_peaks") >= 2), valley).otherwise(F.coalesce("p20", F.lit(0.0))).alias("threshold"))


def frustum_fits(points: DataFrame, bands: int = 12, half_width: float = 0.015, clip: float = 2.0, least: int = 40) -> DataFrame:
    """A linear fit of cross-section against distance for each axis, apex end and cross axis.

    (axis, apex_at_max, cross_axis, n_bands, slope, intercept, r2, span, score). A point lies in at
    most a few bands, and its bands follow from its coordinate by arithmetic, so nothing is joined.
    """
    names = ["x", "y", "z"]
    ext = points.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    p = points.select(*names).crossJoin(F.broadcast(ext))  # one row
    rows = []
    for a, n in enumerate(names):
        o = [m for m in names if m != n]
        rows.append(F.struct(F.lit(a).alias("axis"), F.try_divide(c(n) - c(f"lo_{n}"), c(f"hi_{n}") - c(f"lo_{n}")).alias("u"), (c(f"hi_{n}") - c(f"lo_{n}")).alias("span"), c(o[0]).alias("v0"), c(o[1]).alias("v1")))
    long = p.select(F.inline(F.array(*rows)))
    step = 0.8 / (bands - 1)
    near = F.round((c("u") - 0.1) / step).cast("int")
    # bands are symmetric, so the one at fraction f from the maximum is that at 1 - f from the minimum
    long = long.withColumn("band", near).where(c("band").between(0, bands - 1) & (F.abs(c("u") - (F.lit(0.1) + c("band") * step)) < half_width))
    lo, hi = clip / 100.0, 1 - clip / 100.0

    def half_spread(v: str):
        return (F.percentile(v, F.lit(hi)) - F.percentile(v, F.lit(lo))) / 2.0

    b = long.groupBy("axis", "band").agg(F.count(F.lit(1)).alias("n"), F.max("span").alias("span"), half_spread("v0").alias("w0"), half_spread("v1").alias("w1")).where(c("n") >= least)
    f = F.lit(0.1) + c("band") * step
    sides = F.array(F.struct(F.lit(False).alias("apex_at_max"), f.alias("frac")), F.struct(F.lit(True).alias("apex_at_max"), (F.lit(1.0) - f).alias("frac")))
    b = b.select("axis", "span", "w0", "w1", F.inline(sides)).withColumn("d", c("frac") * c("span"))
    b = b.select("axis", "span", "apex_at_max", "d", F.inline(F.array(F.struct(F.lit(0).alias("cross_axis"), c("w0").alias("w")), F.struct(F.lit(1).alias("cross_axis"), c("w1").alias("w")))))
    g = b.groupBy("axis", "apex_at_max", "cross_axis").agg(
        F.count(F.lit(1)).alias("n_bands"), F.regr_slope("w", "d").alias("slope"), F.regr_intercept("w", "d").alias("intercept"), F.regr_r2("w", "d").alias("r2"), F.max("span").alias("span")
    )
    g = g.where(c("n_bands") >= 5)
    return g.withColumn("score", c("r2") - F.abs("intercept") / F.greatest("span", F.lit(1e-9)))


def frustum_verdict(points: DataFrame, hfov: float | None = None, r2: float = 0.95, intercept: float = 0.08, fov_tol: float = 8.0) -> DataFrame:
    """One row: whether the cloud has the shape of a viewing volume, with the best fit's figures."""
    fits = frustum_fits(points)
    pair = fits.groupBy("axis", "apex_at_max").agg(F.max(F.degrees(F.atan(F.abs("slope"))) * 2).alias("wide"), F.min(F.degrees(F.atan(F.abs("slope"))) * 2).alias("narrow"))
    best = fits.where("slope > 0").agg(F.max_by(F.struct("axis", "apex_at_max", "r2", "intercept", "span"), F.struct("score", -c("axis"), -c("cross_axis"))).alias("b"))
    x = best.select("b.*").join(F.broadcast(pair), ["axis", "apex_at_max"], "left")
    n = points.agg(F.count(F.lit(1)).alias("n"))
    rel = F.abs("intercept") / F.greatest("span", F.lit(1e-9))
    conical = (c("r2") >= r2) & (rel <= intercept)
    if hfov is not None:
        conical = conical & (F.least(F.abs(c("wide") - hfov), F.abs(c("narrow") - hfov)) <= fov_tol)
    return n.crossJoin(F.broadcast(x)).select("n", F.coalesce((c("n") >= 200) & conical, F.lit(False)).alias("is_frustum"), "axis", "apex_at_max", "r2", rel.alias("intercept_rel"), "wide", "narrow")

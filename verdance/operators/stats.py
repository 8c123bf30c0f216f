"""Ranks, correlation, regression, bins and adjustments as DataFrame plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    order = W.partitionBy(*by).orderBy(x)
    return F.rank().over(order) + (F.count("*").over(W.partitionBy(*by, x)) - 1) / F.lit(2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's, as an aggregate; NaN where x or y does not vary."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(float("nan")))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """(by, n_units, rho); rows with a null in x or y are left out, groups below ``least`` too.

    A group where x or y is the same throughout has a rho of NaN."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = clean.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n_units"), F.round(correlation("_rx", "_ry"), 6).alias("rho")).where(F.col("n_units") >= least)


def two_sided_p(rho: float | None, n: int) -> float | None:
    """p of a correlation by Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    dof = n - 2
    t2 = rho * rho * dof / (1 - rho * rho)
    return _incomplete_beta(dof / (dof + t2), dof / 2, 0.5)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def adjusted(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds ``p_adj``: false-discovery step-up; null p stay null and do not count."""
    valid = df.where(F.col(p).isNotNull())
    n, order = F.count("*").over(W.partitionBy(*by)), W.partitionBy(*by).orderBy(F.col(p))
    scaled = valid.withColumn("_s", F.col(p) * n / F.row_number().over(order))
    back = W.partitionBy(*by).orderBy(F.col(p).desc(), F.col("_s")).rowsBetween(W.unboundedPreceding, 0)
    done = scaled.withColumn("p_adj", F.least(F.lit(1.0), F.min("_s").over(back))).drop("_s")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))


def quantile_class(df: DataFrame, x: str, cuts: list[float], by: list[str], name: str) -> DataFrame:
    """Adds 1 for x up to the first cut, and so on; ties fall together; null stays null."""
    breaks = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, cuts))).alias("_b"))
    joined = df.join(breaks, by) if by else df.crossJoin(F.broadcast(breaks))
    level = F.lit(len(cuts) + 1)
    for k in reversed(range(len(cuts))):
        level = F.when(F.col(x) <= F.round(F.col("_b")[k], 9), k + 1).otherwise(level)
    return joined.withColumn(name, F.when(F.col(x).isNotNull(), level)).drop("_b")


def two_predictor_ols(df: DataFrame, y: str, x: str, m: str, by: list[str]) -> DataFrame:
    """(by, n, bx, bm): slopes of y on x and m with a constant, from second moments."""
    agg = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.var_samp(x).alias("xx"), F.var_samp(m).alias("mm"), F.covar_samp(x, m).alias("xm"),
        F.covar_samp(x, y).alias("xy"), F.covar_samp(m, y).alias("my"),
    )
    det = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    return agg.select(
        *by, "n",
        ((F.col("xy") * F.col("mm") - F.col("my") * F.col("xm")) / F.nullif(det, F.lit(0.0))).alias("bx"),
        ((F.col("my") * F.col("xx") - F.col("xy") * F.col("xm")) / F.nullif(det, F.lit(0.0))).alias("bm"),
        (F.col("xm") / F.nullif(F.col("xx"), F.lit(0.0))).alias("a"),
        (F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))).alias("total"),
    )


def kde(df: DataFrame, x: str, by: list[str], lo: float, hi: float, points: int) -> DataFrame:
    """(by, i, grid, density): Gaussian kernels, bandwidth n^(-1/5) times the sample deviation."""
    spread = df.groupBy(*by).agg((F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp(x)).alias("h"), F.count("*").alias("n"))
    step = (hi - lo) / (points - 1)
    counted = df.groupBy(*by, x).agg(F.count("*").alias("w")).join(spread.where("h > 0"), by)
    grid = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("grid", lo + F.col("i") * step)
    u = (F.col("grid") - F.col(x)) / F.col("h")
    kernel = F.col("w") * F.exp(-0.5 * u * u)
    return grid.groupBy(*by, "i", "grid").agg((F.sum(kernel) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))

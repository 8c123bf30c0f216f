"""Bootstrap and mediation from second moments.

A replicate is a set of weights: each row counts Poisson(1) times, by a hash of
the seed, the row's key and the replicate.  So a row needs nothing but itself:
a task multiplies the weights of a batch of rows into the sums of all replicates
at once, and hands on one row for each group and replicate it has met.  No row
is copied, sorted or numbered, and any partitioning draws the same weights.
(Replicates differ in size by the square root of n; slopes and intercepts do not
depend on it.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights that a task works out at once.
CHUNK = 1_000_000
#: Poisson(1) by a uniform hash of 64 bits: where each count begins.
_STEPS = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(18)])
POISSON = np.minimum(_STEPS * 2.0**64, 2.0**64 - 4096).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(row_hash: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates) of Poisson(1) counts."""
    of = mixed(np.arange(1, replicates + 1, dtype=np.uint64))
    return np.searchsorted(POISSON, mixed(row_hash.view(np.uint64)[:, None] ^ of), side="right").astype(np.float64)


def replicate_moments(df: DataFrame, columns: list[str], by: list[str], key: str, replicates: int, seed: int = 7) -> DataFrame:
    """(by, rep, w, s_<c>, s_<c>_<d>): weighted sums of the columns and of their products.

    ``columns`` should be centred, or nearly, so that products lose nothing.
    Rows with a null in one of them are left out.  ``key`` is unique; rows with
    equal keys get equal weights."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    names = ["w", *(f"s_{c}" for c in columns), *(f"s_{columns[i]}_{columns[j]}" for i, j in pairs)]
    clean = df.dropna(subset=columns).select(*by, F.xxhash64(F.lit(seed), key).alias("_h"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    schema = T.StructType([*clean.select(*by).schema.fields, T.StructField("rep", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        step = max(1, CHUNK // replicates)
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for k, g in enumerate(zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * batch.num_rows):
                groups.setdefault(g, []).append(k)
            hashes = batch.column("_h").to_numpy()
            values = np.stack([batch.column(f"_{c}").to_numpy() for c in columns], 1)
            for g, rows in groups.items():
                for k in range(0, len(rows), step):
                    at = rows[k : k + step]
                    v = values[at]
                    full = np.concatenate([np.ones((len(at), 1)), v, np.stack([v[:, i] * v[:, j] for i, j in pairs], 1)], 1)
                    part = weights(hashes[at], replicates).T @ full
                    sums[g] = sums[g] + part if g in sums else part
        for g, part in sums.items():
            fixed = [pa.array([v] * replicates, batch.schema.field(c).type) for c, v in zip(by, g)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], [f.name for f in schema.fields])

    return clean.mapInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def _centred(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``df`` with the columns less their group's mean, and the means as mean_<c>."""
    means = df.dropna(subset=columns).groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    joined = df.join(means, by) if by else df.crossJoin(means)  # one row
    return joined.select(*[c for c in df.columns if c not in columns], *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in columns], *[f"mean_{c}" for c in columns])


def bootstrap_lines(df: DataFrame, x: str, y: str, key: str, replicates: int, by: list[str] | None = None, seed: int = 7) -> DataFrame:
    """(by, rep, slope, intercept) of the regression of y on x; null where x does not vary."""
    by = by or []
    # one mean each, as two columns that ride along, so that sums can be turned back
    centred = _centred(df.dropna(subset=[x, y]).select(*by, key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), ["x", "y"], by)
    means = centred.groupBy(*by).agg(F.first("mean_x").alias("mean_x"), F.first("mean_y").alias("mean_y"))
    m = replicate_moments(centred, ["x", "y"], by, key, replicates, seed)
    xx, xy = F.col("w") * F.col("s_x_x") - F.col("s_x") * F.col("s_x"), F.col("w") * F.col("s_x_y") - F.col("s_x") * F.col("s_y")
    lines = m.withColumn("slope", xy / F.nullif(xx, F.lit(0.0)))
    lines = lines.join(means, by) if by else lines.crossJoin(means)  # one row
    own = (F.col("s_y") - F.col("slope") * F.col("s_x")) / F.nullif("w", F.lit(0.0))
    return lines.select(*by, "rep", "slope", (own + F.col("mean_y") - F.col("slope") * F.col("mean_x")).alias("intercept"))


def _interval(c: Column) -> Column:
    return F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))


def bootstrap_slope(df: DataFrame, x: str, y: str, key: str, replicates: int, by: list[str] | None = None, seed: int = 7) -> DataFrame:
    """(by, slope_lo, slope_hi): percentile interval of the slope."""
    cut = bootstrap_lines(df, x, y, key, replicates, by, seed).groupBy(*(by or [])).agg(_interval(F.col("slope")).alias("q"))
    return cut.select(*(by or []), F.col("q")[0].alias("slope_lo"), F.col("q")[1].alias("slope_hi"))


def bootstrap_band(df: DataFrame, x: str, y: str, key: str, replicates: int, by: list[str] | None = None, points: int = 100, seed: int = 7) -> DataFrame:
    """(by, i, gx, fit_lo, fit_hi): pointwise percentile interval of the line on an even grid over x."""
    by = by or []
    ends = df.dropna(subset=[x, y]).groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    gx = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / float(points - 1)
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*by, "i", gx.alias("gx"))
    lines = bootstrap_lines(df, x, y, key, replicates, by, seed)
    lines = lines.join(grid, by) if by else lines.crossJoin(grid)  # ``points`` rows
    cut = lines.groupBy(*by, "i", "gx").agg(_interval(F.col("intercept") + F.col("slope") * F.col("gx")).alias("q"))
    return cut.select(*by, "i", "gx", F.col("q")[0].alias("fit_lo"), F.col("q")[1].alias("fit_hi"))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the closed sum.

    Null below one degree; the sum has half as many terms as degrees."""
    theta, c2 = F.atan(F.abs(t) / F.sqrt(dof)), dof / (dof + t * t)
    odd = dof % 2 == 1
    last = F.when(odd, (dof - 3) / 2).otherwise(dof / 2 - 1).cast("int")

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * c2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), one, step)["total"]
    series = F.when(dof == 1, 0.0).otherwise(series)
    inner = F.when(odd, 2 / np.pi * (theta + F.sin(theta) * F.cos(theta) * series)).otherwise(F.sin(theta) * series)
    return F.when(dof >= 1, F.greatest(1 - inner, F.lit(0.0)))


def student_p_sql(t: str, dof: str) -> str:
    """``student_p`` as SQL text, for the twin: coefficients from the gamma function."""
    theta, c2 = f"atan(abs({t})/sqrt({dof}))", f"({dof}/({dof}+{t}*{t}))"
    even = f"list_sum(list_transform(range(CAST({dof}//2 AS BIGINT)), lambda k: exp(lgamma(k+0.5E0)-lgamma(0.5E0)-lgamma(k+1))*pow({c2},k)))"
    odd = f"coalesce(list_sum(list_transform(range(CAST(({dof}-1)//2 AS BIGINT)), lambda k: exp(lgamma(k+1)-lgamma(k+1.5E0)+lgamma(1.5E0))*pow({c2},k))),0.0E0)"
    return f"CASE WHEN {dof}>=1 THEN greatest(0.0E0, 1-CASE WHEN {dof} % 2=1 THEN 2/pi()*({theta}+sin({theta})*cos({theta})*{odd}) ELSE sin({theta})*{even} END) END"


def path_models(df: DataFrame, x: str, m: str, y: str, by: list[str], absorb: str | None = None) -> DataFrame:
    """(by, n, a, p_a, b, p_b, c_prime, p_c_prime, total, p_total, indirect, proportion).

    Least squares with a constant: m on x (a), y on x (total), y on x and m
    (c_prime and b).  With ``absorb`` each of its values has a constant of its
    own, by taking all columns from their means there.  p by Student's t; null
    without degrees of freedom or where x or m do not vary.  Rows with a null go."""
    clean = df.dropna(subset=[x, m, y]).select(*by, *([absorb] if absorb else []), *[F.col(c).cast("double").alias(n) for c, n in zip((x, m, y), "xmy")])
    centred = _centred(clean, ["x", "m", "y"], [*by, *([absorb] if absorb else [])])
    sums = [F.sum(F.col(c) * F.col(d)).alias(c + d) for c, d in ("xx", "mm", "yy", "xm", "xy", "my")]
    s = centred.groupBy(*by).agg(F.count("*").alias("n"), *sums, *([F.countDistinct(absorb).alias("g")] if absorb else [F.lit(1).cast("long").alias("g")]))
    xx, mm, yy, xm, xy, my, n, g = (F.col(c) for c in ("xx", "mm", "yy", "xm", "xy", "my", "n", "g"))
    none = F.lit(0.0)
    det = F.nullif(xx * mm - xm * xm, none)
    s = s.select(*by, "n", "g", "xx", "mm", "yy", "xm", "xy", "my", det.alias("det"), (xm / F.nullif(xx, none)).alias("a"), (xy / F.nullif(xx, none)).alias("total"), ((xy * mm - my * xm) / det).alias("c_prime"), ((my * xx - xy * xm) / det).alias("b"))

    def p(value: str, rest: Column, dof: Column, spread: Column) -> Column:
        t = F.col(value) / F.sqrt(F.nullif(F.greatest(rest, none) / F.nullif(dof, F.lit(0)) * spread, none))
        return F.when(dof >= 1, student_p(t, dof)).alias(f"p_{value}")

    rest = yy - F.col("c_prime") * xy - F.col("b") * my
    one, two = n - g - 1, n - g - 2
    return s.select(
        *by, "n", "a", p("a", mm - F.col("a") * xm, one, 1 / xx), "b", p("b", rest, two, xx / F.col("det")), "c_prime", p("c_prime", rest, two, mm / F.col("det")),
        "total", p("total", yy - F.col("total") * xy, one, 1 / xx), (F.col("a") * F.col("b")).alias("indirect"), (F.col("a") * F.col("b") / F.nullif("total", none)).alias("proportion"),
    )


def indirect_interval(df: DataFrame, x: str, m: str, y: str, key: str, by: list[str], replicates: int = 5000, seed: int = 7) -> DataFrame:
    """(by, indirect_lo, indirect_hi, significant): percentile interval of a * b; significant if it leaves out 0."""
    clean = df.dropna(subset=[x, m, y]).select(*by, key, *[F.col(c).cast("double").alias(n) for c, n in zip((x, m, y), "xmy")])
    r = replicate_moments(_centred(clean, ["x", "m", "y"], by), ["x", "m", "y"], by, key, replicates, seed)
    s = {c + d: F.col("w") * F.col(f"s_{c}_{d}") - F.col(f"s_{c}") * F.col(f"s_{d}") for c, d in ("xx", "xm", "xy", "mm", "my")}
    a = s["xm"] / F.nullif(s["xx"], F.lit(0.0))
    b = (s["my"] * s["xx"] - s["xy"] * s["xm"]) / F.nullif(s["xx"] * s["mm"] - s["xm"] * s["xm"], F.lit(0.0))
    cut = r.groupBy(*by).agg(_interval(a * b).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return cut.select(*by, lo.alias("indirect_lo"), hi.alias("indirect_hi"), (lo * hi > 0).alias("significant"))

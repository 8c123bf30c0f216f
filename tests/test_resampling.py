"""Bootstrap by weights and mediation against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import resampling as B
from verdance.operators import stats as T


def table(spark, rng, groups=(60, 9), extra=()):
    rows = []
    for g, n in enumerate(groups):
        x = rng.normal(50_000 + g, 3, n)
        m = 0.5 * x + rng.normal(0, 2, n)
        y = 0.2 * x - 0.7 * m + rng.normal(0, 1, n)
        rows += [(f"c{g}", len(rows) + k, float(x[k]), float(m[k]), float(y[k])) for k in range(n)]
    rows += [(g, 10**6 + k, *v) for k, (g, v) in enumerate(extra)]
    return rows, spark.createDataFrame(rows, "city string, id long, x double, m double, y double").repartition(5)


EXTRA = [("c0", (None, 1.0, 1.0)), ("c0", (1.0, 1.0, None)), ("flat", (2.0, 1.0, 1.0)), ("flat", (2.0, 3.0, 2.0)), ("one", (1.0, 2.0, 3.0))]


def drawn(spark, rows, replicates, seed=7):
    """The weights of each row, from its key alone."""
    ids = spark.createDataFrame([(r[1],) for r in rows], "id long").select("id", F.xxhash64(F.lit(seed), "id").alias("h")).collect()
    return {r["id"]: B.weights(np.array([r["h"]]), replicates)[0] for r in ids}


def lines(rows, w, replicates):
    fits = []
    for b in range(replicates):
        x, y, n = np.array([(r[2], r[4], w[r[1]][b]) for r in rows]).T
        at = np.repeat(np.arange(len(x)), n.astype(int))
        fits.append(np.polyfit(x[at] - x.mean(), y[at], 1))
    return np.array(fits), np.mean([r[2] for r in rows])


def test_band_equals_numpy_on_the_same_weights(spark):
    rows, df = table(spark, np.random.default_rng(0), extra=EXTRA)
    own = [r for r in rows if r[0] == "c0" and None not in (r[2], r[4])]
    fits, mean = lines(own, drawn(spark, rows, 200), 200)
    got = {r["i"]: r for r in B.bootstrap_band(df, "x", "y", "id", 200, ["city"], points=11).where("city = 'c0'").collect()}
    for i, gx in enumerate(np.linspace(min(r[2] for r in own), max(r[2] for r in own), 11)):
        lo, hi = np.percentile(fits[:, 1] + fits[:, 0] * (gx - mean), [2.5, 97.5])
        assert (got[i]["gx"], got[i]["fit_lo"], got[i]["fit_hi"]) == pytest.approx((gx, lo, hi), rel=1e-6)
    slope = B.bootstrap_slope(df.where("city = 'c0'"), "x", "y", "id", 200).first()
    assert tuple(slope) == pytest.approx(tuple(np.percentile(fits[:, 0], [2.5, 97.5])), rel=1e-6)


def test_groups_without_spread(spark):
    _, df = table(spark, np.random.default_rng(0), extra=EXTRA)
    got = {r["city"]: r["slope_lo"] for r in B.bootstrap_slope(df, "x", "y", "id", 50, ["city"]).collect()}
    assert got["flat"] is None and got["one"] is None and got["c1"] is not None
    assert B.bootstrap_slope(df.limit(0), "x", "y", "id", 50, ["city"]).count() == 0


def test_weights_are_poisson():
    rng = np.random.default_rng(3)
    w = B.weights(rng.integers(-(2**63), 2**63 - 1, 3000), 300)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and np.abs(np.corrcoef(w[:8])[np.triu_indices(8, 1)]).max() < 0.25


def test_many_rows_stay_spread(spark):
    """No stage of one task over the rows, and what is shuffled does not grow with them."""
    n = 400_000
    df = spark.range(0, n, 1, 8).select("id", (F.col("id") % 1009).cast("double").alias("x"), ((F.col("id") * 17) % 499 + F.col("id") % 1009).cast("double").alias("y"))
    moments = B.replicate_moments(df.select("id", (F.col("x") - 504).alias("x"), (F.col("y") - 753).alias("y")), ["x", "y"], [], "id", 20)
    plan = moments._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate" not in plan and "SinglePartition" not in plan
    w = moments.collect()
    assert len(w) == 20 and all(abs(r["w"] / n - 1) < 0.02 for r in w)
    lo, hi = B.bootstrap_slope(df, "x", "y", "id", 20).first()
    assert 0.97 < lo < hi < 1.03


@pytest.mark.parametrize("dof", [1, 2, 3, 4, 5, 10, 25, 998, 4001])
def test_student_p(spark, dof):
    values = [0.0, 0.3, 1.0, 2.2, 5.0, -1.7]
    rows = spark.createDataFrame([(v,) for v in values], "t double").select("t", B.student_p(F.col("t"), F.lit(dof)).alias("p")).collect()
    for r in rows:
        rho = r["t"] / np.sqrt(dof + r["t"] ** 2)
        assert r["p"] == pytest.approx(T.two_sided_p(float(rho), dof + 2), abs=1e-9)


def least_squares(y, *columns, groups=None):
    """(coefficient, p) of each column, with a constant for each group."""
    g = np.zeros(len(y)) if groups is None else groups
    dummies = np.stack([(g == k).astype(float) for k in np.unique(g)], 1)
    X = np.concatenate([np.stack(columns, 1), dummies], 1)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    rest, dof = y - X @ beta, len(y) - X.shape[1]
    se = np.sqrt(rest @ rest / dof * np.diag(np.linalg.inv(X.T @ X)))
    t = beta / se
    return [(beta[k], T.two_sided_p(float(t[k] / np.sqrt(dof + t[k] ** 2)), dof + 2)) for k in range(len(columns))]


def test_paths_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [("abc"[k % 3], k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(rng.normal(0, 1, (200, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, -0.6], [0, 0, 1]]))]
    df = spark.createDataFrame(rows + [("a", 999, None, 1.0, 1.0), ("few", 1000, 1.0, 2.0, 3.0), ("few", 1001, 2.0, 2.5, 3.0)], "city string, id long, x double, m double, y double")
    got = {r["city"]: r for r in B.path_models(df, "x", "m", "y", ["city"]).collect()}
    for city in "abc":
        x, m, y = np.array([r[2:] for r in rows if r[0] == city]).T
        (a, pa), (total, pt), ((c, pc), (b, pb)) = *least_squares(m, x), *least_squares(y, x), least_squares(y, x, m)
        r = got[city]
        assert (r["a"], r["p_a"], r["total"], r["p_total"], r["c_prime"], r["p_c_prime"], r["b"], r["p_b"]) == pytest.approx((a, pa, total, pt, c, pc, b, pb), abs=1e-8)
        assert r["indirect"] == pytest.approx(a * b) and r["proportion"] == pytest.approx(a * b / total)
    assert got["few"]["p_a"] is None and got["few"]["p_b"] is None and got["few"]["n"] == 2
    x, m, y = np.array([r[2:] for r in rows]).T
    g = np.array([ord(r[0]) for r in rows])
    pooled = B.path_models(df.where("city != 'few'"), "x", "m", "y", [], absorb="city").first()
    ((a, pa),), ((c, pc), (b, pb)) = least_squares(m, x, groups=g), least_squares(y, x, m, groups=g)
    assert (pooled["a"], pooled["p_a"], pooled["c_prime"], pooled["p_c_prime"], pooled["b"], pooled["p_b"]) == pytest.approx((a, pa, c, pc, b, pb), abs=1e-8)


def test_indirect_interval(spark):
    rows, df = table(spark, np.random.default_rng(6), extra=EXTRA)
    w = drawn(spark, rows, 300)
    own = [r for r in rows if r[0] == "c0" and None not in r]
    products = []
    for b in range(300):
        at = np.repeat(np.arange(len(own)), [int(w[r[1]][b]) for r in own])
        x, m, y = (np.array([r[k] for r in own])[at] for k in (2, 3, 4))
        x, m, y = x - x.mean(), m - m.mean(), y - y.mean()
        products.append((x @ m) / (x @ x) * np.linalg.lstsq(np.stack([x, m], 1), y, rcond=None)[0][1])
    got = {r["city"]: r for r in B.indirect_interval(df, "x", "m", "y", "id", ["city"], 300).collect()}
    lo, hi = np.percentile(products, [2.5, 97.5])
    assert (got["c0"]["indirect_lo"], got["c0"]["indirect_hi"]) == pytest.approx((lo, hi), rel=1e-5) and got["c0"]["significant"] == (lo * hi > 0)
    assert got["flat"]["indirect_lo"] is None

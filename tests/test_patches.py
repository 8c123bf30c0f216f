"""Patches through a model and back, against a plain loop over whole rasters."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from verdance.operators import patches as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def smooth(batch):
    """Each value and its four neighbours inside the patch, over all bands."""
    z = batch.sum(-1)
    pad = np.pad(z, ((0, 0), (1, 1), (1, 1)))
    return (pad[:, 1:-1, 1:-1] + 0.25 * (pad[:, :-2, 1:-1] + pad[:, 2:, 1:-1] + pad[:, 1:-1, :-2] + pad[:, 1:-1, 2:]))[..., None]


def direct(field, predict, size, stride, merge, normalise):
    h, w, bands = field.shape
    best, total, n = np.full((h, w), 1.0 if merge == "min" else 0.0), np.zeros((h, w)), np.zeros((h, w), int)
    for c in range(0, w, stride):
        for r in range(0, h, stride):
            real = field[r : r + size, c : c + size]
            patch = np.zeros((1, size, size, bands))
            patch[0, : real.shape[0], : real.shape[1]] = normalise(real) if normalise else real
            p = predict(patch).reshape(size, size)[: real.shape[0], : real.shape[1]]
            cut = np.s_[r : r + size, c : c + size]
            best[cut] = {"max": np.maximum, "min": np.minimum, "replace": lambda a, b: b}[merge](best[cut], p)
            total[cut] += p
            n[cut] += 1
    return best, total / n, n


def table(tiles):
    rows = []
    for t, f in tiles.items():
        r, c = np.indices(f.shape[:2])
        rows.append(pd.DataFrame({"tile_ord": t, "r": r.ravel(), "c": c.ravel()} | {f"b{k}": f[..., k].ravel() for k in range(f.shape[2])}))
    return pd.concat(rows)


@pytest.mark.parametrize("size,stride,batch,merge,normalise", [(16, 8, 3, "max", P.standard_scores), (16, 8, 1, "min", None), (12, 7, 2, "replace", P.standard_scores), (9, 9, 8, "replace", None), (16, 5, 2, "max", None)])
def test_equals_direct_evaluation(spark, size, stride, batch, merge, normalise):
    rng = np.random.default_rng(size * stride)
    tiles = {f"t{k}": rng.normal(size=(*shape, 2)) for k, shape in enumerate([(33, 47), (16, 16), (1, 40), (25, 3), (8, 65)])}
    got = P.predicted(spark.createDataFrame(table(tiles)), smooth, ["b0", "b1"], size, stride, batch, merge, normalise).toPandas()
    assert len(got) == sum(f.shape[0] * f.shape[1] for f in tiles.values())
    for t, own in got.groupby("tile_ord"):
        own = own.sort_values(["r", "c"])
        for name, want in zip(("p", "confidence", "overlap"), direct(tiles[t], smooth, size, stride, merge, normalise)):
            assert np.allclose(own[name], want.ravel()), (t, name)


def test_gaps_nulls_and_repeats(spark):
    """A tile with a hole wider than a patch, null and NaN values, rows without a place, one place twice."""
    rows = [("a", 0, 0, 2.0), ("a", 30, 41, 1.0), ("a", 30, 41, 3.0), ("a", 2, 2, None), ("a", 2, 3, float("nan")), ("a", None, 1, 9.0), ("a", -1, 1, 9.0), (None, 0, 0, 9.0)]
    px = spark.createDataFrame(rows, "tile_ord string, r int, c long, b0 double").repartition(3)
    got = P.predicted(px, smooth, ["b0"], 8, 4, 2, "max", None).toPandas().sort_values(["r", "c"])
    field = np.zeros((31, 42, 1))
    field[0, 0], field[30, 41] = 2, 3
    assert np.allclose(got.p, direct(field, smooth, 8, 4, "max", None)[0].ravel())
    assert P.predicted(px.limit(0), smooth, ["b0"], 8, 4).count() == 0


def test_a_batch_that_fails_is_tried_one_by_one(spark):
    def small_only(batch):
        if len(batch) > 1:
            raise MemoryError("too many")
        return smooth(batch)

    field = np.arange(600.0).reshape(20, 30, 1) / 600
    got = P.predicted(spark.createDataFrame(table({"a": field})), small_only, ["b0"], 8, 4, 4, "max", None).toPandas().sort_values(["r", "c"])
    assert np.allclose(got.p, direct(field, smooth, 8, 4, "max", None)[0].ravel())


@pytest.mark.parametrize("wrong", [{"stride": 9}, {"stride": 0}, {"batch": 0}, {"merge": "mean"}])
def test_wrong_parameters(spark, wrong):
    px = spark.createDataFrame([("a", 0, 0, 1.0)], "tile_ord string, r int, c int, b0 double")
    with pytest.raises(ValueError):
        P.predicted(px, smooth, ["b0"], **{"size": 8, "stride": 4} | wrong)

"""Hand-made cases and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.functions import cleaning as C
from verdance.functions import geometry as G
from verdance.operators import raster as R
from verdance.operators import spatial as S
from verdance.operators import stats as T
from verdance.streaming import tiles


def ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = ((0, 0), (60, 0), (60, 30), (30, 30), (30, 60), (0, 60), (0, 0))


@pytest.mark.parametrize("x,y,touches,inside", [(1, 1, True, True), (31, 31, False, False), (60, 15, True, False), (30, 45, True, False)])
def test_concave_window(spark, x, y, touches, inside):
    at = F.lit(float(x)), F.lit(float(y))
    assert value(spark, G.intersects(ring(*L), *at)) is touches
    assert value(spark, G.within(ring(*L), *at)) is inside


def test_shoelace(spark):
    assert value(spark, G.signed_area(ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)))) == 10


@pytest.mark.parametrize("lon,lat,zone", [(-97.74, 30.27, 14), (-86.53, 39.17, 16), (-122.03, 37.32, 10), (-122.85, 49.19, 10)])
def test_utm_round_trip(spark, lon, lat, zone):
    e, n = G.utm_forward(F.lit(lon), F.lit(lat), F.lit(zone))
    back = value(spark, F.struct(*G.utm_inverse(e, n, F.lit(zone))))
    assert abs(back[0] - lon) < 1e-8 and abs(back[1] - lat) < 1e-8


@pytest.mark.parametrize("raw,digits,want", [("1500000US060855001001", 12, "060855001001"), ("60855001001.0", 12, "060855001001"), (" 59150001 ", 8, "59150001")])
def test_geoid(spark, raw, digits, want):
    assert value(spark, C.geoid(F.lit(raw), digits)) == want


@pytest.mark.parametrize("raw,strict,bounded", [("-", None, None), ("250,000+", None, 250000.0), ("2,500-", None, 2500.0), ("71000", 71000.0, 71000.0)])
def test_income(spark, raw, strict, bounded):
    assert value(spark, C.income_strict(F.lit(raw))) == strict
    assert value(spark, C.income_bounded(F.lit(raw))) == bounded


@pytest.mark.parametrize("n,want", [(100, 100), (123456, 123000), (0, 0)])
def test_three_figures(spark, n, want):
    assert value(spark, C.three_figures(F.lit(n))) == want


def test_labels_by_connectivity():
    r, c = np.array([0, 1]), np.array([0, 1])
    assert len(set(R.label_pixels(r, c, 4))) == 2
    assert len(set(R.label_pixels(r, c, 8))) == 1


def test_step_up(spark):
    df = spark.createDataFrame([(1, 0.01), (1, 0.02), (1, 0.03), (1, 0.04), (1, None)], "g int, p double")
    got = sorted((r["p"] is None, r["p_adj"]) for r in T.adjusted(df, "p", ["g"]).collect())
    assert [round(x, 9) for miss, x in got if not miss] == [0.04] * 4 and got[-1] == (True, None)


def test_student_p():
    assert abs(T.two_sided_p(0.5, 27) - 0.00794) < 2e-4
    assert T.two_sided_p(None, 10) is None


def test_chain_keeps_its_ends(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert [r["key"] for r in S.removed_near_duplicates(pairs).collect()] == [2]


def test_keep_set_is_the_sequential_one(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a < b}
    kept: set[int] = set()
    for k in range(60):
        if not any((a, k) in pairs for a in kept):
            kept.add(k)
    got = S.removed_near_duplicates(spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert {r["key"] for r in got.collect()} == set(range(60)) - kept


def test_pair_at_exactly_the_radius(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 0.3, 0.4), (3, 2, 0.3, 0.4)], "id long, t long, x double, y double")
    assert {(r["a"], r["b"]) for r in S.radius_pairs(df, 0.5, "id", "t").collect()} == {(1, 2), (1, 3)}
    assert S.radius_pairs(df, 0.5, "id").count() == 3


def test_grid_join_is_no_nested_loop(spark):
    points = spark.createDataFrame([(1, 1.0, 0.5)], "id long, x double, y double")
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0)], "u long, x0 double, y0 double, x1 double, y1 double")
    m = S.points_in_polygons(points, S.with_box_ring(boxes), 1.0)
    assert m.count() == 2 and S.points_in_polygons(points, S.with_box_ring(boxes), 1.0, "within").count() == 0
    assert S.first_match(m.select("id", "u"), "id", "u").first()["u"] == 0
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_takes_each_detection_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 2)], "tile_ord long, label long")
    df.write.parquet(str(tmp_path / "in"))
    df.write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = tiles.detections(spark, str(tmp_path / "in"), df.schema)
    tiles.run_once(stream, str(tmp_path / "checkpoint"), lambda batch, _: got.extend(batch.collect())).awaitTermination(60)
    assert len(got) == 2

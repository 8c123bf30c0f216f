"""Shapes, neighbours, scores and clipping of tiles against plain loops and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.functions import geometry as G
from verdance.operators import clipping as K
from verdance.operators import raster as R
from verdance.operators import regions as A
from verdance.plans import reports

SF = "/root/testdata/sf0.01"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def region(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


RINGS = "array<array<struct<x: double, y: double>>>"
TILE = f"tile_ord long, x0 double, y0 double, x1 double, y1 double, width int, height int, rings {RINGS}"


def hull_by_support(pixels):
    """Pixels of the hull, by all directions that an edge between two pixels' middles can have."""
    at = np.array(sorted(pixels))
    span = 2 * int(np.ptp(at, axis=0).max()) + 3
    a, b = np.meshgrid(np.arange(-span, span + 1), np.arange(-span, span + 1))
    a, b = a.ravel(), b.ravel()
    reach = (np.outer(at[:, 0], a) + np.outer(at[:, 1], b)).max(0) + np.maximum(abs(a), abs(b)) / 2
    (r0, c0), (r1, c1) = at.min(0), at.max(0)
    return sum(bool((a * r + b * c <= reach).all()) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1))


@pytest.mark.parametrize("seed", range(12))
def test_hull_of_random_blobs(seed):
    rng, held = random.Random(seed), {(5, 5)}
    while len(held) < 3 + 5 * seed:
        r, c = rng.choice(sorted(held))
        held.add(rng.choice([(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]))
    r, c = np.array(sorted(held)).T
    assert A.hull_pixels(r, c) == hull_by_support(held)


def test_outlines_by_hand():
    """One pixel, a 2 by 2 and a 5 by 5 square, a plus, and a 7 by 7 square with a hole."""
    square = [(r, c) for r in range(5) for c in range(5)]
    shapes = [[(0, 0)], [(0, 0), (0, 1), (1, 0), (1, 1)], square, [(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)], [(r, c) for r in range(7) for c in range(7) if (r, c) != (3, 3)]]
    at = np.array([p for s in shapes for p in s])
    which = np.repeat(np.arange(5), [len(s) for s in shapes])
    # a ring's pixels have length 1; those around the hole meet at corners only
    expected = [0.0, 4.0, 16.0, 4 * math.sqrt(2), 24 + 4 * math.sqrt(2)]
    assert A.perimeters(at[:, 0], at[:, 1], which, 5) == pytest.approx(expected)


def test_shapes_of_two_tiles(spark):
    rows = [(1, r, c, 0.9) for r in range(3) for c in range(3)] + [(2, 0, c, 0.9) for c in range(4)] + [(2, r, 0, 0.9) for r in range(1, 4)]
    found = R.labelled(spark.createDataFrame(rows, "tile_ord long, r long, c long, v double"))
    got = {r["tile_ord"]: (r["convex_area"], r["solidity"]) for r in A.region_shapes(found).collect()}
    assert got == {1: (9, 1.0), 2: (10, 0.7)}
    assert A.region_shapes(found.where("tile_ord = 9")).count() == 0


def test_nearest_neighbours(spark):
    rng = random.Random(4)
    rows = [(0, k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(60)] + [(0, 60, 900.0, 5.0), (0, 61, 903.0, -800.0), (0, 62, 0.25, 0.25), (0, 63, 0.25, 0.25)]
    rows += [(1, 0, 3.0, 3.0)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0), (2, 2, 3.0, 0.0)] + [(3, 0, 1.0, 1.0), (3, 1, 1.0, 1.0)]
    points = spark.createDataFrame(rows + [(1, 9, None, 2.0), (1, 8, float("nan"), 2.0), (1, 7, float("inf"), 2.0)], "g int, k int, x double, y double")
    for cell in (0.5, 1.0, 40.0):
        got = {(r["g"], r["k"]): r["distance"] for r in A.nearest_neighbours(points, ["g"], "k", cell).collect()}
        assert len(got) == len(rows)
        for g, k, x, y in rows:
            others = [math.dist((x, y), (u, v)) for h, m, u, v in rows if h == g and m != k]
            assert got[g, k] == (pytest.approx(min(others)) if others else None)


def test_scores_reject(spark):
    tiles = spark.createDataFrame([(k, 0.9, 0.1 if k else 0.0, 900, None, None, 2) for k in range(3)], "tile_ord long, peak double, spread double, foreground long, confidence double, ndvi_apart double, n_sources int")
    rows = [(t, n, 400, 20 * n, 20 * n + 19, 60, 79, 20.0 * n, 70.0, 1.0, 60.0, 0.8, None) for t in range(3) for n in range(1, 7)]
    rows += [(2, 99, 5001, 0, 99, 100, 199, 50.0, 150.0, 0.5, 400.0, 0.8, None)]
    regions = spark.createDataFrame(rows, "tile_ord long, label long, area long, r0 long, r1 long, c0 long, c1 long, row double, col double, solidity double, perimeter double, mean_v double, confidence double")
    got = {r["tile_ord"]: r for r in A.quality_score(tiles, regions).collect()}
    assert [(got[k]["n_trees"], got[k]["quality"] > 0, got[k]["is_good"]) for k in range(3)] == [(0, False, False), (6, True, True), (7, False, False)]
    spacing = 0.6 / 4 + 0.4 * min(1, 20 / 30)
    shape = 0.6 + 0.4 * min(1, 4 * math.pi * 400 / 3600)
    assert got[1]["quality"] == pytest.approx(0.25 * 0.5 + 0.15 * spacing + 0.15 + 0.12 * 0.5 + 0.12 * shape + 0.08 * 0.8 + 0.05 * 6 / 7 + 0.04 + 0.04)
    b = {r["tile_ord"]: r for r in A.crown_score(tiles, regions).collect()}
    assert b[1]["score"] == pytest.approx(0.8 * 6 / 7 * 2.0) and b[1]["n_trees"] == 6


def test_best_candidate_rules(spark):
    rows = [("a", 1, 0.0, 0.0, False, 0.1, 0.5), ("a", 2, 0.0, 0.0, False, 0.1, 0.5), ("a", 3, 0.002, 0.0, False, 0.1, 0.9), ("a", 4, 0.0, 0.0, True, 0.1, 0.9), ("b", 5, 0.0, 0.0, False, 0.41, 0.9), ("b", 6, 0.0, 0.0, False, 0.1, 0.29), ("c", 7, 0.001, 0.001, False, 0.4, 0.3), ("d", 8, None, 0.0, False, 0.1, 0.9)]
    tiles = spark.createDataFrame(rows, "city string, tile int, pan_off double, ndvi_off double, blank boolean, density double, quality double")
    assert {tuple(r) for r in A.best_candidates(tiles, "city", "tile").collect()} == {("a", 1, 0.5), ("c", 7, 0.3)}


@pytest.mark.parametrize("seed", range(3))
def test_runs_are_pixel_centres(spark, seed):
    """Random stars with a square hole, on tiles that are not square."""
    rng, rows, star = random.Random(seed), [], []
    for k in range(11):
        reach = rng.uniform(2, 9)
        star.append((10 + reach * math.cos(2 * math.pi * k / 11), 10 + reach * math.sin(2 * math.pi * k / 11)))
    rings = region([*star, star[0]], box(9.3, 9.3, 10.4, 10.4))
    rows = [(k, 5.0 * (k % 4), 5.0 * (k // 4), 5.0 * (k % 4) + 5, 5.0 * (k // 4) + 5, 17, 9, rings) for k in range(16)]
    tiles = spark.createDataFrame(rows, TILE)
    got = {(r["tile_ord"], r["r"], c) for r in K.region_runs(tiles).collect() for c in range(r["c0"], r["c1"] + 1)}
    pixels = tiles.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(16))))
    x, y = F.col("x0") + (F.col("c") + 0.5) * 5 / 17, F.col("y1") - (F.col("r") + 0.5) * 5 / 9
    expected = {(p["tile_ord"], p["r"], p["c"]) for p in pixels.where(G.in_region(F.col("rings"), x, y)).select("tile_ord", "r", "c").collect()}
    assert got == expected and 0 < len(got) < 16 * 9 * 17


def test_boundary_splits_a_crown(spark):
    """A slot cut out of the region parts a bar in two; tile 1 lies whole in its region, tile 2 outside, tile 3 has none."""
    slot = region(box(-1, -1, 9, 9), box(3, -1, 5, 9))
    tiles = spark.createDataFrame([(0, 0.0, 0.0, 8.0, 8.0, 8, 8, slot), (1, 0.0, 0.0, 8.0, 8.0, 8, 8, region(box(0, 0, 8, 8))), (2, 20.0, 0.0, 28.0, 8.0, 8, 8, slot), (3, 0.0, 0.0, 8.0, 8.0, 8, 8, [])], TILE)
    pixels = spark.createDataFrame([(t, 4, c, 0.9) for t in range(4) for c in range(8)] + [(t, 0, 0, 0.2) for t in range(4)], "tile_ord long, r long, c long, v double")
    got = {tuple(r) for r in K.clipped_counts(pixels, tiles, 0.3).collect()}
    assert got == {(0, False, 2, 6, 48), (1, True, 1, 8, 64), (2, False, 0, 0, 0)}
    assert K.clipped_counts(pixels, tiles.where("tile_ord > 9"), 0.3).count() == 0


def test_tiles_without_boundary_stay(spark):
    """A corner that touches, a tile in a hole, a tile around the region, a null region, an empty one, and none at all."""
    rows = [(0, "a", 10.0, 10.0, 12.0, 12.0), (1, "a", 4.0, 4.0, 5.0, 5.0), (2, "a", -5.0, -5.0, 20.0, 20.0), (3, "a", 11.0, 0.0, 12.0, 1.0), (4, "n", 0.0, 0.0, 1.0, 1.0), (5, "e", 0.0, 0.0, 1.0, 1.0), (6, "z", 0.0, 0.0, 1.0, 1.0), (7, None, 0.0, 0.0, 1.0, 1.0)]
    tiles = spark.createDataFrame(rows, "tile long, city string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([("a", region(box(0, 0, 10, 10), box(3, 3, 6, 6))), ("n", None), ("e", [])], f"city string, rings {RINGS}")
    assert sorted(r["tile"] for r in K.near_regions(tiles, regions, "city").collect()) == [0, 2, 4, 5, 6, 7]


def test_queries_act_both_ways(spark):
    """The rules of the queries let some rows through and stop others."""
    rows = lambda name: reports.QUERIES[name](spark, SF).collect()
    assert len({r["is_good"] for r in rows("tile_score_quality")}) == 2
    assert {r["score"] > 0 for r in rows("tile_score_crowns")} == {True, False}
    counts = rows("clipped_tile_count")
    assert {r["inside"] for r in counts} == {True, False} and min(r["total_pixels"] for r in counts) == 0
    assert any(0 < r["total_pixels"] < 65536 for r in counts)
    assert 0 < len(rows("tiles_near_city")) < 50 and 0 < len(rows("best_tile")) <= 5

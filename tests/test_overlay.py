"""Polygons with polygons: hand-made shapes, random ones, and the Spark side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.functions import geometry as G
from verdance.operators import overlay as O


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def region(*rings):
    x, y = np.array([p for r in rings for p in r], float).reshape(-1, 2).T
    return O.region_edges(x, y, np.array([len(r) for r in rings]))


def area(rings):
    return sum((x0 * y1 - x1 * y0) / 2 for r in rings for (x0, y0), (x1, y1) in zip(r, r[1:]))


L = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 5), (0, 5), (0, 0)]
#: (rings of one, rings of the other, whether they touch, area, rings of what they share)
SHAPES = [
    ([box(0, 0, 2, 2)], [box(1, 1, 3, 3)], True, 1, 1),
    ([box(0, 0, 2, 2)], [box(2, 0, 3, 3)], True, 0, 0),  # along an edge
    ([box(0, 0, 2, 2)], [box(2, 2, 3, 3)], True, 0, 0),  # at a corner
    ([box(0, 0, 2, 2)], [box(5, 5, 6, 6)], False, 0, 0),
    ([box(0, 0, 2, 2)], [box(0, 0, 2, 2)], True, 4, 1),
    ([box(0, 0, 4, 4)], [box(1, 1, 2, 2)], True, 1, 1),
    ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0, 0, 2, 2)], True, 3, 1),
    ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(1.5, 1.5, 2.5, 2.5)], False, 0, 0),  # in the hole
    ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(1, 1, 3, 3)], True, 0, 0),  # fills the hole
    ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(-1, -1, 5, 5)], True, 12, 2),  # a hole stays
    ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0, 0, 4, 4), box(1, 1, 3, 3)], True, 12, 2),
    ([box(0, 0, 1, 1), box(3, 0, 4, 1)], [box(0.5, 0.5, 3.5, 2)], True, 0.5, 2),  # two parts
    ([L], [box(1, 1, 3, 4)], True, 4, 1),
    ([L], [box(3, 3, 6, 6)], False, 0, 0),
    ([L], [[(3, 1), (3, 4), (1, 4), (3, 1)]], True, 1 + 1 / 3 - 1 / 3, None),
    ([[(0, 0), (4, 0), (2, 4), (0, 0)]], [box(1, 1, 3, 3)], True, 3.5, 1),
    ([[(0, 0), (3, 3), (3, 0), (2, 2), (0, 0)][::-1]], [box(2, 0, 3, 3)], True, None, 1),
]


@pytest.mark.parametrize("a, b, touches, expected, n", SHAPES)
def test_shapes(a, b, touches, expected, n):
    for turn in (1, -1):
        for one, two in ((a, b), (b, a)):
            edges, touch = O.intersection(*region(*[r[::turn] for r in one]), *region(*two))
            rings = O.closed_rings(edges)
            assert touch == touches
            if expected is not None and n is not None:
                assert O.measured(edges)[0] == pytest.approx(expected)
            assert area(rings) == pytest.approx(O.measured(edges)[0])
            if n is not None:
                assert len(rings) == n


def star(rng, n):
    """A ring around a point that it sees whole, so that it does not cross itself."""
    t = (np.arange(n) + rng.random(n) * 0.9) * 2 * np.pi / n
    r = 0.2 + rng.random(n)
    x, y = rng.random(2)
    ring = [(x + a * np.cos(b), y + a * np.sin(b)) for a, b in zip(r, t)]
    return [*ring, ring[0]]


def test_parts_add_up():
    """A cut into what lies in B and what lies outside of it, whatever the shapes."""
    rng = np.random.default_rng(0)
    frame = box(-9, -9, 9, 9)
    for _ in range(150):
        a, b = star(rng, rng.integers(4, 60)), star(rng, rng.integers(4, 60))
        A = region(a)
        inside, outside = O.intersection(*A, *region(b))[0], O.intersection(*A, *region(frame, b))[0]
        assert O.measured(inside)[0] + O.measured(outside)[0] == pytest.approx(abs(area([a])), abs=1e-9)
        assert O.measured(O.intersection(*region(b), *A)[0])[0] == pytest.approx(O.measured(inside)[0], abs=1e-9)
        assert area(O.closed_rings(inside)) == pytest.approx(O.measured(inside)[0], abs=1e-9)


def test_many_shared_corners():
    """On a coarse lattice edges overlap and meet at corners all the time."""
    rng = np.random.default_rng(1)

    def stairs(n):
        h = rng.integers(1, 4, n)
        ring = [(0, 0), (n, 0)]
        for k in range(n - 1, -1, -1):
            ring += [(k + 1, int(h[k])), (k, int(h[k]))]
        return h, [*ring, (0, 0)]

    for _ in range(60):
        (g, a), (h, b) = stairs(9), stairs(9)
        edges, touch = O.intersection(*region(a), *region(b))
        assert touch and O.measured(edges)[0] == pytest.approx(np.minimum(g, h).sum())
        assert area(O.closed_rings(edges)) == pytest.approx(np.minimum(g, h).sum())


def test_large_region():
    """Thousands of edges against thousands, without holding all pairs of them."""
    n = 6000
    t = np.linspace(0, 2 * np.pi, n + 1)
    ring = lambda x: [*zip(x + np.cos(t[:-1]), np.sin(t[:-1])), (x + 1.0, 0.0)]
    edges, _ = O.intersection(*region(ring(0.0)), *region(ring(1.0)))
    assert O.measured(edges)[0] == pytest.approx(2 * np.pi / 3 - np.sqrt(3) / 2, abs=1e-5)


def regions(spark, rows):
    return spark.createDataFrame([(k, None if r is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in r]) for k, r in rows], f"k long, rings {O.RINGS}")


def test_overlay_of_a_table(spark):
    rows = [(k, a) for k, (a, *_) in enumerate(SHAPES)]
    left = regions(spark, rows).withColumnRenamed("rings", "a")
    right = regions(spark, [(k, b) for k, (_, b, *_) in enumerate(SHAPES)] + [(99, None), (98, [])]).withColumnRenamed("rings", "b")
    got = {r["k"]: r for r in O.overlay(left.join(right, "k"), geometry=True).collect()}
    for k, (_, _, touches, expected, n) in enumerate(SHAPES):
        assert got[k]["touches"] == touches
        if expected is not None and n is not None:
            assert got[k]["area"] == pytest.approx(expected) and len(got[k]["rings"]) == n and (got[k]["cx"] is None) == (expected == 0)
    odd = regions(spark, [(1, None), (2, [])]).withColumnRenamed("rings", "a").join(right.where("k = 0").drop("k"))
    assert [(r["touches"], r["area"], r["cx"]) for r in O.overlay(odd).collect()] == [(False, 0.0, None)] * 2


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_each_pair_once(spark, cell):
    rng = np.random.default_rng(3)
    boxes = [(k, float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(rng.integers(-6, 6, (40, 4)) * [1, 1, 0, 0] + rng.integers(0, 5, (40, 4)) * [0, 0, 1, 1])]
    a = spark.createDataFrame(boxes, "i long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(boxes, "j long, u0 double, v0 double, u1 double, v1 double")
    got = sorted((r["i"], r["j"]) for r in O.near_pairs(a, b, cell).collect())
    assert got == [(i, j) for i, p, q, r, s in boxes for j, t, u, v, w in boxes if p <= v and t <= r and q <= w and u <= s]


def test_touching_regions(spark):
    left = regions(spark, [(0, [box(0, 0, 1, 1)]), (1, [box(1.5, 1.5, 2.5, 2.5)]), (2, [box(4, 4, 5, 5)]), (3, [box(6, 6, 7, 7)]), (4, None)])
    right = regions(spark, [(0, [box(0, 0, 4, 4), box(1, 1, 3, 3)]), (1, [box(0.5, 0.5, 1, 1)])]).drop("k")
    assert sorted(r["k"] for r in O.touching_regions(left, right, "k", "rings", "rings", 2.0).collect()) == [0, 2]


def test_validity(spark):
    bow, open_, thin = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (2, 0), (0, 0)]
    rows = [(0, [box(0, 0, 1, 1)]), (1, [bow]), (2, [open_]), (3, [thin]), (4, None), (5, []), (6, [box(0, 0, 4, 4), box(1, 1, 2, 2)]), (7, [box(0, 0, 4, 4), box(3, 3, 5, 5)]), (8, [[(0, 0), (1, 1), (0, 0)]]), (9, [box(0, 0, 4, 4), box(0, 0, 1, 1)])]
    got = {r["k"]: r["valid"] for r in O.with_validity(regions(spark, rows), "rings").collect()}
    assert [k for k, v in got.items() if v] == [0, 6]


def test_centroid_and_area_of_columns(spark):
    r = regions(spark, [(0, [box(0, 0, 4, 4), box(1, 1, 2, 2)]), (1, [box(0, 0, 2, 2)[::-1]])])
    x, y = G.polygon_centroid(F.col("rings"))
    got = {r["k"]: (r["a"], r["x"], r["y"]) for r in r.select("k", G.polygon_area(F.col("rings")).alias("a"), x.alias("x"), y.alias("y")).collect()}
    assert got[0] == pytest.approx((15.0, (32 - 1.5) / 15, (32 - 1.5) / 15)) and got[1] == pytest.approx((4.0, 1.0, 1.0))


def test_union_of_boxes(spark):
    assert O.covered_area(*np.array([[0, 0, 2, 2], [1, 1, 3, 3], [0, 0, 2, 2], [5, 5, 5, 9]], float).T) == 7
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for g in range(3):
        grid = np.zeros((40, 40), bool)
        for x, y, w, h in rng.integers(0, 20, (30, 4)):
            grid[x : x + w, y : y + h] = True
            rows.append((g, float(x), float(y), float(x + w), float(y + h)))
        expected[g] = grid.sum()
    boxes = spark.createDataFrame(rows, "g long, x0 double, y0 double, x1 double, y1 double")
    for cell in (1.7, 50.0):
        got = {r["g"]: r["area"] for r in O.box_union_area(boxes, ["g"], cell).collect()}
        assert got == pytest.approx(expected)

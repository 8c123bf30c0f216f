"""What shows only on larger tables or odd groups."""

import math

import numpy as np
from pyspark.sql import functions as F

from verdance.functions import geometry as G
from verdance.operators import cascade as P
from verdance.operators import overlay as O
from verdance.operators import regions as A
from verdance.operators import spatial as S
from verdance.operators import stats as T
from verdance.plans import details, reports


def test_spearman_of_a_group_without_spread(spark):
    rows = [(1, float(k), 7.0) for k in range(6)] + [(2, float(k), float(k * k)) for k in range(6)]
    found = {r["city"]: r["rho"] for r in T.spearman(spark.createDataFrame(rows, "city long, x double, y double"), "x", "y", ["city"]).collect()}
    assert math.isnan(found[1]) and found[2] == 1.0


def test_tiles_of_one_value_are_stretched_to_one(spark, monkeypatch):
    pixels = spark.createDataFrame([(0, k, 0, 1.0) for k in range(99)] + [(0, 99, 0, 0.5), (1, 0, 0, 0.5)], "tile_ord long, r long, c long, v double")
    monkeypatch.setattr(details, "load", lambda *_: (pixels,))
    found = {r["tile_ord"]: (r["mean"], r["stretched"]) for r in details.ndvi_rescaled(spark, "").collect()}
    assert found == {0: (0.99, 0.99), 1: (0.0, 1.0)}


def test_coverage_by_all_tiles(spark, monkeypatch):
    tiles = spark.createDataFrame([(0, 90.0, 90.0, 96.0, 96.0)], "tile_ord long, x0 double, y0 double, x1 double, y1 double")
    units = reports.load(spark, "/root/testdata/sf0.001", "fx_units")[0]
    monkeypatch.setattr(reports, "load", lambda *_: (tiles, units))
    assert [r["unit_ord"] for r in reports.coverage_semi(spark, "").collect()] == [24]


def _crowd(spark):
    """Points of a few tiles on a coarse lattice, most of them copies; two have no place."""
    rng = np.random.default_rng(5)
    rows = [(k, int(t), float(x) / 10, float(y) / 10) for k, (t, x, y) in enumerate(rng.integers(0, (9, 30, 30), (900, 3)).tolist())]
    rows.sort(key=lambda r: (r[1], r[0]))
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    odd = [(len(rows), 9, None, 0.0), (len(rows) + 1, 9, float("nan"), 0.0)]
    return rows, spark.createDataFrame(rows + odd, "id long, t long, x double, y double")


def test_pair_counts_are_those_of_all_pairs(spark):
    _, df = _crowd(spark)
    pairs = S.radius_pairs(df, 0.15, "id", "t").join(df.select(F.col("id").alias("a"), "t"), "a").groupBy("t").count()
    for cells in (2, 16):
        found = S.radius_pair_counts(df, 0.15, "t", cells)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def test_near_duplicates_by_places_are_those_of_all_points(spark):
    rows, df = _crowd(spark)
    kept: list[tuple] = []
    for r in rows:
        if not any(k[1] != r[1] and (k[2] - r[2]) ** 2 + (k[3] - r[3]) ** 2 <= 0.15 * 0.15 for k in kept):
            kept.append(r)
    found = {r["id"] for r in S.without_near_duplicates(df, 0.15, "t").collect()}
    assert found == {r[0] for r in kept} | {len(rows), len(rows) + 1}


def test_copies_make_no_pairs(spark):
    """All at one place: the pairs of places do not grow with the copies."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("t"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert S.near_places(S.first_at_places(df, "t"), 0.15, "t").count() == 0
    assert S.without_near_duplicates(df, 0.15, "t").count() == 1000
    assert {r["t"]: r["n_pairs"] for r in S.radius_pair_counts(df, 0.15, "t").collect()} == {0: 2000000, 1: 1000000}


def test_places_are_never_broadcast(spark, monkeypatch):
    """However small their files look: millions of places on a lattice would be built in the driver."""
    plans, kept = [], S._kept
    monkeypatch.setattr(S, "_kept", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    found = S.without_near_duplicates(_crowd(spark)[1], 0.15, "t")
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 4 and sum(p.count("SortMergeJoin") for p in plans) > 6
    assert not any("Broadcast" in p for p in plans)


def test_sensitivity_counts_those_of_all_points_without_broadcasts(spark, monkeypatch):
    rows, df = _crowd(spark)
    plans, kept = [], S._kept
    monkeypatch.setattr(S, "_kept", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    monkeypatch.setattr(reports, "_detections", lambda *_: df.withColumnRenamed("t", "tile_ord"))
    found = reports.dedup_sensitivity(spark, "")
    counts = {}
    for eps in (0.08, 0.1, 0.15):
        stay: list[tuple] = []
        for r in rows:
            if not any(k[1] != r[1] and (k[2] - r[2]) ** 2 + (k[3] - r[3]) ** 2 <= eps * eps for k in stay):
                stay.append(r)
        counts[eps] = len(stay) + 2
    assert {r["eps"]: (r["kept"], r["pct_of_baseline"]) for r in found.collect()} == {e: (n, 100.0 * n / counts[0.1]) for e, n in counts.items()}
    plans.append(found._jdf.queryExecution().executedPlan().toString())  # as run: sizes are known only then
    assert "isFinalPlan=true" in plans[-1] and not any("Broadcast" in p for p in plans)


def test_pairs_are_worked_out_together_as_one_by_one(monkeypatch):
    """Regions of one to three rings and none, in one call, in small steps and swept, give what each pair gives alone."""
    rng = np.random.default_rng(8)
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    def region():
        x, y = rng.integers(0, 6, 2).tolist()
        return [box(x, y, 4), box(x + 1, y + 1, 2), box(x + 5, y, 1)][: int(rng.integers(0, 4))]

    def flat(regions):
        points = np.array([p for r in regions for ring in r for p in ring], float).reshape(-1, 2)
        return points[:, 0], points[:, 1], np.array([len(ring) for r in regions for ring in r], int), np.array([len(r) for r in regions])

    a, b = [region() for _ in range(60)], [region() for _ in range(60)]
    alone = []
    for p, q in zip(a, b):
        edges, touches = O.intersection(*O.region_edges(*flat([p])[:3]), *O.region_edges(*flat([q])[:3]))
        alone.append((sorted(edges.tolist()), touches, O.measured(edges)[0]))
    for chunk, swept in ((1_000_000, 4096), (7, 4096), (1_000_000, 10)):
        monkeypatch.setattr(O, "CHUNK", chunk)
        monkeypatch.setattr(O, "SWEPT", swept)
        edges, where, touches = O.intersections(*O._all_edges(*flat(a)), *O._all_edges(*flat(b)))
        area = O.measures(edges, where)[0]
        together = [(sorted(edges[s:e].tolist()), bool(t), m) for s, e, t, m in zip(where, where[1:], touches, area.tolist())]
        assert together == alone
    assert len({t for _, t, _ in alone}) == 2


def test_utm_of_rings_is_that_of_points(spark):
    rings = F.array(F.array(F.struct(F.col("x"), F.col("y"))))
    e, n = G.utm_forward(F.col("x"), F.col("y"), F.lit(14))
    row = spark.createDataFrame([(-97.7, 30.25)], "x double, y double").select(G.to_utm(rings, F.lit(14))[0][0].alias("p"), e.alias("e"), n.alias("n")).first()
    assert (row["p"]["x"], row["p"]["y"]) == (row["e"], row["n"])


def test_rows_of_one_file_are_dealt(spark):
    from verdance.plans import overlays

    spread = overlays._parcels(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count()
    assert spread == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_signed_area_makes_no_copies_of_a_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0))])
    df = spark.range(1).select(G.signed_area(ring).alias("a"), G.signed_area(F.reverse(ring)).alias("b"), G.signed_area(F.slice(ring, 1, 0)).alias("none"))
    assert tuple(df.first()) == (3.0, -3.0, 0.0)
    assert "slice" not in str(spark.range(1).select(G.signed_area(ring)))


def test_pieces_of_names_stay_in_their_rows(spark):
    """No piece is gathered with others of its place, and no place is joined again."""
    targets = spark.createDataFrame([("Ab",), ("abc",)], "target string")
    places = spark.createDataFrame([(1, "abab C"), (2, "xABCx"), (3, None), (4, "a")], "place long, name string")
    found = P.containing_names(F.broadcast(targets), places, "target", "name", "place")
    assert sorted((r["target"], r["place"]) for r in found.collect()) == [("Ab", 1), ("Ab", 2), ("abc", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [place" not in plan and plan.count("Join") == 2


def test_neighbours_are_sought_by_all_tasks(spark, monkeypatch):
    """The join of cells keeps its number of tasks, however few bytes its rows are."""
    plans, kept = [], S._kept
    monkeypatch.setattr(S, "_kept", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or kept(df))
    points = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0)], "t long, k long, x double, y double")
    assert [r["distance"] for r in A.nearest_neighbours(points, ["t"], "k", 8.0).collect()] == [5.0, 5.0]
    assert plans[1].count("RepartitionByExpression") == 2


def test_touching_is_that_of_intersections(spark):
    """Regions of none to three rings, some within holes and some that meet in points; rows with nothing in them touch nothing."""
    rng = np.random.default_rng(3)
    box = lambda x, y, w: [(float(u), float(v)) for u, v in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]

    def region(wide):
        x, y = rng.integers(0, 9, 2).tolist()
        return [box(x, y, wide), box(x + 1, y + 1, wide - 2), box(x + wide + 1, y, 1)][: int(rng.integers(0, 4))]

    def flat(regions):
        points = np.array([p for r in regions for ring in r for p in ring], float).reshape(-1, 2)
        return points[:, 0], points[:, 1], np.array([len(ring) for r in regions for ring in r], int), np.array([len(r) for r in regions], int)

    a, b = [region(3) for _ in range(400)], [region(int(rng.integers(3, 9))) for _ in range(400)]
    a += [[box(3, 3, 1)], [box(3, 3, 1)], [box(0, 0, 9)], [[(2.0, 2.0)]], []]
    b += [[box(0, 0, 9), box(2, 2, 4)], [box(0, 0, 9), box(2, 2, 1)], [box(3, 3, 1)], [box(0, 0, 9)], [box(0, 0, 9)]]
    found = O.touching(*O._plain_edges(*flat(a)), *O._plain_edges(*flat(b)))
    assert found.tolist() == O.intersections(*O._all_edges(*flat(a)), *O._all_edges(*flat(b)))[2].tolist()
    assert found[400:].tolist() == [False, True, True, False, False] and len(set(found[:400].tolist())) == 2
    schema = f"k long, rings {O.RINGS}"
    left = spark.createDataFrame([*enumerate(a[400:]), (9, None)], schema)
    kept = O.touching_regions(left, spark.createDataFrame([(0, b[400]), (1, None)], schema), "k", "rings", "rings", 4.0)
    assert sorted(r["k"] for r in kept.collect()) == [2]


def test_boxes_are_made_after_rows_are_dealt(spark):
    """The one task that reads a file would else work on all its regions, in filters moved to it."""
    from verdance.plans import overlays

    plan = overlays.polygon_semi(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = max(k for k, line in enumerate(plan) if "RepartitionByExpression" in line)
    read = plan[dealt : next(k for k in range(dealt, len(plan)) if "Relation" in plan[k]) + 1]
    assert len(read) > 1 and not any("transform(" in line for line in read)


def test_pairs_of_places_are_neither_sorted_nor_moved(spark):
    """Least ranks are taken in hash tables of each task, and pairs meet them there; places without an area come last."""
    targets = spark.createDataFrame([("Ab",)], "target string")
    rows = [(4, "ab x", "c", "9", None), (3, "abc", "City", None, 2.0), (2, "cab", "city", "x", 7.0), (1, "Ab y", None, "y", 7.0)]
    places = spark.createDataFrame(rows, "place long, name string, legal string, code string, area double")
    union, one = P.union_places(targets, places, "target"), P.subdivision(targets, places, "target", "5915")
    assert sorted(r["place"] for r in union.collect()) == [2, 3]
    assert [tuple(r) for r in one.collect()] == [("Ab", 2, 1)]
    for found in (union, one):
        assert "HashAggregate(keys=[target" in found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in union._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftSemi" in line]
    assert len(joins) == 1 and "rightHint=(strategy=broadcast)" in joins[0]

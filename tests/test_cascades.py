"""One fixture for each branch of the cascades."""

import pytest

from verdance.operators import cascade as P
from verdance.plans import cascades, reports

SF = "/root/testdata/sf0.01"
RINGS = "array<array<struct<x: double, y: double>>>"


def square(x):
    return [[{"x": x, "y": 0.0}, {"x": x + 1, "y": 0.0}, {"x": x + 1, "y": 1.0}, {"x": x, "y": 1.0}, {"x": x, "y": 0.0}]]


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, " AUSTIN ", "Austin city", "4805", 3.0), (2, "Austin city", "x", "4806", 9.0), (3, "Bloomington town", "x CDP", "1805", 1.0), (4, "City of Surrey", "x", "5915004", 2.0), (5, "Greater Surrey", "x", "59", 8.0)]
    rows += [(6, "North Cupertino", "x CDP", "06", 5.0), (7, "Cupertino Hills", "y City", "5915001", 1.0), (8, "Cupertino Lakes", "y city", None, 7.0), (9, None, None, None, None), (10, "Town of Kyle", None, "1", 1.0), (11, "Kyle Town", None, "2", 1.0), (12, "Austin city", None, "3", 9.0)]
    return spark.createDataFrame([(*r, square(10.0 * r[0])) for r in rows], f"place long, name string, legal string, code string, area double, rings {RINGS}")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(c,) for c in ("Austin", "Bloomington", "Cupertino", "Kyle", "Nowhere", "Surrey", " ", None)], "target string")


def test_unions(targets, places):
    got = {r["target"]: (r["rule"], sorted(int(ring[0]["x"]) for ring in r["rings"])) for r in P.place_unions(targets, places, "target").collect()}
    assert got == {"Austin": (1, [10]), "Bloomington": (4, [30]), "Cupertino": (5, [70, 80]), "Kyle": (4, [110]), "Surrey": (3, [40])}


def test_largest(targets, places):
    got = {r["target"]: (r["rule"], r["place"]) for r in P.largest_place(targets, places, "target").collect()}
    assert got == {"Austin": (1, 2), "Bloomington": (4, 3), "Kyle": (4, 11), "Surrey": (2, 4)}


def test_subdivision(targets, places):
    got = {r["target"]: (r["rule"], r["place"]) for r in P.subdivision(targets, places, "target", "5915").collect()}
    assert got == {"Austin": (1, 1), "Bloomington": (2, 3), "Cupertino": (2, 7), "Kyle": (2, 10), "Surrey": (2, 4)}
    assert P.subdivision(targets, places.where("place > 99"), "target", "5915").count() == 0
    assert P.subdivision(targets.where("target IS NULL"), places, "target", "5915").count() == 0


def test_first_known(spark):
    targets = spark.createDataFrame([(k,) for k in (1, 2, 3, None)], "k int")
    one = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    two = spark.createDataFrame([(1, "A"), (2, "B"), (None, "C")], "k int, v string")
    assert {tuple(r) for r in P.first_known(targets, "k", [one, two]).collect()} == {(1, 1, "a"), (2, 2, "B"), (3, None, None), (None, None, None)}


def test_metadata_branches(spark):
    """Own header, either image, source, patch numbers, mended ids, a name without id, no city, no placed image."""
    rows = ["pred_pan_0-0_austin_001_002.tif", "pred_ndvi_5-6_Surrey_001_002.tif", "pred_pan_7-8_surrey_001_002.tif", "pred_pan_10-20_austin_036_101.tif", "pred_pan_patch_3_austin_039_101.tif",
            "pred_pan_austin.tif", "pred_pan_0-0_dallas_001_002.tif", "pred_pan_9-9_cupertino_001_002.tif", "pred_ndvi_cupertino_7.tif"]
    files = spark.createDataFrame([(r,) for r in rows + rows[:2]], "filename string")
    at = lambda name, x, placed=True, size=100: (name, placed, x + 1.0, x, x, x + 1.0, size, size)
    headers = [at(rows[0], 1.0), at("pan_0-0_austin_001_002.tif", 50.0), at("pan_5-6_Surrey_001_002.tif", 2.0), at("ndvi_5-6_Surrey_001_002.tif", 60.0), at("pan_7-8_surrey_001_002.tif", 70.0, False), at("ndvi_7-8_surrey_001_002.tif", 3.0)]
    headers += [at(rows[3], 0.0, False, 200), at(rows[4], 0.0, False, 200), at("pan_austin.tif", 4.0, True, 300), at(rows[6], 5.0), at(rows[7], 5.0, False), at(rows[8], 0.0, False)]
    headers = spark.createDataFrame(headers, "filename string, placed boolean, x0 double, y0 double, x1 double, y1 double, width int, height int")
    sources = spark.createDataFrame([("austin", "039_101", -100.0, 40.0, 0.5, -0.5), ("austin", "036_101", 0.0, 0.0, 1.0, 1.0)], "city string, tile_id string, left double, top double, dx double, dy double")
    got = {r["filename"]: r for r in P.tile_metadata(files, headers, sources, cascades.CITIES, cascades.CORRECTIONS).collect()}
    assert len(got) == 9
    brief = [(got[r]["rule"], got[r]["city"], got[r]["tile_id"], got[r]["x_offset"], got[r]["left"], got[r]["bottom"], got[r]["right"], got[r]["top"], got[r]["width"]) for r in rows]
    nothing = (None,) * 9
    assert brief == [
        (1, "austin", "001_002", 0, 1.0, 1.0, 2.0, 2.0, 100), (2, "surrey", "001_002", 5, 2.0, 2.0, 3.0, 3.0, 100), (3, "surrey", "001_002", 7, 3.0, 3.0, 4.0, 4.0, 100),
        (4, "austin", "039_101", 10, -95.0, -70.0, 5.0, 30.0, 200), (4, "austin", "039_101", 3, -98.5, -60.0, 1.5, 40.0, 200), (2, "austin", "unknown", 0, 4.0, 4.0, 5.0, 5.0, 256), nothing, nothing, nothing,
    ]


def test_queries_reach_every_rule(spark):
    rules = lambda name: {r["rule"] for r in reports.QUERIES[name](spark, SF).select("rule").distinct().collect()}
    assert rules("place_boundary_union") == {1, 2, 3, 4, 5} and rules("place_boundary_largest") >= {1, 2, 4, 5}
    assert rules("place_subdivision") == {1, 2} and rules("tile_metadata") == {None, 1, 2, 3, 4}

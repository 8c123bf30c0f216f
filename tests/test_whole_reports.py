"""Queries without an SQL twin against sequential versions."""

import pytest

from verdance.plans import reports

SF = "/root/testdata/sf0.001"


def components(cells):
    """Sets of cells that are linked by edges, by flooding."""
    cells, out = set(cells), []
    while cells:
        todo, found = [cells.pop()], []
        while todo:
            r, c = todo.pop()
            found.append((r, c))
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in cells:
                    cells.remove(near)
                    todo.append(near)
        out.append(found)
    return out


def foreground(spark):
    (pixels,) = reports.load(spark, SF, "fx_pixels")
    tiles = {}
    for p in pixels.where("v > 0.3").collect():
        tiles.setdefault(p["tile_ord"], {})[p["r"], p["c"]] = p["v"]
    return tiles


def test_label4_of_the_whole_foreground(spark):
    want = {t: (len(components(cells)), len(cells)) for t, cells in foreground(spark).items()}
    got = {r["tile_ord"]: (r["n_objects"], r["n_pixels"]) for r in reports.QUERIES["label4_foreground"](spark, SF).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0


def test_bootstrap_has_a_pointwise_band(spark):
    band = sorted(reports.QUERIES["bootstrap_band"](spark, SF).collect(), key=lambda r: r["i"])
    fit = {r["i"]: r["fit"] for r in reports.QUERIES["ols_grid"](spark, SF).collect()}
    assert [r["i"] for r in band] == list(range(100)) and all(r["fit_lo"] < fit[r["i"]] < r["fit_hi"] for r in band)
    ci = reports.QUERIES["bootstrap_ci"](spark, SF).first()
    assert tuple(ci) == pytest.approx(tuple(reports.B.bootstrap_slope(reports._xym(spark, SF).repartition(7), "x", "y", "id", 1000).first()))
    assert ci != reports.B.bootstrap_slope(reports._xym(spark, SF), "x", "y", "id", 200).first()


def test_region_properties_have_centroid_and_intensity(spark):
    pixels = reports.load(spark, SF, "fx_pixels")[0].where("v > 0.3")
    want = {}
    for tile, cells in foreground(spark).items():
        for part in components(cells):
            r, c = [x[0] for x in part], [x[1] for x in part]
            label = min(x << 20 | y for x, y in part)
            want[tile, label] = [len(part), sum(r) / len(r), sum(c) / len(c), sum(cells[x] for x in part) / len(part)]
    got = {(p["tile_ord"], p["label"]): [p["area"], p["row"], p["col"], p["mean_v"]] for p in reports.QUERIES["region_properties"](spark, SF).collect()}
    assert got.keys() == want.keys() and pixels.count() == sum(w[0] for w in want.values())
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))

"""Rasters and regions: which pixels lie in a polygon, and counts of tiles clipped to their city.

A tile has its box x0, y0, x1, y1, its width and height in pixels, and row 0 at
the top; a region is an array of rings under the even-odd rule.  A pixel belongs
to a region if its centre does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions import geometry as G
from verdance.operators import raster as R


def _edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, G._edges))


def _meets(rings: Column, touching: bool) -> Column:
    """Whether an edge passes through the box, or, if ``touching``, meets its border.

    A segment and a box are apart if they are so along x, along y or across the segment."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def meets(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        across = F.abs((bx - ax) * ((y0 + y1) / 2 - ay) - (by - ay) * ((x0 + x1) / 2 - ax))
        reach = (x1 - x0) / 2 * F.abs(by - ay) + (y1 - y0) / 2 * F.abs(bx - ax)
        if touching:
            return (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1) & (across <= reach)
        return (F.greatest(ax, bx) > x0) & (F.least(ax, bx) < x1) & (F.greatest(ay, by) > y0) & (F.least(ay, by) < y1) & (across < reach)

    return F.exists(_edges(rings), meets)


def _centre_in(rings: Column) -> Column:
    return G.in_region(rings, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)


def box_within(rings: Column) -> Column:
    """Whether the box lies in the region; it may touch its border from inside."""
    return ~_meets(rings, False) & _centre_in(rings)


def box_touches(rings: Column) -> Column:
    return _meets(rings, True) | _centre_in(rings)


def near_regions(tiles: DataFrame, regions: DataFrame, by: str, rings: str = "rings") -> DataFrame:
    """Tiles that touch the region of their group; those whose group has none, or an empty one, all stay."""
    placed = tiles.join(regions.select(by, rings), by, "left")
    known = F.coalesce(F.size(rings) > 0, F.lit(False))
    return placed.where(~known | box_touches(F.col(rings))).select(*tiles.columns)


def region_runs(tiles: DataFrame, tile: str = "tile_ord", rings: str = "rings") -> DataFrame:
    """(tile, r, c0, c1): the runs of pixels of each of ``tiles`` in its region, a scan line at a time.

    A line crosses the region's edges at the ends of runs; an edge counts its
    lower end.  A line holds the edges of its tile's height only."""
    x0, y0, x1, y1, width, height = (F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height"))
    beside = F.filter(_edges(F.col(rings)), lambda e: (F.least(e["a"]["y"], e["b"]["y"]) < y1) & (F.greatest(e["a"]["y"], e["b"]["y"]) > y0))
    lines = tiles.where((height > 0) & (width > 0)).select(tile, "x0", "y0", "x1", "y1", "width", "height", beside.alias("edges"))
    lines = lines.where(F.size("edges") > 0).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), height.cast("long") - 1)))
    y = y1 - (F.col("r") + 0.5) * (y1 - y0) / height
    lines = lines.withColumn("y", y)
    at = F.col("y")
    crossing = F.transform(
        F.filter("edges", lambda e: (e["a"]["y"] > at) != (e["b"]["y"] > at)),
        lambda e: e["a"]["x"] + (at - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]),
    )
    first = F.transform(F.array_sort(crossing), lambda x: F.greatest(F.lit(0).cast("long"), F.least(width.cast("long"), F.ceil((x - x0) / (x1 - x0) * width - 0.5))))
    lines = lines.select(tile, "r", first.alias("at")).where(F.size("at") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("at"), F.lit(2)), lambda k: F.struct(F.element_at("at", k.cast("int")).alias("c0"), (F.element_at("at", (k + 1).cast("int")) - 1).alias("c1")))
    return lines.select(tile, "r", F.explode(pairs).alias("run")).select(tile, "r", "run.c0", "run.c1").where("c0 <= c1")


def clipped_pixels(pixels: DataFrame, tiles: DataFrame, tile: str = "tile_ord", rings: str = "rings") -> DataFrame:
    """``pixels`` (tile, r, c, ...) that lie in their tile's region.

    Pixels of tiles wholly inside are not tested; pixels of a tile without a region go."""
    inside = tiles.where(box_within(F.col(rings))).select(tile)
    cut = tiles.where(_meets(F.col(rings), False))
    runs = region_runs(cut, tile, rings).withColumnRenamed("r", "_r")
    at = (F.col("r") == F.col("_r")) & F.col("c").between(F.col("c0"), F.col("c1"))
    runs = runs.withColumnRenamed(tile, "_t")
    kept = pixels.join(runs, (F.col(tile) == F.col("_t")) & at, "left_semi")
    return pixels.join(inside, tile, "left_semi").unionByName(kept)


def clipped_counts(pixels: DataFrame, tiles: DataFrame, threshold: float, tile: str = "tile_ord", rings: str = "rings") -> DataFrame:
    """(tile, inside, n_objects, n_pixels, total_pixels) of each tile that has a region.

    Objects are 4-connected pixels over ``threshold``, counted after clipping, so
    that a border may split one.  ``total_pixels`` are those of the tile in the
    region: all of them where ``inside`` says that it lies there whole."""
    known = tiles.where(F.size(rings) > 0)
    whole = box_within(F.col(rings))
    cut = region_runs(known.where(_meets(F.col(rings), False)), tile, rings).groupBy(tile).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("covered"))
    found = R.labelled(clipped_pixels(pixels.where(F.col("v") > threshold), known, tile, rings), 4, tile)
    found = found.groupBy(tile).agg(F.count_distinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))
    each = known.select(tile, whole.alias("inside"), (F.col("width") * F.col("height")).cast("long").alias("all")).join(cut, tile, "left").join(found, tile, "left")
    total = F.when(F.col("inside"), F.col("all")).otherwise(F.coalesce("covered", F.lit(0)))
    return each.select(tile, "inside", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), total.alias("total_pixels"))

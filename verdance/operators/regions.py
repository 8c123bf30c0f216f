"""What labelled regions look like, how far they stand apart, and how good a tile they make."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.operators import spatial as S

# The length that a border pixel adds, by 1 + 2 * (border pixels at its edges) + 10 * (border pixels at its corners).
LENGTHS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def perimeters(rows: np.ndarray, cols: np.ndarray, region: np.ndarray, n: int) -> np.ndarray:
    """Length of the outline of each of ``n`` regions, holes included, from a code of each border pixel's neighbours.

    A border pixel has a pixel outside its region at one of its four edges.  ``region`` is 0 to n - 1."""
    key = region.astype(np.int64) << 42 | (rows.astype(np.int64) + 1) << 21 | (cols.astype(np.int64) + 1)
    held = np.sort(key)

    def there(of: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, of), len(among) - 1)] == of

    edge, corner = (1, -1, 1 << 21, -(1 << 21)), ((1 << 21) + 1, (1 << 21) - 1, 1 - (1 << 21), -1 - (1 << 21))
    inner = np.logical_and.reduce([there(held + s, held) for s in edge])
    border = held[~inner]
    code = 1 + 2 * sum(there(border + s, border).astype(int) for s in edge) + 10 * sum(there(border + s, border).astype(int) for s in corner)
    weight = np.zeros(64)
    weight[list(LENGTHS)] = list(LENGTHS.values())
    return np.bincount(border >> 42, weight[code], n)


def _hull_starts(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row from the first to the last, the least column of a pixel in the hull.

    ``least`` is the least column of each of ``rows``, which ascend.  A pixel
    gives the middles of its four edges; doubled, all is in integers."""
    points: dict[int, int] = {}
    for r, c in zip(rows.tolist(), least.tolist()):
        for y, x in ((2 * r - 1, 2 * c), (2 * r, 2 * c - 1), (2 * r + 1, 2 * c)):
            points[y] = min(points.get(y, x), x)
    chain: list[tuple[int, int]] = []
    for y, x in sorted(points.items()):
        while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (x - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (y - chain[-2][0]):
            chain.pop()
        chain.append((y, x))
    ys, xs = np.array(chain).T
    at = 2 * np.arange(rows[0], rows[-1] + 1)
    k = np.searchsorted(ys, at, "right") - 1
    dy = ys[k + 1] - ys[k]
    return -((-(xs[k] * dy + (at - ys[k]) * (xs[k + 1] - xs[k]))) // (2 * dy))


def hull_pixels(rows: np.ndarray, cols: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the given pixels, its border included."""
    by = np.lexsort((cols, rows))
    r, c = rows[by].astype(np.int64), cols[by].astype(np.int64)
    start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    end = np.append(start[1:], len(r)) - 1
    return int((1 - _hull_starts(r[start], -c[end]) - _hull_starts(r[start], c[start])).sum())


def region_shapes(labelled_pixels: DataFrame, tile: str = "tile_ord") -> DataFrame:
    """(tile, label, perimeter, convex_area, solidity) of each region of labelled pixels (tile, r, c, label).

    Solidity is the region's share of the pixels of its convex hull.  One task
    holds one tile's pixels; an empty table gives an empty one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label, region = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        by = np.argsort(region, kind="stable")
        area = np.bincount(region)
        convex = [hull_pixels(r[part], c[part]) for part in np.split(by, np.cumsum(area)[:-1])]
        return pd.DataFrame({tile: pdf[tile].iloc[0], "label": label, "perimeter": perimeters(r, c, region, len(label)), "convex_area": convex, "solidity": area / np.array(convex)})

    kind = dict(labelled_pixels.dtypes)[tile]
    return labelled_pixels.select(tile, "r", "c", "label").groupBy(tile).applyInPandas(run, f"`{tile}` {kind}, label long, perimeter double, convex_area long, solidity double")


def nearest_neighbours(points: DataFrame, by: list[str], key: str, cell: float) -> DataFrame:
    """(by, key, distance): the distance of each point (by, key, x, y) to the nearest other one of its group.

    A point looks into the 3 x 3 cells around its own; a neighbour no farther
    than a cell's width is the nearest of all.  Points without one look again
    in cells of twice the width, until all have theirs.  Such points stand at
    least half a cell apart, so a cell meets few of them, however many points it
    holds; ``cell`` should be of the size of usual distances, since the first
    round compares all points of a cell.  Points at one place are at distance 0.
    A point alone in its group has a null distance; points with a null or
    infinite coordinate are left out."""
    there = F.abs("x") < float("inf")
    points = points.where(there & (F.abs("y") < float("inf"))).select(*by, key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    places = points.groupBy(*by, "x", "y").agg(F.count("*").alias("held"))
    several = places.groupBy(*by).agg(F.count("*").alias("places"))
    places = S._kept(places.join(several, by))
    found = places.where("held > 1").select(*by, "x", "y", F.lit(0.0).alias("d2"))
    waiting, size = places.where("held = 1 AND places > 1").select(*by, "x", "y"), float(cell)
    while not waiting.isEmpty():
        cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
        around = F.array(*map(F.lit, (-1, 0, 1)))
        asked = waiting.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumn("cx", cx + F.col("i")).withColumn("cy", cy + F.col("j"))
        held = places.select(*by, F.col("x").alias("ox"), F.col("y").alias("oy"), cx.alias("cx"), cy.alias("cy"))
        d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
        other = (F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy"))
        # a number of tasks that stays, since rows that are few bytes in the shuffle are many in memory
        asked, held = S.dealt(asked, *by, "cx", "cy"), S.dealt(held, *by, "cx", "cy")
        seen = S._kept(asked.join(held, [*by, "cx", "cy"]).groupBy(*by, "x", "y").agg(F.min(F.when(other, d2)).alias("d2")))
        found = found.unionByName(seen.where(F.col("d2") <= size * size))
        waiting = seen.where(F.col("d2").isNull() | (F.col("d2") > size * size)).drop("d2")
        size *= 2
    return points.join(found, [*by, "x", "y"], "left").select(*by, key, F.sqrt("d2").alias("distance"))


def _aspect() -> Column:
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return F.greatest(h, w) / (F.least(h, w) + 1)


def fragmentation_score(hits: Column, pixels: Column, components: Column, pan_std: Column, ndvi_std: Column) -> Column:
    """Score A: a fifth of the tile covered, in few and large pieces, of clear images."""
    mean_size = F.coalesce(hits / F.nullif(components, F.lit(0)), F.lit(0.0))
    return (
        0.3 * (1.0 - F.abs(hits / pixels - 0.2) / 0.2)
        + 0.3 / (1.0 + components / 10.0)
        + 0.2 * F.least(F.lit(1.0), mean_size / 100.0)
        + 0.2 * F.least(F.lit(1.0), (pan_std + ndvi_std) / 2.0)
    )


def best_candidates(tiles: DataFrame, by: str, order: str, off: float = 0.001, densest: float = 0.4, least: float = 0.3) -> DataFrame:
    """(by, order, quality): the best tile of each group whose images lie at one place, show something and are not too dense.

    ``tiles`` has pan_off, ndvi_off (distances of the centres), blank, density
    and quality; of equal ones the first in ``order`` wins.  Null measures rule a tile out."""
    may = (F.col("pan_off") <= off) & (F.col("ndvi_off") <= off) & ~F.col("blank") & (F.col("density") <= densest) & (F.col("quality") >= least)
    best = F.min_by(F.struct(order, "quality"), F.struct((-F.col("quality")).alias("q"), F.col(order).alias("o")))
    return tiles.where(may).groupBy(by).agg(best.alias("best")).select(by, f"best.{order}", "best.quality")


def crown_score(tiles: DataFrame, regions: DataFrame, tile: str = "tile_ord", min_trees: int = 5) -> DataFrame:
    """(tile, score, n_trees), score B, of each of ``tiles`` (tile, peak, n_sources).

    ``regions`` has area, box, solidity and mean_v.  Tiles of too few regions
    score 0 and show how many there are; the others show their good ones."""
    good = F.col("area").between(10, 2500) & (_aspect() <= 4) & (F.col("solidity") >= 0.3)
    each = regions.groupBy(tile).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.avg(F.when(good, F.col("mean_v"))).alias("trust"))
    each = tiles.select(tile, "peak", "n_sources").join(each, tile, "left").fillna(0, ["n", "good"])
    boost = F.when(F.col("n_sources") >= 2, 2.0).when(F.col("n_sources") == 1, 1.5).otherwise(1.0)
    score = F.col("trust") * F.when(F.col("good").between(10, 25), 1.2).otherwise(1.0) * (F.col("good") / (F.col("n") + 1)) * boost
    dark, few = F.coalesce(F.col("peak"), F.lit(0.0)) < 0.01, F.col("good") < min_trees
    return each.select(tile, F.when(dark | few, 0.0).otherwise(score).alias("score"), F.when(dark, 0).when(few, F.col("n")).otherwise(F.col("good")).alias("n_trees"))


def quality_score(tiles: DataFrame, regions: DataFrame, tile: str = "tile_ord", min_trees: int = 5, size: int = 256, cell: float = 16.0) -> DataFrame:
    """(tile, is_good, n_trees, quality), score C, of each of ``tiles``.

    ``tiles`` has peak, spread and foreground (largest value, standard deviation
    and pixels over the threshold), confidence (null without such a map) and
    ndvi_apart (difference of the means inside and outside of the trees, or
    null).  ``regions`` has label, area, box, row, col, solidity, perimeter,
    mean_v and confidence (or null).  Tiles without contrast count no trees;
    those of too few good regions or with one over 5000 pixels score 0."""
    edge = (F.col("r0") <= 3) | (F.col("c0") <= 3) | (F.col("r1") + 1 >= size - 4) | (F.col("c1") + 1 >= size - 4)
    shaped = F.col("area").between(10, 2500) & (_aspect() <= 4)
    good = shaped & ~(edge & (F.col("area") > 500)) & (F.col("solidity") >= 0.25)
    round_ = F.least(F.lit(1.0), 4 * float(np.pi) * F.col("area") / F.pow(F.when(F.col("perimeter") > 0, F.col("perimeter")).otherwise(1.0), 2))
    marked = regions.withColumn("good", good).withColumn("edge", shaped & edge).withColumn("shape", 0.6 * F.col("solidity") + 0.4 * round_)
    of = lambda c: F.when(F.col("good"), c)
    half = size / 2
    quarter = lambda r, c: F.max(of((r & c).cast("int")))
    top, left = F.col("row") < half, F.col("col") < half
    each = marked.groupBy(tile).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("edge").alias("edges"), F.max("area").alias("largest"),
        F.avg(of(F.col("shape"))).alias("shape"), F.avg(of(F.coalesce("confidence", "mean_v"))).alias("trust"),
        F.avg(of(F.col("area"))).alias("mean_area"), F.stddev_pop(of(F.col("area"))).alias("sd_area"),
        (quarter(top, left) + quarter(top, ~left) + quarter(~top, left) + quarter(~top, ~left)).alias("quarters"),
    )
    centres = marked.where("good").select(tile, "label", F.col("row").alias("y"), F.col("col").alias("x"))
    apart = nearest_neighbours(centres, [tile], "label", cell).groupBy(tile).agg(F.avg("distance").alias("apart"))
    each = tiles.join(each.join(apart, tile, "left"), tile, "left").fillna(0, ["n", "good", "edges", "largest"])
    share = F.col("foreground") / (size * size)
    density = F.when(share > 0.5, 0.05).when(F.col("good") > 40, 0.1).when(F.col("good") > 35, 0.2).when(F.col("good") <= 15, 1.0).when(F.col("good") <= 25, 0.8).otherwise(0.4)
    spacing = F.when(F.col("good") >= 5, 0.6 * F.col("quarters") / 4 + 0.4 * F.least(F.lit(1.0), F.col("apart") / 30.0)).otherwise(0.5)
    alike = F.when(F.col("good") >= 3, F.greatest(F.lit(0.0), 1 - 0.3 * F.col("sd_area") / (F.col("mean_area") + 1))).otherwise(0.5)
    overlap = F.least(F.lit(1.0), F.coalesce(2.5 * F.abs("ndvi_apart"), F.lit(0.5)))
    trusted = F.coalesce(F.col("confidence"), F.lit(0.5))
    quality = (
        0.25 * overlap + 0.15 * spacing + 0.15 * density + 0.12 * trusted + 0.12 * F.col("shape") + 0.08 * F.col("trust")
        + 0.05 * F.col("good") / (F.col("n") + 1) + 0.04 * alike + 0.04 * F.greatest(F.lit(0.0), 1 - 0.15 * F.col("edges"))
    ) * F.when(F.col("confidence") > 0.6, 1.15).otherwise(1.0)
    flat = F.coalesce((F.col("peak") < 0.01) | (F.col("spread") < 0.02), F.lit(True))
    rejected = (F.col("good") < min_trees) | (F.col("largest") > 5000)
    each = each.select(tile, F.when(flat, 0).when(rejected, F.col("n")).otherwise(F.col("good")).alias("n_trees"), F.when(flat | rejected, 0.0).otherwise(quality).alias("quality"))
    return each.withColumn("is_good", F.col("quality") > 0.2)

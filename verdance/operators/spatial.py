"""Spatial joins as equi-joins on grid cells, with an exact test behind."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import geometry as G


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and never broadcast.

    Coordinates of a lattice are so few bytes in files and shuffles that a table
    of millions of rows would be sent to the driver and built there."""
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to as many tasks as a shuffle has.

    Rows that are few bytes but much work, from one file, would all be worked
    out in the one task that reads it; a number given keeps them apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def with_box_ring(boxes: DataFrame) -> DataFrame:
    """Adds ``ring`` for boxes x0, y0, x1, y1."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, rule: str = "intersects") -> DataFrame:
    """All (point, polygon) matches.  ``polygons`` has ring and its box x0, y0, x1, y1.

    A polygon stands in each cell its box touches, a point in one cell, so the
    join is an equi-join and candidates are local.  ``rule``: intersects counts
    edges, within does not."""
    test = {"intersects": G.intersects, "within": G.within}[rule]
    gridded = polygons.withColumn("cx", _cells(F.col("x0"), F.col("x1"), cell)).withColumn("cy", _cells(F.col("y0"), F.col("y1"), cell))
    placed = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    near = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return placed.join(gridded.drop(*[c for c in points.columns if c in gridded.columns and c not in ("cx", "cy")]), ["cx", "cy"]).where(near & test(F.col("ring"), F.col("x"), F.col("y"))).drop("cx", "cy")


def first_match(matches: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that with the smallest ``order``."""
    rest = [c for c in matches.columns if c not in (key, order)]
    least = F.min_by(F.struct(order, *rest), order).alias("m")
    return matches.groupBy(key).agg(least).select(key, "m.*")


def radius_pairs(points: DataFrame, eps: float, key: str, other_tile_only: str | None = None) -> DataFrame:
    """(a, b, d2) of all pairs a < b at distance ``eps`` or less.

    Each point looks into the 3 x 3 cells around its own; cells are a hair wider
    than ``eps`` so that a pair at exactly that distance is always seen."""
    size = eps * (1 + 1e-9)
    base = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    cols = [F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"]
    cols += [F.col(other_tile_only).alias("bt")] if other_tile_only else []
    right = base.select(*cols)
    left = base.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    left = left.withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    ok = (F.col(key) < F.col("b")) & (d2 <= eps * eps)
    if other_tile_only:
        ok = ok & (F.col(other_tile_only) != F.col("bt"))
    return left.join(shuffled(right), ["cx", "cy"]).where(ok).select(F.col(key).alias("a"), "b", d2.alias("d2"))


def has_place(tile: str) -> Column:
    """Whether a point can stand in a pair with one of another tile: nothing null, nothing NaN."""
    return F.col(tile).isNotNull() & ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()


def _place_pairs(x: np.ndarray, y: np.ndarray, own: np.ndarray, eps: float, chunk: int):
    """(p, q) of all places at distance ``eps`` or less, p = q too, p only of ``own``; a bounded number at a time."""
    size = eps * (1 + 1e-9)
    cx, cy = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    cx, cy = cx - cx.min() + 1, cy - cy.min() + 1
    high = cy.max() + 2
    code = cx * high + cy
    order = np.argsort(code, kind="stable")
    held, asked = code[order], np.flatnonzero(own)
    for dx in (-1, 0, 1):  # three cells above each other follow in the order
        low = code[asked] + dx * high
        first, stop = np.searchsorted(held, low - 1, "left"), np.searchsorted(held, low + 1, "right")
        sums = np.append(0, np.cumsum(stop - first))
        at = 0
        while at < len(asked):
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + chunk, "right")) - 1)
            i = np.repeat(np.arange(at, end), (stop - first)[at:end])
            p, q = asked[i], order[first[i] + np.arange(len(i)) - (sums[i] - sums[at])]
            d2 = (x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q])
            yield p[d2 <= eps * eps], q[d2 <= eps * eps]
            at = end


def _block_pair_counts(x: np.ndarray, y: np.ndarray, tile: np.ndarray, n: np.ndarray, own: np.ndarray, eps: float, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, pairs of each): see ``radius_pair_counts``; only rows of ``own`` count as the smaller tile."""
    tiles, rank = np.unique(tile, return_inverse=True)
    by = np.lexsort((rank, y, x))
    x, y, rank, n, own = x[by], y[by], rank[by], n[by], own[by]
    starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    ends = np.append(starts[1:], len(x))
    key = np.repeat(np.arange(len(starts)), ends - starts) * (len(tiles) + 1) + rank
    until = np.append(0, np.cumsum(n))
    found = np.zeros(len(tiles), np.int64)
    for p, q in _place_pairs(x[starts], y[starts], own[starts], eps, chunk):
        sizes = (ends - starts)[p]
        sums = np.append(0, np.cumsum(sizes))
        at = 0
        while at < len(p):
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + chunk, "right")) - 1)
            i = np.repeat(np.arange(at, end), sizes[at:end])
            row = starts[p[i]] + np.arange(len(i)) - (sums[i] - sums[at])
            above = until[ends[q[i]]] - until[np.searchsorted(key, q[i] * (len(tiles) + 1) + rank[row], "right")]
            np.add.at(found, rank[row], n[row] * above)
            at = end
    return tiles[found > 0], found[found > 0]


def radius_pair_counts(points: DataFrame, eps: float, tile: str, cells: int = 16) -> DataFrame:
    """(tile, n_pairs): pairs of points of two tiles at distance ``eps`` or less, counted at the smaller tile.

    No pair is made.  Points of one tile at one place are one row with a count;
    a place finds in each place near it, by one search, how many points of
    larger tiles stand there.  Time grows with points times near places.  A
    task holds the rows of a block of ``cells`` x ``cells`` cells and its rim."""
    rows = points.where(has_place(tile)).groupBy("x", "y", tile).agg(F.count("*").alias("n"))
    width, rim = eps * cells, eps * (1 + 1e-6)
    block = lambda c, name: F.explode(F.sequence(F.floor((F.col(c) - rim) / width), F.floor((F.col(c) + rim) / width))).alias(name)
    dealt = rows.select("*", block("x", "bx")).select("*", block("y", "by"))
    dealt = dealt.withColumn("own", (F.floor(F.col("x") / width) == F.col("bx")) & (F.floor(F.col("y") / width) == F.col("by")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tiles, n = _block_pair_counts(*(part[c].to_numpy() for c in ("x", "y", tile, "n", "own")), eps)
        return pd.DataFrame({tile: tiles, "n_pairs": n})

    counted = dealt.groupBy("bx", "by").applyInPandas(run, f"`{tile}` {dict(points.dtypes)[tile]}, n_pairs long")
    return counted.groupBy(tile).agg(F.sum("n_pairs").alias("n_pairs"))


def first_at_places(points: DataFrame, tile: str) -> DataFrame:
    """(x, y, tile, n): the smallest tile at each place, and how many points it has there."""
    rows = points.where(has_place(tile)).groupBy("x", "y", tile).agg(F.count("*").alias("n"))
    return rows.groupBy("x", "y").agg(F.min(F.struct(tile, "n")).alias("m")).select("x", "y", "m.*")


def near_places(places: DataFrame, eps: float, tile: str) -> DataFrame:
    """(a, b, d2) of all places of two tiles at distance ``eps`` or less, a in the smaller tile; each named by (tile, x, y)."""
    named = places.select(F.struct(tile, "x", "y").alias("id"), tile, "x", "y")
    return radius_pairs(named, eps, "id", tile)


def without_near_duplicates(points: DataFrame, eps: float, tile: str) -> DataFrame:
    """The points that stay: those with no point of a smaller tile that stays within reach.

    At one place only points of the smallest tile can stay, and all of them stay
    or none: what drives these out drives out all others there.  So places are
    compared, not points, and copies make no pairs."""
    places = _kept(first_at_places(points, tile))
    gone = removed_near_duplicates(near_places(places, eps, tile))
    stays = places.join(shuffled(gone.select("key.*")), ["x", "y", tile], "left_anti").select("x", "y", F.col(tile).alias("_least"), F.lit(True).alias("_stays"))
    places = places.select("x", "y").join(shuffled(stays), ["x", "y"], "left").withColumn("_place", F.lit(True))
    judged = points.join(shuffled(places), ["x", "y"], "left")
    free = F.col("_place").isNull() | F.col(tile).isNull()
    return judged.where(free | (F.col("_stays") & (F.col(tile) == F.col("_least")))).select(*points.columns)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; on a cluster that must be set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(where)
    return f"{where}/rounds-{uuid.uuid4().hex}"


def _kept(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, so rounds do not pile up lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed_near_duplicates(pairs: DataFrame) -> DataFrame:
    """(key): points that go, from pairs (a, b) with a < b.

    A point stays exactly when no smaller point that stays is within reach.  In
    each round the points with no smaller undecided neighbour stay and their
    neighbours go; edges at decided points leave, those of points that stay with
    the neighbours."""
    spark = pairs.sparkSession
    edges = _kept(pairs.select("a", "b").distinct())
    gone = spark.createDataFrame([], f"key {dict(pairs.dtypes)['a']}")
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("a")).distinct()
        out = _kept(edges.join(shuffled(later), "a", "left_anti").select(F.col("b").alias("key")).distinct())
        gone = gone.unionByName(out)
        for end in ("a", "b"):
            edges = edges.join(shuffled(out.withColumnRenamed("key", end)), end, "left_anti")
        edges = _kept(edges)
    return gone.distinct()


def boxes_touching(left: DataFrame, right: DataFrame, cell: float, grow: float = 0.0) -> DataFrame:
    """Pairs of boxes that touch; ``right`` (columns u0, v0, u1, v1) is grown by ``grow``."""
    a = left.withColumn("cx", _cells(F.col("x0"), F.col("x1"), cell)).withColumn("cy", _cells(F.col("y0"), F.col("y1"), cell))
    b = right.withColumn("u0", F.col("u0") - grow).withColumn("v0", F.col("v0") - grow).withColumn("u1", F.col("u1") + grow).withColumn("v1", F.col("v1") + grow)
    b = b.withColumn("cx", _cells(F.col("u0"), F.col("u1"), cell)).withColumn("cy", _cells(F.col("v0"), F.col("v1"), cell))
    ok = (F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1")) & (F.col("y0") <= F.col("v1")) & (F.col("v0") <= F.col("y1"))
    return a.join(b, ["cx", "cy"]).where(ok).drop("cx", "cy").distinct()


def nearest(points: DataFrame, centres: list[tuple[str, float, float]], limit: float) -> DataFrame:
    """Adds ``nearest``: the closest of a few fixed centres if nearer than ``limit``; the first of equals."""
    best_d, best = F.lit(float("inf")), F.lit(None).cast("string")
    for name, cx, cy in centres:
        d = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
        best = F.when(d < best_d, F.lit(name)).otherwise(best)
        best_d = F.least(best_d, d)
    return points.withColumn("nearest", F.when(best_d < limit, best))

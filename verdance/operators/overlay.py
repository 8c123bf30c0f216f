"""Polygons with polygons: intersection tests, clips, and union areas.

A *region* is an array of rings, each an array of struct<x, y> whose last vertex
repeats the first; what an odd number of rings holds is inside, so holes and
separate parts need no marks.  Rings of one region may touch but not cross.
Coordinates that are equal as doubles are the same place; nothing is snapped.

Pairs meet by an equi-join on grid cells, each once, in the cell of the lower left
corner that their boxes share.  The exact work runs in Arrow batches: edges of
one region that come near edges of the other are found by a sweep over x, edges
are split where they meet, and each piece is kept or dropped by the side of the
other region on which it lies.  Areas and centroids follow from the kept pieces;
rings are only closed where a geometry is asked for.  All pairs of a batch are worked
out together: edges stand in one array, pair by pair, and large pairs alone are swept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RINGS = "array<array<struct<x: double, y: double>>>"
#: Pairs of edges, or of points and edges, that are worked out at once.
CHUNK = 1_000_000
#: Vertices of the pairs that are worked out together, and pairs of edges of one pair above which it is swept.
TOGETHER, SWEPT = 200_000, 4096


def with_box(df: DataFrame, region: str, names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Adds the box of a region; null where it has no vertex."""
    xs, ys = F.transform(F.flatten(region), lambda p: p["x"]), F.transform(F.flatten(region), lambda p: p["y"])
    for name, column in zip(names, (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))):
        df = df.withColumn(name, column)
    return df


def near_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs whose boxes touch, each once.  ``left`` has x0, y0, x1, y1 and ``right`` u0, v0, u1, v1.

    A box stands in all cells it touches; of the cells where two boxes meet only
    the one with the lower left corner of what they share gives the pair."""

    def gridded(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        for name, lo, hi in (("cx", x0, x1), ("cy", y0, y1)):
            df = df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
        return df

    both = gridded(left, "x0", "y0", "x1", "y1").join(gridded(right, "u0", "v0", "u1", "v1"), ["cx", "cy"])
    touch = (F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1")) & (F.col("y0") <= F.col("v1")) & (F.col("v0") <= F.col("y1"))
    first = (F.col("cx") == F.floor(F.greatest("x0", "u0") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "v0") / cell))
    return both.where(touch & first).drop("cx", "cy")


# Regions: edges as rows of x0, y0, x1, y1, the ring of each, and where the edges of each region begin.


def _expanded(first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, j) for each k and all j from first[k] to stop[k], a bounded number at a time; the k of one step are whole."""
    sums = np.append(0, np.cumsum(stop - first))
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + CHUNK, "right")) - 1)
        k = np.repeat(np.arange(at, end), (stop - first)[at:end])
        yield k, first[k] + np.arange(len(k)) - (sums[k] - sums[at])
        at = end


def _crossings(edges: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, stop: np.ndarray, ring: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Whether an odd number of the edges first[k] to stop[k] lies to the right of point k, those of its ``own`` ring left out.

    What points on an edge give is not defined."""
    found = np.zeros(len(x), bool)
    for k, j in _expanded(first, stop):
        if not len(k):
            continue
        x0, y0, x1, y1 = edges[j].T
        px, py = x[k], y[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            hits = ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        if ring is not None:
            hits &= ring[j] != own[k]
        found[k[0] : k[-1] + 1] = np.bincount(k - k[0], hits, k[-1] - k[0] + 1).astype(np.int64) & 1
    return found


def _sums(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Sum of values[where[k]:where[k + 1]] for each k."""
    full = where[1:] > where[:-1]
    out = np.zeros(len(where) - 1)
    if full.any():
        out[full] = np.add.reduceat(values, where[:-1][full])
    return out


def _plain_edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of many regions as they are given; the ring of each; where each region's edges begin.

    ``sizes`` has the vertices of each ring, ``rings`` the rings of each region."""
    last = np.zeros(len(x), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    ring = np.repeat(np.arange(len(sizes)), sizes)[~last]
    start = np.flatnonzero(~last)
    edges = np.stack([x[start], y[start], x[start + 1], y[start + 1]], 1) + 0.0 if len(start) else np.zeros((0, 4))
    full = (edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])
    edges, ring = edges[full], ring[full]
    return edges, ring, np.searchsorted(ring, np.append(0, np.cumsum(rings)))


def _all_edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_plain_edges``, turned so that the inside is to their left."""
    edges, ring, bounds = _plain_edges(x, y, sizes, rings)
    begins = np.searchsorted(ring, np.arange(len(sizes) + 1))
    some = np.flatnonzero(begins[1:] > begins[:-1])
    if not len(some):
        return edges, ring, bounds
    low, high = begins[some], begins[some + 1]
    at = np.repeat(np.arange(len(some)), high - low)
    x0, y0 = edges[low[at], 0], edges[low[at], 1]
    turn = np.add.reduceat((edges[:, 0] - x0) * (edges[:, 3] - y0) - (edges[:, 2] - x0) * (edges[:, 1] - y0), low)
    region = np.repeat(np.arange(len(rings)), rings)[some]
    middle = (edges[low, :2] + edges[low, 2:]) / 2
    odd = _crossings(edges, middle[:, 0], middle[:, 1], bounds[region], bounds[region + 1], ring, some)
    back = ((turn > 0) == odd)[at]
    edges = edges[np.where(back, (low + high - 1)[at] - np.arange(len(edges)), np.arange(len(edges)))]
    edges[back] = edges[back][:, [2, 3, 0, 1]]
    return edges, ring, bounds


def region_edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one region with the inside to their left, and the ring of each."""
    return _all_edges(x, y, sizes, np.array([len(sizes)]))[:2]


def _cross(edges: np.ndarray) -> np.ndarray:
    x, y = edges[:1, 0], edges[:1, 1]
    return (edges[:, 0] - x) * (edges[:, 3] - y) - (edges[:, 2] - x) * (edges[:, 1] - y)


def _near_edges(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of edges whose boxes touch, by a sweep over x, a bounded number at a time."""
    ax0, ax1, bx0, bx1 = np.minimum(a[:, 0], a[:, 2]), np.maximum(a[:, 0], a[:, 2]), np.minimum(b[:, 0], b[:, 2]), np.maximum(b[:, 0], b[:, 2])
    ay0, ay1, by0, by1 = np.minimum(a[:, 1], a[:, 3]), np.maximum(a[:, 1], a[:, 3]), np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3])
    order = np.argsort(bx0, kind="stable")
    reach = np.maximum.accumulate(bx1[order]) if len(order) else bx1
    first, stop = np.searchsorted(reach, ax0, "left"), np.searchsorted(bx0[order], ax1, "right")
    length = np.maximum(stop - first, 0)
    sums = np.append(0, np.cumsum(length))
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + CHUNK, "right")) - 1)
        i = np.repeat(np.arange(at, end), length[at:end])
        j = order[first[i] + np.arange(len(i)) - np.repeat(sums[at:end] - sums[at], length[at:end])]
        keep = (bx1[j] >= ax0[i]) & (ay0[i] <= by1[j]) & (by0[j] <= ay1[i])
        at = end
        yield i[keep], j[keep]


def _side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0])


def _on(e: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray:
    flat = (x >= np.minimum(e[:, 0], e[:, 2])) & (x <= np.maximum(e[:, 0], e[:, 2]))
    return (side == 0) & flat & (y >= np.minimum(e[:, 1], e[:, 3])) & (y <= np.maximum(e[:, 1], e[:, 3]))


def _candidates(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of edges of the two regions of each pair whose boxes touch, a bounded number at a time."""
    large = np.diff(wa) * np.diff(wb) > SWEPT
    pair = np.repeat(np.arange(len(wa) - 1), np.diff(wa))
    few = np.flatnonzero(~large[pair])
    low_a, high_a = np.minimum(a[:, :2], a[:, 2:]), np.maximum(a[:, :2], a[:, 2:])
    low_b, high_b = np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    for k, j in _expanded(wb[pair[few]], wb[pair[few] + 1]):
        i = few[k]
        keep = (low_a[i, 0] <= high_b[j, 0]) & (low_b[j, 0] <= high_a[i, 0]) & (low_a[i, 1] <= high_b[j, 1]) & (low_b[j, 1] <= high_a[i, 1])
        yield i[keep], j[keep]
    for p in np.flatnonzero(large).tolist():
        for i, j in _near_edges(a[wa[p] : wa[p + 1]], b[wb[p] : wb[p + 1]]):
            yield i + wa[p], j + wb[p]


def meeting_points(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge of a, x, y) and (edge of b, x, y) wherever edges of the two regions of a pair cross or touch."""
    on_a, on_b = [np.zeros((0, 3))], [np.zeros((0, 3))]

    def add(out: list, edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        out.append(np.stack([edge, x, y], 1))

    for i, j in _candidates(a, wa, b, wb):
        p, r = a[i], b[j]
        s1, s2, s3, s4 = _side(r, p[:, 0], p[:, 1]), _side(r, p[:, 2], p[:, 3]), _side(p, r[:, 0], r[:, 1]), _side(p, r[:, 2], r[:, 3])
        for e, k, side, edge in ((r, 0, s1, p), (r, 2, s2, p), (p, 0, s3, r), (p, 2, s4, r)):
            hit = _on(e, edge[:, k], edge[:, k + 1], side)
            for out, index in ((on_a, i), (on_b, j)):
                add(out, index[hit], edge[hit, k], edge[hit, k + 1])
        cut = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
        t = s1[cut] / (s1[cut] - s2[cut])
        x, y = p[cut, 0] + t * (p[cut, 2] - p[cut, 0]), p[cut, 1] + t * (p[cut, 3] - p[cut, 1])
        add(on_a, i[cut], x, y)
        add(on_b, j[cut], x, y)
    return np.concatenate(on_a), np.concatenate(on_b)


def _pieces(edges: np.ndarray, ring: np.ndarray, meets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges split at the points where they meet others, the run of each piece, and the edge it is of.

    A run goes on along its ring until the next such point, on one side of the
    other region."""
    index = np.concatenate([np.arange(len(edges)), meets[:, 0].astype(np.int64)])
    points = np.concatenate([edges[:, :2], meets[:, 1:]]) + 0.0
    hit = np.concatenate([np.zeros(len(edges), bool), np.ones(len(meets), bool)])
    e = edges[index]
    along = (points[:, 0] - e[:, 0]) * (e[:, 2] - e[:, 0]) + (points[:, 1] - e[:, 1]) * (e[:, 3] - e[:, 1])
    by = np.lexsort((~hit, along, index))
    index, points, hit, e = index[by], points[by], hit[by], e[by]
    after = np.append(index[1:] == index[:-1], False)
    ends = np.where(after[:, None], np.roll(points, -1, 0), e[:, 2:])
    full = (points != ends).any(1)
    # a point that stands twice on an edge starts one piece: it is met if either row says so
    group = np.cumsum(np.append(True, (index[1:] != index[:-1]) | (points[1:] != points[:-1]).any(1))[: len(index)]) - 1
    met = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    np.logical_or.at(met, group, hit)
    pieces, own = np.concatenate([points, ends], 1)[full], ring[index[full]]
    begins = met[group[full]] | np.append(True, own[1:] != own[:-1])[: len(own)]
    return pieces, np.cumsum(begins) - 1, index[full]


def intersections(a: np.ndarray, ra: np.ndarray, wa: np.ndarray, b: np.ndarray, rb: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of regions: directed edges around what the two share, the inside to their left; where those of each pair begin; whether the two touch at all."""
    n = len(wa) - 1
    on_a, on_b = meeting_points(a, wa, b, wb)
    of_a, of_b = np.repeat(np.arange(n), np.diff(wa)), np.repeat(np.arange(n), np.diff(wb))
    (pa_, runs_a, ea), (pb, runs_b, eb) = _pieces(a, ra, on_a), _pieces(b, rb, on_b)
    pair_a, pair_b = of_a[ea], of_b[eb]

    def within(pieces: np.ndarray, runs: np.ndarray, pair: np.ndarray, other: np.ndarray, where: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])[: len(runs)])
        middle = (pieces[first, :2] + pieces[first, 2:]) / 2
        return _crossings(other, middle[:, 0], middle[:, 1], where[pair[first]], where[pair[first] + 1])[runs]

    ends, pair = np.concatenate([pa_, pb]), np.concatenate([pair_a, pair_b])
    swap = (ends[:, 0] > ends[:, 2]) | ((ends[:, 0] == ends[:, 2]) & (ends[:, 1] > ends[:, 3]))
    ends = np.where(swap[:, None], ends[:, [2, 3, 0, 1]], ends)
    by = np.lexsort((*ends.T, pair))
    new = (ends[by][1:] != ends[by][:-1]).any(1) | (pair[by][1:] != pair[by][:-1])
    key = np.empty(len(by), np.int64)
    key[by] = np.cumsum(np.append(True, new)[: len(by)]) - 1
    key_a, key_b, swap_a, swap_b = key[: len(pa_)], key[len(pa_) :], swap[: len(pa_)], swap[len(pa_) :]
    shared_a, shared_b = np.isin(key_a, key_b), np.isin(key_b, key_a)
    same = np.isin(2 * key_a + swap_a, 2 * key_b + swap_b)
    keep_a = (within(pa_, runs_a, pair_a, b, wb) & ~shared_a) | (shared_a & same)
    keep_b = within(pb, runs_b, pair_b, a, wa) & ~shared_b
    kept, pair = np.concatenate([pa_[keep_a], pb[keep_b]]), np.concatenate([pair_a[keep_a], pair_b[keep_b]])
    by = np.argsort(pair, kind="stable")
    where = np.searchsorted(pair[by], np.arange(n + 1))
    touches = where[1:] > where[:-1]
    touches[of_a[on_a[:, 0].astype(np.int64)]] = True
    return kept[by], where, touches


def intersection(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, bool]:
    """``intersections`` of one pair."""
    edges, _, touches = intersections(a, ra, np.array([0, len(a)]), b, rb, np.array([0, len(b)]))
    return edges, bool(touches[0])


def _boxes(edges: np.ndarray, where: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1 around the edges of each region; without edges a box that touches none."""
    out = np.tile(np.array([np.inf, np.inf, -np.inf, -np.inf]), (len(where) - 1, 1))
    full = where[1:] > where[:-1]
    if full.any():
        at = where[:-1][full]
        out[full] = np.concatenate([np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), at), np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), at)], 1)
    return out


def touching(a: np.ndarray, ra: np.ndarray, wa: np.ndarray, b: np.ndarray, rb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """For pairs of regions: whether the two touch at all, as ``intersections`` has it, without working out what they share.

    Only edges that come near the other region's box are compared.  Where no
    edges meet, a ring lies whole on one side of the other region, and one of its points tells which."""
    sides = []
    for edges, ring, where, box in ((a, ra, wa, _boxes(b, wb)), (b, rb, wb, _boxes(a, wa))):
        pair = np.repeat(np.arange(len(where) - 1), np.diff(where))
        low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
        near = ((low <= box[pair, 2:]) & (box[pair, :2] <= high)).all(1)
        first = np.append(True, ring[1:] != ring[:-1])[: len(ring)]
        middle = (edges[first, :2] + edges[first, 2:]) / 2
        inside = ((box[pair[first], :2] <= middle) & (middle <= box[pair[first], 2:])).all(1)
        sides.append((edges[near], np.append(0, np.cumsum(near))[where], pair[near], middle[inside], pair[first][inside]))
    (na, nwa, pa_, ma, qa), (nb, nwb, _, mb, qb) = sides
    found = np.zeros(len(wa) - 1, bool)
    for i, j in _candidates(na, nwa, nb, nwb):
        p, r = na[i], nb[j]
        s1, s2, s3, s4 = _side(r, p[:, 0], p[:, 1]), _side(r, p[:, 2], p[:, 3]), _side(p, r[:, 0], r[:, 1]), _side(p, r[:, 2], r[:, 3])
        met = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
        for e, k, side, edge in ((r, 0, s1, p), (r, 2, s2, p), (p, 0, s3, r), (p, 2, s4, r)):
            met |= _on(e, edge[:, k], edge[:, k + 1], side)
        found[pa_[i[met]]] = True
    for middle, pair, other, where in ((ma, qa, b, wb), (mb, qb, a, wa)):
        open_ = ~found[pair]
        middle, pair = middle[open_], pair[open_]
        found[pair[_crossings(other, middle[:, 0], middle[:, 1], where[pair], where[pair + 1])]] = True
    return found


def closed_rings(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """The edges as rings; where several go on, the leftmost turn is taken, so rings only touch."""
    out: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for x0, y0, x1, y1 in edges.tolist():
        out.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    while out:
        start = next(iter(out))
        ring, here, before = [start], start, None
        while True:
            onward = out.get(here)
            if not onward:
                break
            pick = 0
            if len(onward) > 1 and before is not None:
                back = np.arctan2(before[1] - here[1], before[0] - here[0])
                turns = [(back - np.arctan2(y - here[1], x - here[0])) % (2 * np.pi) or 2 * np.pi for x, y in onward]
                pick = int(np.argmin(turns))
            there = onward.pop(pick)
            if not onward:
                del out[here]
            ring.append(there)
            before, here = here, there
            if here == start:
                break
        if len(ring) > 3 and ring[0] == ring[-1]:
            rings.append(ring)
    return rings


def measures(edges: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(areas, x, y): area and centroid of what the directed edges of each pair enclose; no centroid (NaN) without area."""
    own = np.repeat(where[:-1], np.diff(where))
    ox, oy = edges[own, 0], edges[own, 1]
    cross = (edges[:, 0] - ox) * (edges[:, 3] - oy) - (edges[:, 2] - ox) * (edges[:, 1] - oy)
    area = _sums(cross, where) / 2
    some = area > 0
    centre = []
    for k, o in ((0, ox), (1, oy)):
        moment, c = _sums((edges[:, k] + edges[:, k + 2] - 2 * o) * cross, where), np.full(len(area), np.nan)
        c[some] = moment[some] / (6 * area[some]) + edges[where[:-1][some], k]
        centre.append(c)
    return np.where(some, area, 0.0), *centre


def measured(edges: np.ndarray) -> tuple[float, float | None, float | None]:
    """``measures`` of one pair; no centroid without area."""
    area, x, y = (float(v[0]) for v in measures(edges, np.array([0, len(edges)])))
    return (area, x, y) if area else (0.0, None, None)


def _flat(region: str, prefix: str) -> list[Column]:
    """A region as three plain arrays, which Arrow hands over as numpy: x, y and vertices a ring."""
    rings = F.coalesce(F.col(region), F.array().cast(RINGS))
    points = F.flatten(rings)
    return [F.transform(points, lambda p: p["x"]).alias(f"{prefix}x"), F.transform(points, lambda p: p["y"]).alias(f"{prefix}y"), F.transform(rings, lambda r: F.size(r)).alias(f"{prefix}n")]


def _part(batch: pa.RecordBatch, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, vertices of each ring and rings of each region of some rows."""
    x, y, sizes = (batch.column(f"_{prefix}{c}") for c in "xyn")
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in (x, y, sizes)]
    return values[0], values[1], values[2].astype(np.int64), np.diff(sizes.offsets.to_numpy()).astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of batches, as many at a time as are worked out together."""
    for batch in batches:
        held = np.cumsum(sum(np.diff(batch.column(f"_{p}x").offsets.to_numpy()) for p in "ab"), dtype=np.int64)
        starts = np.flatnonzero(np.diff(held // TOGETHER, prepend=-1)).tolist()
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, stop - start)


def _nested(edges: np.ndarray, where: np.ndarray) -> pa.Array:
    """The closed rings of the edges of each pair, as Arrow holds them."""
    rings = [closed_rings(edges[a:b]) if b > a else [] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
    points = np.array([p for own in rings for r in own for p in r], float).reshape(-1, 2)
    offsets = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    flat = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(offsets([len(own) for own in rings]), pa.ListArray.from_arrays(offsets([len(r) for own in rings for r in own]), flat))


def overlay(pairs: DataFrame, a: str = "a", b: str = "b", geometry: bool = False) -> DataFrame:
    """``pairs`` without the regions ``a`` and ``b``, but with what these share.

    Adds touches (boundaries included), area, cx and cy (the centroid; null
    without area), and with ``geometry`` its rings.  Null and empty regions share
    nothing."""
    others = [c for c in pairs.columns if c not in (a, b)]
    added = [T.StructField("touches", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in ("area", "cx", "cy"))]
    if geometry:
        added.append(T.StructField("rings", T._parse_datatype_string(RINGS)))
    schema = T.StructType([*pairs.select(*others).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            edges, where, touches = intersections(*_all_edges(*_part(part, "a")), *_all_edges(*_part(part, "b")))
            area, x, y = measures(edges, where)
            columns = [pa.array(touches), pa.array(area), pa.array(x, mask=area == 0), pa.array(y, mask=area == 0)]
            if geometry:
                columns.append(_nested(edges, where))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], [*others, *(f.name for f in added)])

    return pairs.select(*others, *_flat(a, "_a"), *_flat(b, "_b")).mapInArrow(run, schema)


def _flat_with_box(df: DataFrame, region: str, prefix: str, names: tuple[str, str, str, str]) -> DataFrame:
    """``df`` with ``region`` as the three arrays of ``_flat`` and its box; regions without a vertex go.

    Boxes are made in Arrow batches, so that filters on them are not moved, with
    all the work on the region in them, to before the rows are dealt."""
    others = [c for c in df.columns if c != region]
    flat = df.select(*others, *_flat(region, prefix))
    schema = T.StructType([*flat.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(f"{prefix}x")
            batch = batch.filter(pc.greater(pc.list_value_length(lists), 0))
            xs, ys = batch.column(f"{prefix}x"), batch.column(f"{prefix}y")
            box = []
            if batch.num_rows:
                at = xs.offsets.to_numpy()[:-1] - xs.offsets[0].as_py()
                values = [c.flatten().to_numpy(zero_copy_only=False) for c in (xs, ys)]
                box = [f.reduceat(v, at) for f in (np.fmin, np.fmax) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in box or [np.zeros(0)] * 4)], [*batch.schema.names, *names])

    return flat.mapInArrow(run, schema)


def touching_regions(left: DataFrame, right: DataFrame, key: str, region: str, other: str, cell: float) -> DataFrame:
    """The rows of ``left`` whose region touches one of ``right``: a semi-join.

    Only keys and regions go through the exact test, which works out nothing but
    whether they touch; ``key`` is unique in ``left``."""
    a = _flat_with_box(left.select(key, region), region, "_a", ("x0", "y0", "x1", "y1"))
    b = _flat_with_box(right.select(other), other, "_b", ("u0", "v0", "u1", "v1"))
    pairs = near_pairs(a, b, cell).select(key, *(f"_{p}{c}" for p in "ab" for c in "xyn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            met = touching(*_plain_edges(*_part(part, "a")), *_plain_edges(*_part(part, "b")))
            yield part.select([key]).filter(pa.array(met))

    return left.join(pairs.mapInArrow(run, pairs.select(key).schema), key, "left_semi")


def flawed(edges: np.ndarray, ring: np.ndarray) -> bool:
    """Whether edges of a region cross, or run along each other."""
    for i, j in _near_edges(edges, edges):
        i, j = i[i < j], j[i < j]
        p, r = edges[i], edges[j]
        s1, s2, s3, s4 = _side(r, p[:, 0], p[:, 1]), _side(r, p[:, 2], p[:, 3]), _side(p, r[:, 0], r[:, 1]), _side(p, r[:, 2], r[:, 3])
        cross = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
        along = (s1 == 0) & (s2 == 0)
        k = np.where(np.abs(p[:, 2] - p[:, 0]) >= np.abs(p[:, 3] - p[:, 1]), 0, 1)[:, None]
        (p0, p1), (r0, r1) = (np.sort(np.concatenate([np.take_along_axis(e, k, 1), np.take_along_axis(e, k + 2, 1)], 1), 1).T for e in (p, r))
        if (cross | (along & (np.maximum(p0, r0) < np.minimum(p1, r1)))).any():
            return True
    return False


def with_validity(df: DataFrame, region: str, name: str = "valid") -> DataFrame:
    """Adds whether a region is fit for the operators here: closed rings of four
    vertices or more that enclose something, whose edges do not cross and do not
    run along each other.  Null and empty regions are not.  Nothing is repaired."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys, sizes in parts:
            yield pd.Series([_fit(np.asarray(x, float), np.asarray(y, float), np.asarray(n, int)) for x, y, n in zip(xs, ys, sizes)])

    return df.withColumn(name, F.pandas_udf(run, "boolean")(*_flat(region, "_")))


def _fit(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> bool:
    if not len(sizes) or (sizes < 4).any() or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return False
    ends = np.cumsum(sizes) - 1
    begins = ends - sizes + 1
    if (x[begins] != x[ends]).any() or (y[begins] != y[ends]).any():
        return False
    edges, ring = region_edges(x, y, sizes)
    return len(np.unique(ring)) == len(sizes) and not flawed(edges, ring) and all(_cross(edges[ring == k]).sum() != 0 for k in range(len(sizes)))


# Union of boxes


def covered_area(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> float:
    """The area that boxes cover, overlaps once: a sweep over x that counts cover on compressed y."""
    ys = np.unique(np.concatenate([y0, y1]))
    heights = np.diff(ys)
    lo, hi = np.searchsorted(ys, y0), np.searchsorted(ys, y1)
    x = np.concatenate([x0, x1])
    order = np.argsort(x, kind="stable")
    cover = np.zeros(len(heights), np.int64)
    total, at, n = 0.0, x[order[0]], len(x0)
    for k in order.tolist():
        if x[k] > at:
            total += (x[k] - at) * float(heights[cover > 0].sum())
            at = x[k]
        box = k % n
        cover[lo[box] : hi[box]] += 1 if k < n else -1
    return total


def box_union_area(boxes: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, area): the area that the boxes x0, y0, x1, y1 of a group cover, overlaps once.

    Boxes are cut at the cells of a grid, cells are swept one by one and their
    areas added up, so a group with very many boxes is spread over its cells; a
    task holds the boxes of one cell.  Boxes without area add nothing."""
    cut = boxes.where("x0 < x1 AND y0 < y1").select(*by, "x0", "y0", "x1", "y1")
    for name, lo, hi in (("_cx", "x0", "x1"), ("_cy", "y0", "y1")):
        cut = cut.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
        cut = cut.withColumn(lo, F.greatest(F.col(lo), F.col(name) * cell)).withColumn(hi, F.least(F.col(hi), (F.col(name) + 1) * cell))
    cut = cut.where("x0 < x1 AND y0 < y1").distinct()
    schema = T.StructType([*cut.select(*by).schema.fields, T.StructField("area", T.DoubleType())])

    def swept(part: pd.DataFrame) -> pd.DataFrame:
        area = covered_area(*(part[c].to_numpy() for c in ("x0", "y0", "x1", "y1")))
        return part[by].head(1).assign(area=area)

    cells = cut.groupBy(*by, "_cx", "_cy").applyInPandas(swept, schema)
    return cells.groupBy(*by).agg(F.sum("area").alias("area"))

"""A model over rasters: overlapping patches out of pixels, an injected batch function, one raster again.

Pixels travel in blocks of ``stride`` by ``stride``.  A task sees one strip at a
time: up to ``batch`` patches side by side, cut out of the blocks they cover, so
neither a tile's size nor the number of tiles bounds what fits.  Predictions
travel by block too, and a block is merged from the few patches that cover it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[np.ndarray], np.ndarray]
MERGES = ("max", "min", "replace")


def standard_scores(patch: np.ndarray) -> np.ndarray:
    """Each band of (rows, cols, bands) less its mean, over its deviation."""
    return (patch - patch.mean((0, 1))) / (patch.std((0, 1)) + 1e-6)


def _answers(predict: Batch, patches: np.ndarray) -> np.ndarray:
    """One value a pixel of each patch; a batch that fails is tried again patch by patch."""
    try:
        out = predict(patches)
    except Exception:
        if len(patches) == 1:
            raise
        out = np.concatenate([np.asarray(predict(patches[k : k + 1])) for k in range(len(patches))])
    return np.asarray(out, float).reshape(patches.shape[:3])


def predicted(
    pixels: DataFrame,
    predict: Batch,
    bands: list[str],
    size: int = 256,
    stride: int = 128,
    batch: int = 8,
    merge: str = "max",
    normalise: Callable[[np.ndarray], np.ndarray] | None = standard_scores,
    tile: str = "tile_ord",
) -> DataFrame:
    """(tile, r, c, p, confidence, overlap) for each pixel of each tile's extent.

    Patches of ``size`` start at every multiple of ``stride`` inside the tile.
    ``normalise`` sees the part of a patch that lies in the tile; what hangs
    over is zero.  ``predict`` takes (n, size, size, bands), n at most ``batch``,
    and returns a value a pixel; it is pickled to the workers and should keep a
    large model in its module.  ``p`` merges the patches that cover a pixel: max
    (0 or more), min (1 or less) or replace (the patch furthest right, of these
    the lowest); ``confidence`` is their mean.

    A tile reaches from (0, 0) to its largest r and c.  A place without a row,
    and a null or NaN value, is 0; rows without tile, r or c, or with a negative
    one, are left out; of repeated places the largest values count."""
    if not 0 < stride <= size or batch < 1 or merge not in MERGES:
        raise ValueError("0 < stride <= size, batch >= 1, merge one of " + ", ".join(MERGES))
    key = F.col(f"`{tile}`")
    values = [F.coalesce(F.nanvl(F.col(f"`{b}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"v{k}") for k, b in enumerate(bands)]
    px = pixels.select(key.alias("t"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *values).where("t IS NOT NULL AND r >= 0 AND c >= 0")
    names = [f"v{k}" for k in range(len(bands))]
    reach = -(-size // stride)  # blocks that a patch touches on an axis
    block = lambda c: F.floor(F.col(c) / stride).cast("int")
    pos = ((F.col("r") % stride) * stride + F.col("c") % stride).alias("pos")
    blocks = px.groupBy("t", block("r").alias("br"), block("c").alias("bc")).agg(F.collect_list(F.struct(pos, *names)).alias("px"))
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    zero = F.lit(0)
    first = lambda c: F.greatest(zero, F.col(c) - (reach - 1))
    # Strip (i, g) holds the patches i and g * batch ... g * batch + batch - 1 of rows and columns.
    dealt = blocks.withColumn("i", each(first("br"), F.col("br"))).withColumn(
        "g", each(F.floor(first("bc") / batch).cast("int"), F.floor(F.col("bc") / batch).cast("int")))
    extent = px.groupBy("t").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    strips = extent.withColumn("i", each(zero, block("h"))).withColumn(
        "g", each(zero, F.floor(F.col("w") / (stride * batch)).cast("int")))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    arrays = ["pos", *names]
    parts = dealt.select("t", "i", "g", none("h", "int"), none("w", "int"), "br", "bc", *[F.col(f"px.{a}").alias(a) for a in arrays])
    heads = strips.select("t", "i", "g", "h", "w", none("br", "int"), none("bc", "int"), *[none(a, dict(parts.dtypes)[a]) for a in arrays])
    kind = dict(px.dtypes)["t"]

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf.h.notna()].iloc[0]
        t, i, g, h, w = head.t, int(head.i), int(head.g), int(head.h) + 1, int(head.w) + 1
        js = range(g * batch, min((g + 1) * batch, -(-w // stride)))
        span = (len(js) - 1 + reach) * stride
        field = np.zeros((reach * stride, span, len(names)))
        for row in pdf[pdf.br.notna()].itertuples(index=False):
            at = np.asarray(row.pos)
            rr, cc = (int(row.br) - i) * stride + at // stride, (int(row.bc) - js[0]) * stride + at % stride
            for k, name in enumerate(names):
                # Ascending, so that of repeated places the largest value is set last.
                v = np.asarray(getattr(row, name))
                up = np.argsort(v, kind="stable")
                field[rr[up], cc[up], k] = v[up]
        patches = np.zeros((len(js), size, size, len(names)))
        high = min(size, h - i * stride)
        for n, j in enumerate(js):
            wide = min(size, w - j * stride)
            real = field[:high, n * stride : n * stride + wide]
            patches[n, :high, :wide] = normalise(real) if normalise else real
        answers = _answers(predict, patches)
        out = []
        for n, j in enumerate(js):
            wide = min(size, w - j * stride)
            for a in range(0, high, stride):
                for b in range(0, wide, stride):
                    piece = answers[n, a : min(a + stride, high), b : min(b + stride, wide)]
                    out.append((t, i + a // stride, j + b // stride, i, j, *piece.shape, piece.ravel(), h, w))
        return pd.DataFrame(out, columns=["t", "br", "bc", "i", "j", "high", "wide", "p", "h", "w"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf.br.iloc[0]) * stride, int(pdf.bc.iloc[0]) * stride
        shape = min(stride, int(pdf.h.iloc[0]) - top), min(stride, int(pdf.w.iloc[0]) - left)
        best = np.full(shape, 1.0 if merge == "min" else 0.0)
        total, overlap = np.zeros(shape), np.zeros(shape, int)
        for row in pdf.sort_values(["j", "i"]).itertuples(index=False):
            cut = np.s_[: row.high, : row.wide]
            p = np.asarray(row.p).reshape(row.high, row.wide)
            best[cut] = p if merge == "replace" else (np.maximum if merge == "max" else np.minimum)(best[cut], p)
            total[cut] += p
            overlap[cut] += 1
        r, c = np.indices(shape)
        return pd.DataFrame({"t": [pdf.t.iloc[0]] * r.size, "r": r.ravel() + top, "c": c.ravel() + left, "p": best.ravel(), "confidence": (total / np.maximum(overlap, 1)).ravel(), "overlap": overlap.ravel()})

    pieces = parts.unionByName(heads).groupBy("t", "i", "g").applyInPandas(strip, f"t {kind}, br int, bc int, i int, j int, high int, wide int, p array<double>, h int, w int")
    out = pieces.groupBy("t", "br", "bc").applyInPandas(merged, f"t {kind}, r long, c long, p double, confidence double, overlap long")
    return out.select(F.col("t").alias(tile), "r", "c", "p", "confidence", "overlap")

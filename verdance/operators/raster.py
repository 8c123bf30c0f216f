"""Pixels to objects: labelling per tile in numpy, everything else relational."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_pixels(rows: np.ndarray, cols: np.ndarray, connectivity: int) -> np.ndarray:
    """Component of each pixel: the smallest row * 2^20 + col in it."""
    code = rows.astype(np.int64) << 20 | cols.astype(np.int64)
    order = np.argsort(code)
    sorted_code = code[order]
    label = sorted_code.copy()
    steps = [1, 1 << 20] + ([(1 << 20) + 1, (1 << 20) - 1] if connectivity == 8 else [])
    pairs = []
    for step in steps:
        at = np.minimum(np.searchsorted(sorted_code, sorted_code + step), len(code) - 1)
        hit = sorted_code[at] == sorted_code + step
        pairs.append((np.flatnonzero(hit), at[hit]))
    while True:
        before = label.copy()
        for a, b in pairs:
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        label = label[np.searchsorted(sorted_code, label)]
        if (label == before).all():
            break
    out = np.empty_like(label)
    out[order] = label
    return out


def labelled(pixels: DataFrame, connectivity: int = 4, tile: str = "tile_ord") -> DataFrame:
    """Adds ``label`` to pixels (tile, r, c, v).  One task holds one tile's pixels, which its size bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["label"] = label_pixels(pdf["r"].to_numpy(), pdf["c"].to_numpy(), connectivity)
        return pdf

    return pixels.groupBy(tile).applyInPandas(run, pixels.schema.simpleString()[7:-1].replace(":", " ") + ", label long")


def region_table(labelled_pixels: DataFrame, tile: str = "tile_ord") -> DataFrame:
    """Area, centroid, box and mean intensity of each component."""
    return labelled_pixels.groupBy(tile, "label").agg(
        F.count("*").alias("area"),
        F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"),
        F.avg("r").alias("row"), F.avg("c").alias("col"), F.avg("v").alias("mean_v"),
        F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
    )

"""Queries that run a model over tiles, patch by patch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from verdance.operators import patches as P
from verdance.plans.reports import query
from verdance.sources.adapters import load


def _edge_aware(batch: np.ndarray) -> np.ndarray:
    """A stand-in for a network: each pixel, and its neighbour on the right inside the patch."""
    z = batch[..., 0]
    right = np.zeros_like(z)
    right[:, :, :-1] = z[:, :, 1:]
    return 0.5 + 0.2 * z + 0.1 * right


# The twin lays out every pixel of each tile's extent, cuts it into patches and judges each apart.
_PATCHES = """e AS (SELECT tile_ord, max(r) h, max(c) w FROM fx_pixels GROUP BY 1),
 d AS (SELECT tile_ord, h, w, r, unnest(range(0,w+1)) c FROM (SELECT *, unnest(range(0,h+1)) r FROM e)),
 f AS (SELECT d.*, coalesce(v,0) v FROM d LEFT JOIN fx_pixels p ON p.tile_ord=d.tile_ord AND p.r=d.r AND p.c=d.c),
 o AS (SELECT tile_ord, r, c, v, pr, pc FROM f, (SELECT unnest(range(0,64,24)) pr), (SELECT unnest(range(0,64,24)) pc) WHERE r BETWEEN pr AND pr+31 AND c BETWEEN pc AND pc+31),
 z AS (SELECT *, (v-avg(v) OVER w)/(stddev_pop(v) OVER w+1E-6) z FROM o WINDOW w AS (PARTITION BY tile_ord, pr, pc)),
 m AS (SELECT *, 0.5E0+0.2E0*z+0.1E0*coalesce(lead(z) OVER (PARTITION BY tile_ord, pr, pc, r ORDER BY c),0) p FROM z)"""


def _sql(merged: str) -> str:
    return f"WITH {_PATCHES} SELECT tile_ord, r, c, round({merged},5) p, round(avg(p),5) confidence, count(*) overlap FROM m GROUP BY 1,2,3"


def _stitched(spark, sf_dir, merge):
    (px,) = load(spark, sf_dir, "fx_pixels")
    out = P.predicted(px, _edge_aware, ["v"], size=32, stride=24, batch=2, merge=merge)
    return out.select("tile_ord", "r", "c", F.round("p", 5).alias("p"), F.round("confidence", 5).alias("confidence"), "overlap")


@query(_sql("greatest(0.0E0,max(p))"))
def predicted_max(spark, sf_dir):
    """Patches of 32 in steps of 24 through a model, the largest answer a pixel and the mean of all."""
    return _stitched(spark, sf_dir, "max")


@query(_sql("least(1.0E0,min(p))"))
def predicted_min(spark, sf_dir):
    """The same with the least answer a pixel."""
    return _stitched(spark, sf_dir, "min")


@query(_sql("arg_max(p,pc*1000+pr)"))
def predicted_replace(spark, sf_dir):
    """The same with the answer of the last patch: column by column, each from the top."""
    return _stitched(spark, sf_dir, "replace")

"""Queries of polygons with polygons, and the density reports that clip units to their city.

Parcels are L-shaped with a hole, one for each customer; city boundaries are
larger ones, one for each region.  The twins know them as boxes to add and to
take away, the queries only as rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions import geometry as G
from verdance.operators import overlay as O
from verdance.operators import spatial as S
from verdance.plans.reports import query
from verdance.sources.adapters import load

#: Width and height of the foot, width and top of the stem, and the hole, of both shapes.
PARCEL, BOUNDARY = (4.0, 2.0, 2.0, 5.0, (0.5, 0.5, 1.0, 1.5)), (60.0, 30.0, 30.0, 70.0, (5.0, 5.0, 12.0, 20.0))


def _shape(x: str, y: str, shape: tuple) -> Column:
    width, height, stem, top, (a, b, c, d) = shape
    outer = [(0.0, 0.0), (width, 0.0), (width, height), (stem, height), (stem, top), (0.0, top), (0.0, 0.0)]
    hole = [(a, b), (a, d), (c, d), (c, b), (a, b)]
    ring = lambda corners: F.array(*[F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for dx, dy in corners])
    return F.array(ring(outer), ring(hole))


def _boxes(x: str, y: str, shape: tuple) -> str:
    """The shape's boxes as rows (a, b, c, d, s) in SQL: two that count, one that is taken away."""
    width, height, stem, top, hole = shape
    rows = [(0.0, 0.0, width, height, 1), (0.0, height, stem, top, 1), (*hole, -1)]
    return "(VALUES " + ",".join(f"({a}E0,{b}E0,{c}E0,{d}E0,{s})" for a, b, c, d, s in rows) + ") v(a,b,c,d,s)"


def _parcels(spark, sf_dir) -> DataFrame:
    (parcels,) = load(spark, sf_dir, "fx_parcels")
    return S.dealt(parcels, "parcel").select("parcel", _shape("px", "py", PARCEL).alias("rings"))


def _boundaries(spark, sf_dir) -> DataFrame:
    (bounds,) = load(spark, sf_dir, "fx_bounds")
    return bounds.select("city", _shape("ox", "oy", BOUNDARY).alias("rings"))


def _units(spark, sf_dir) -> DataFrame:
    (units,) = load(spark, sf_dir, "fx_units")
    return S.with_box_ring(units).withColumn("rings", F.array("ring"))


_CUT = f"""p AS (SELECT parcel, px+a AS a, py+b AS b, px+c AS c, py+d AS d, s FROM fx_parcels, {_boxes("px", "py", PARCEL)}),
 k AS (SELECT parcel, unit_ord, s, greatest(a,x0) a, greatest(b,y0) b, least(c,x1) c, least(d,y1) d FROM p JOIN fx_units ON a<x1 AND x0<c AND b<y1 AND y0<d),
 m AS (SELECT parcel, unit_ord, sum(s*(c-a)*(d-b)) w, sum(s*(c-a)*(d-b)*(a+c)/2) mx, sum(s*(c-a)*(d-b)*(b+d)/2) my FROM k GROUP BY 1,2)"""


@query(f"WITH {_CUT} SELECT parcel, unit_ord, round(w,7) area, round(mx/w,6) cx, round(my/w,6) cy FROM m WHERE w>1e-7")
def overlay_area(spark, sf_dir):
    """What each parcel and each unit share: area and centroid."""
    a = O.with_box(_parcels(spark, sf_dir).withColumnRenamed("rings", "a"), "a")
    units = _units(spark, sf_dir).select("unit_ord", F.col("rings").alias("b"), *[F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"))])
    shared = O.overlay(O.near_pairs(a, units, 20.0).select("parcel", "unit_ord", "a", "b")).where("area > 1e-7")
    return shared.select("parcel", "unit_ord", F.round("area", 7).alias("area"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


_BOUND = f"(SELECT city, ox, oy, ox+a AS a, oy+b AS b, ox+c AS c, oy+d AS d, s FROM fx_bounds, {_boxes('ox', 'oy', BOUNDARY)})"


@query(f"""WITH p AS (SELECT parcel, px, py, px+a AS a, py+b AS b, px+c AS c, py+d AS d FROM fx_parcels, {_boxes("px", "py", PARCEL)} WHERE s=1), b AS {_BOUND}
 SELECT DISTINCT parcel FROM p JOIN b ON b.s=1 AND p.a<=b.c AND b.a<=p.c AND p.b<=b.d AND b.b<=p.d
 WHERE NOT (px>ox+5 AND px+4<ox+12 AND py>oy+5 AND py+5<oy+20)""")
def polygon_semi(spark, sf_dir):
    """Parcels that touch a city; one that lies in a city's hole does not touch that city."""
    return O.touching_regions(_parcels(spark, sf_dir), _boundaries(spark, sf_dir), "parcel", "rings", "rings", 20.0).select("parcel")


@query(f"SELECT city, round(sum(w),5) area, count(*) n_parcels FROM (SELECT k.city, k.parcel, sum(k.w) w FROM (SELECT city, parcel, q.s*b.s*(least(q.c,b.c)-greatest(q.a,b.a))*(least(q.d,b.d)-greatest(q.b,b.b)) w FROM (SELECT parcel, px+a AS a, py+b AS b, px+c AS c, py+d AS d, s FROM fx_parcels, {_boxes('px', 'py', PARCEL)}) q JOIN {_BOUND} b ON q.a<b.c AND b.a<q.c AND q.b<b.d AND b.b<q.d) k GROUP BY 1,2) WHERE w>1e-7 GROUP BY 1")
def clipped_parcels(spark, sf_dir):
    """Parcels clipped to cities as new geometries; the area is that of the clipped rings."""
    a = O.with_box(_parcels(spark, sf_dir).withColumnRenamed("rings", "a"), "a")
    b = O.with_box(_boundaries(spark, sf_dir).withColumnRenamed("rings", "b"), "b", ("u0", "v0", "u1", "v1"))
    cut = O.overlay(O.near_pairs(a, b, 20.0).select("parcel", "city", "a", "b"), geometry=True).where("area > 1e-7")
    # what lies inside a clip's rings turns left, so that holes count against their outer rings
    area = F.aggregate(F.transform("rings", G.signed_area), F.lit(0.0), lambda s, x: s + x)
    return cut.groupBy("city").agg(F.round(F.sum(area), 5).alias("area"), F.count("*").alias("n_parcels"))


_UTM = G.utm_forward_sql("lon", "lat", 14)


@query(f"""WITH v AS (SELECT parcel, r, i, -97.75E0+(px+dx)/1000.0E0 lon, 30.2E0+(py+dy)/1000.0E0 lat FROM fx_parcels,
  (VALUES (0,0,0.0E0,0.0E0),(0,1,4.0E0,0.0E0),(0,2,4.0E0,2.0E0),(0,3,2.0E0,2.0E0),(0,4,2.0E0,5.0E0),(0,5,0.0E0,5.0E0),
          (1,0,0.5E0,0.5E0),(1,1,0.5E0,1.5E0),(1,2,1.0E0,1.5E0),(1,3,1.0E0,0.5E0)) w(r,i,dx,dy)),
 u AS (SELECT parcel, r, i, {_UTM[0]} e, {_UTM[1]} n FROM v),
 c AS (SELECT parcel, e-e0 e, n-n0 n, coalesce(lead(e) OVER w, first_value(e) OVER w)-e0 e1, coalesce(lead(n) OVER w, first_value(n) OVER w)-n0 n1
       FROM (SELECT *, min(e) OVER (PARTITION BY parcel) e0, min(n) OVER (PARTITION BY parcel) n0 FROM u) WINDOW w AS (PARTITION BY parcel, r ORDER BY i)),
 s AS (SELECT parcel, e, n, e1, n1, e*n1-e1*n x FROM c)
 SELECT parcel, round(sum(x)/2,2) area_m2, round(sum((e+e1)*x)/(3*sum(x)),3) cx, round(sum((n+n1)*x)/(3*sum(x)),3) cy FROM s GROUP BY 1""")
def parcel_utm_area(spark, sf_dir):
    """Area in square metres, and the centroid from the lower left corner, of polygons in degrees."""
    (parcels,) = load(spark, sf_dir, "fx_parcels")
    placed = S.dealt(parcels, "parcel").select("parcel", _shape("px", "py", PARCEL).alias("rings"))
    degrees = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((-97.75 + p["x"] / 1000.0).alias("x"), (30.2 + p["y"] / 1000.0).alias("y"))))
    metres = O.with_box(placed.select("parcel", G.to_utm(degrees, F.lit(14)).alias("rings")), "rings")
    local = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - F.col("x0")).alias("x"), (p["y"] - F.col("y0")).alias("y"))))
    local = metres.select("parcel", local.alias("rings"))
    cx, cy = G.polygon_centroid(F.col("rings"))
    return local.select("parcel", F.round(G.polygon_area(F.col("rings")), 2).alias("area_m2"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


@query("""WITH t AS (SELECT unit_ord, greatest(t.x0,u.x0) x0, greatest(t.y0,u.y0) y0, least(t.x1,u.x1) x1, least(t.y1,u.y1) y1
   FROM fx_tiles t JOIN fx_units u ON t.x0<u.x1 AND u.x0<t.x1 AND t.y0<u.y1 AND u.y0<t.y1),
 xs AS (SELECT unit_ord, a, lead(a) OVER (PARTITION BY unit_ord ORDER BY a) c FROM (SELECT unit_ord, x0 a FROM t UNION SELECT unit_ord, x1 FROM t)),
 ys AS (SELECT unit_ord, b, lead(b) OVER (PARTITION BY unit_ord ORDER BY b) d FROM (SELECT unit_ord, y0 b FROM t UNION SELECT unit_ord, y1 FROM t))
 SELECT xs.unit_ord, round(sum((c-a)*(d-b)),6) area FROM xs JOIN ys ON xs.unit_ord=ys.unit_ord AND c IS NOT NULL AND d IS NOT NULL
 WHERE EXISTS (SELECT 1 FROM t WHERE t.unit_ord=xs.unit_ord AND x0<=a AND c<=x1 AND y0<=b AND d<=y1) GROUP BY 1""")
def union_area(spark, sf_dir):
    """The area of each unit that its tiles cover, overlaps once."""
    tiles, units = load(spark, sf_dir, "fx_tiles", "fx_units")
    a = tiles.select("tile_ord", "x0", "y0", "x1", "y1")
    b = units.select("unit_ord", *[F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"))])
    cut = O.near_pairs(a, b, 20.0).select("unit_ord", F.greatest("x0", "u0").alias("x0"), F.greatest("y0", "v0").alias("y0"), F.least("x1", "u1").alias("x1"), F.least("y1", "v1").alias("y1"))
    return O.box_union_area(cut, ["unit_ord"], 5.0).select("unit_ord", F.round("area", 6).alias("area"))


# Densities of units that are clipped to their city.  Places are hundredths of a degree, from latitude 30 on.


def clipped_units(units: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Units that touch the boundary of their ``city``, with ``area_km2`` of the part inside.

    A unit that only touches has area 0."""
    b = O.with_box(boundaries.select(F.col("city").alias("of"), F.col("rings").alias("b")), "b", ("u0", "v0", "u1", "v1"))
    pairs = O.near_pairs(units.select("unit_ord", "city", F.col("rings").alias("a"), "x0", "y0", "x1", "y1"), b, 20.0).where("city = of")
    shared = O.overlay(pairs.select("unit_ord", "a", "b")).where("touches")
    km2 = G.degrees_to_km2(F.col("area") / 10000.0, 30.0 + F.coalesce("cy", F.lit(0.0)) / 100.0)
    return units.join(shared.select("unit_ord", km2.alias("area_km2")), "unit_ord")


_AREA = f"""b AS {_BOUND},
 bg AS (SELECT DISTINCT u.unit_ord, u.city, x0, y0, x1, y1 FROM fx_units u JOIN b ON u.city=b.city AND b.s=1 AND x0<=c AND a<=x1 AND y0<=d AND b.b<=y1),
 q AS (SELECT unit_ord, s, greatest(x0,a) a, greatest(y0,b.b) b, least(x1,c) c, least(y1,d) d FROM bg JOIN b ON bg.city=b.city AND x0<c AND a<x1 AND y0<d AND b.b<y1),
 w AS (SELECT unit_ord, sum(s*(c-a)*(d-b)) w, sum(s*(c-a)*(d-b)*(b+d)/2) my FROM q GROUP BY 1),
 ar AS (SELECT bg.*, CASE WHEN w>0 THEN w/10000.0E0*12391.0E0*cos(radians(30.0E0+my/w/100.0E0)) ELSE 0.0E0 END area_km2 FROM bg LEFT JOIN w ON bg.unit_ord=w.unit_ord)"""


@query(f"""WITH {_AREA},
 t AS (SELECT inv_id, i.city, x, y FROM (SELECT inv_id, unit_ord % 5 city, x, y FROM fx_inventory) i JOIN fx_bounds o ON i.city=o.city
       WHERE ((x>ox AND x<ox+60 AND y>oy AND y<oy+30) OR (x>ox AND x<ox+30 AND y>=oy+30 AND y<oy+70)) AND NOT (x BETWEEN ox+5 AND ox+12 AND y BETWEEN oy+5 AND oy+20)),
 h AS (SELECT inv_id, min(unit_ord) unit_ord FROM t JOIN bg ON t.city=bg.city AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
 n AS (SELECT unit_ord, count(*) trees FROM h GROUP BY 1), total AS (SELECT city, count(*) total_trees FROM t GROUP BY 1)
 SELECT ar.unit_ord, ar.city, coalesce(trees,0) trees, round(area_km2,5) area_km2, round(CASE WHEN area_km2=0 THEN 0.0E0 ELSE coalesce(trees,0)/area_km2 END,6) tree_density, coalesce(total_trees,0) total_trees
 FROM ar LEFT JOIN n ON ar.unit_ord=n.unit_ord LEFT JOIN total ON ar.city=total.city""")
def inventory_density(spark, sf_dir):
    """Inventory trees inside their city, counted by unit, over the part of the unit inside the city."""
    (inventory,) = load(spark, sf_dir, "fx_inventory")
    boundaries = _boundaries(spark, sf_dir)
    trees = inventory.select("inv_id", (F.col("unit_ord") % 5).alias("city"), "x", "y").join(boundaries, "city")
    trees = trees.where(G.in_region(F.col("rings"), F.col("x"), F.col("y"))).drop("rings")
    units = clipped_units(_units(spark, sf_dir), boundaries)
    hits = S.points_in_polygons(trees, units.select("unit_ord", F.col("city").alias("of"), "ring", "x0", "y0", "x1", "y1"), 20.0).where("city = of")
    counts = S.first_match(hits.select("inv_id", "unit_ord"), "inv_id", "unit_ord").groupBy("unit_ord").agg(F.count("*").alias("trees"))
    total = trees.groupBy("city").agg(F.count("*").alias("total_trees"))
    rows = units.join(counts, "unit_ord", "left").join(total, "city", "left").na.fill(0, ["trees", "total_trees"])
    density = F.when(F.col("area_km2") == 0, 0.0).otherwise(F.col("trees") / F.col("area_km2"))
    return rows.select("unit_ord", "city", "trees", F.round("area_km2", 5).alias("area_km2"), F.round(density, 6).alias("tree_density"), "total_trees")


_MODEL = f"""WITH {_AREA}, t AS (SELECT tree_id, x, y FROM fx_trees WHERE x<62.0E0),
 h AS (SELECT tree_id, min(unit_ord) unit_ord FROM t JOIN bg ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
 n AS (SELECT unit_ord, count(*) tree_count FROM h GROUP BY 1),
 d AS (SELECT ar.unit_ord, city, coalesce(tree_count,0) tree_count, area_km2, CASE WHEN area_km2>0 THEN coalesce(tree_count,0)/area_km2 END tree_density,
   EXISTS (SELECT 1 FROM fx_tiles f WHERE f.x0-0.1E0<=ar.x1 AND ar.x0<=f.x1+0.1E0 AND f.y0-0.1E0<=ar.y1 AND ar.y0<=f.y1+0.1E0) covered FROM ar LEFT JOIN n ON ar.unit_ord=n.unit_ord)"""


def _model_units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    trees, tiles = load(spark, sf_dir, "fx_trees", "fx_tiles")
    trees = trees.where("x < 62").select("tree_id", "x", "y")
    units = clipped_units(_units(spark, sf_dir), _boundaries(spark, sf_dir))
    hits = S.first_match(S.points_in_polygons(trees, units.select("unit_ord", "ring", "x0", "y0", "x1", "y1"), 20.0).select("tree_id", "unit_ord"), "tree_id", "unit_ord")
    counts = hits.groupBy("unit_ord").agg(F.count("*").alias("tree_count"))
    grown = tiles.select((F.col("x0") - 0.1).alias("u0"), (F.col("y0") - 0.1).alias("v0"), (F.col("x1") + 0.1).alias("u1"), (F.col("y1") + 0.1).alias("v1"))
    covered = O.near_pairs(units.select("unit_ord", "x0", "y0", "x1", "y1"), grown, 20.0).select("unit_ord").distinct().withColumn("covered", F.lit(True))
    rows = units.join(counts, "unit_ord", "left").join(covered, "unit_ord", "left").na.fill(0, ["tree_count"]).na.fill(False, ["covered"])
    density = F.when(F.col("area_km2") > 0, F.col("tree_count") / F.col("area_km2"))
    return rows.select("unit_ord", "city", "tree_count", "area_km2", density.alias("tree_density"), "covered"), trees


@query(_MODEL + " SELECT unit_ord, city, tree_count, round(area_km2,5) area_km2, round(tree_density,6) tree_density, covered FROM d")
def model_density(spark, sf_dir):
    """Detected trees by unit over the part inside the city; no density without area."""
    rows, _ = _model_units(spark, sf_dir)
    return rows.withColumn("area_km2", F.round("area_km2", 5)).withColumn("tree_density", F.round("tree_density", 6))


@query(_MODEL + """ SELECT city, count(*) n_units, CAST(sum(tree_count) AS BIGINT) assigned, count(*) FILTER (WHERE tree_count>0) with_trees, count(*) FILTER (WHERE tree_count=0 AND area_km2>0) n_zero,
 count(*) FILTER (WHERE tree_count=0 AND area_km2>0 AND covered) zero_covered, round(coalesce(sum(area_km2) FILTER (WHERE tree_count=0 AND area_km2>0 AND covered),0.0E0),5) zero_area_km2,
 count(*) FILTER (WHERE tree_density IS NULL) no_data, any_value((SELECT count(*) FROM t)-(SELECT count(*) FROM h)) outside FROM d GROUP BY 1""")
def model_density_check(spark, sf_dir):
    """How many units of a city have trees, none, none though covered, and no data; trees of all cities outside."""
    rows, trees = _model_units(spark, sf_dir)
    zero = (F.col("tree_count") == 0) & (F.col("area_km2") > 0)
    by_city = rows.groupBy("city").agg(
        F.count("*").alias("n_units"), F.sum("tree_count").alias("assigned"), F.count_if(F.col("tree_count") > 0).alias("with_trees"), F.count_if(zero).alias("n_zero"),
        F.count_if(zero & F.col("covered")).alias("zero_covered"), F.round(F.coalesce(F.sum(F.when(zero & F.col("covered"), F.col("area_km2"))), F.lit(0.0)), 5).alias("zero_area_km2"),
        F.count_if(F.col("tree_density").isNull()).alias("no_data"),
    )
    outside = trees.agg(F.count("*").alias("n")).crossJoin(by_city.agg(F.sum("assigned").alias("in"))).select((F.col("n") - F.col("in")).alias("outside"))
    return by_city.crossJoin(outside)  # one row

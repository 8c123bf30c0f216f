"""Queries of tiles of crowns: shapes of regions, scores of tiles, and counts clipped to the city.

The adapter's crowns never touch, so that a twin knows each region by its
crown; it knows hulls by their support in all directions that their edges have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.operators import clipping as K
from verdance.operators import raster as R
from verdance.operators import regions as A
from verdance.operators import spatial as S
from verdance.plans.overlays import BOUNDARY, _boundaries, _boxes
from verdance.plans.reports import query
from verdance.sources.adapters import load

SIZE = 256


def _regions(pixels: DataFrame) -> DataFrame:
    found = R.labelled(pixels.where("v > 0.3").select("tile_ord", "r", "c", "v"))
    return R.region_table(found).join(A.region_shapes(found), ["tile_ord", "label"])


_SHAPES = """g AS (SELECT * FROM fx_crowns WHERE v>0.3E0),
 reg AS (SELECT tile_ord, kind, min(r*1048576+c) AS label, count(*) AS area, avg(r) AS mr, avg(c) AS mc, avg(v) AS mean_v, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM g GROUP BY crown, 1, 2),
 s AS (SELECT g.kind, r, c FROM g JOIN (SELECT min(crown) AS crown FROM g GROUP BY kind) o ON o.crown=g.crown),
 sup AS (SELECT kind, a, b, max(a*r+b*c)+greatest(abs(a),abs(b))/2.0E0 AS h FROM s, range(-27,28) t(a), range(-27,28) u(b) GROUP BY 1,2,3),
 box AS (SELECT kind, r, unnest(range(c0,c1+1)) AS c FROM (SELECT kind, unnest(range(min(r),max(r)+1)) AS r, min(c) AS c0, max(c) AS c1 FROM s GROUP BY 1)),
 hull AS (SELECT kind, count(*) AS convex_area FROM (SELECT box.kind, r, c FROM box JOIN sup ON sup.kind=box.kind GROUP BY 1,2,3 HAVING bool_and(a*r+b*c<=h)) GROUP BY 1),
 border AS (SELECT p.kind, p.r, p.c FROM s p JOIN s q ON p.kind=q.kind AND abs(p.r-q.r)+abs(p.c-q.c)=1 GROUP BY 1,2,3 HAVING count(*)<4),
 code AS (SELECT p.kind, 1+2*count(*) FILTER (WHERE abs(p.r-q.r)+abs(p.c-q.c)=1)+10*count(*) FILTER (WHERE abs(p.r-q.r)=1 AND abs(p.c-q.c)=1) AS code
   FROM border p JOIN border q ON p.kind=q.kind AND abs(p.r-q.r)<=1 AND abs(p.c-q.c)<=1 GROUP BY p.kind, p.r, p.c),
 line AS (SELECT kind, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1.0E0 WHEN code IN (21,33) THEN sqrt(2.0E0) WHEN code IN (13,23) THEN (1+sqrt(2.0E0))/2 ELSE 0.0E0 END) AS perimeter FROM code GROUP BY 1),
 shp AS (SELECT reg.*, perimeter, convex_area, area*1.0E0/convex_area AS solidity FROM reg JOIN hull ON hull.kind=reg.kind JOIN line ON line.kind=reg.kind)"""


@query(f"WITH {_SHAPES} SELECT tile_ord, label, area, round(perimeter,7) AS perimeter, convex_area, round(solidity,9) AS solidity FROM shp")
def region_shapes(spark, sf_dir):
    """Area, outline, pixels of the convex hull and solidity of each region."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    return _regions(pixels).select("tile_ord", "label", "area", F.round("perimeter", 7).alias("perimeter"), "convex_area", F.round("solidity", 9).alias("solidity"))


@query(f"""WITH {_SHAPES} SELECT a.tile_ord, a.label, round(sqrt(min((a.mr-b.mr)*(a.mr-b.mr)+(a.mc-b.mc)*(a.mc-b.mc))),7) AS distance
 FROM shp a LEFT JOIN shp b ON a.tile_ord=b.tile_ord AND a.label<>b.label GROUP BY 1,2""")
def crown_neighbours(spark, sf_dir):
    """Distance of each crown's centroid to the nearest other one of its tile."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    centres = R.region_table(R.labelled(pixels.where("v > 0.3").select("tile_ord", "r", "c", "v"))).select("tile_ord", "label", F.col("col").alias("x"), F.col("row").alias("y"))
    return A.nearest_neighbours(centres, ["tile_ord"], "label", 16.0).withColumn("distance", F.round("distance", 7))


def _tile_stats(pixels: DataFrame) -> DataFrame:
    n, on = float(SIZE * SIZE), F.col("v") > 0.3
    mean = F.sum("v") / n
    spread = F.sqrt(F.sum(F.col("v") * F.col("v")) / n - mean * mean)
    apart = F.sum(F.when(on, F.col("v"))) / F.count_if(on) - F.sum(F.when(~on, F.col("v")).otherwise(0.0)) / (n - F.count_if(on))
    t = F.col("tile_ord")
    stats = pixels.groupBy("tile_ord").agg(F.max("v").alias("peak"), spread.alias("spread"), F.count_if(on).alias("foreground"), apart.alias("apart"))
    stats = stats.withColumn("n_sources", t % 3).withColumn("confidence", F.when(t % 2 == 1, 0.2 + 0.6 * (t % 5) / 5.0))
    return stats.withColumn("ndvi_apart", F.when(t % 3 > 0, F.col("apart"))).drop("apart")


_STATS = """st AS (SELECT tile_ord, max(v) AS peak, sqrt(sum(v*v)/65536-(sum(v)/65536)*(sum(v)/65536)) AS spread, count(*) FILTER (WHERE v>0.3E0) AS fore,
   CASE WHEN tile_ord%2=1 THEN 0.2E0+0.6E0*(tile_ord%5)/5.0E0 END AS conf,
   CASE WHEN tile_ord%3>0 THEN avg(v) FILTER (WHERE v>0.3E0)-coalesce(sum(v) FILTER (WHERE NOT v>0.3E0),0)/(65536-count(*) FILTER (WHERE v>0.3E0)) END AS apart FROM fx_crowns GROUP BY 1)"""
_ASPECT = "greatest(r1-r0+1,c1-c0+1)*1.0E0/(least(r1-r0+1,c1-c0+1)+1)"


@query(f"""WITH {_SHAPES}, {_STATS}, k AS (SELECT *, area BETWEEN 10 AND 2500 AND {_ASPECT}<=4 AND solidity>=0.3E0 AS good FROM shp),
 e AS (SELECT tile_ord, count(*) AS n, count(*) FILTER (WHERE good) AS m, avg(mean_v) FILTER (WHERE good) AS trust FROM k GROUP BY 1)
 SELECT st.tile_ord, CASE WHEN m<5 THEN n ELSE m END AS n_trees, CASE WHEN m<5 THEN 0.0E0 ELSE round(trust*(CASE WHEN m BETWEEN 10 AND 25 THEN 1.2E0 ELSE 1.0E0 END)*m/(n+1)*(1.0E0+0.5E0*(st.tile_ord%3)),7) END AS score
 FROM st JOIN e ON e.tile_ord=st.tile_ord""")
def tile_score_crowns(spark, sf_dir):
    """Score B of each tile, with source images for some."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    scores = A.crown_score(_tile_stats(pixels), _regions(pixels))
    return scores.select("tile_ord", F.col("n_trees").cast("long").alias("n_trees"), F.round("score", 7).alias("score"))


@query(f"""WITH {_SHAPES}, {_STATS}, k AS (SELECT *, {_ASPECT}<=4 AND area BETWEEN 10 AND 2500 AS shaped, r0<=3 OR c0<=3 OR r1>=251 OR c1>=251 AS edge FROM shp),
 h AS (SELECT *, shaped AND solidity>=0.25E0 AND NOT (edge AND area>500) AS good FROM k),
 d AS (SELECT a.tile_ord, a.label, sqrt(min((a.mr-b.mr)*(a.mr-b.mr)+(a.mc-b.mc)*(a.mc-b.mc))) AS d FROM h a JOIN h b ON a.good AND b.good AND a.tile_ord=b.tile_ord AND a.label<>b.label GROUP BY 1,2),
 nn AS (SELECT tile_ord, avg(d) AS nn FROM d GROUP BY 1),
 e AS (SELECT tile_ord, count(*) AS n, count(*) FILTER (WHERE good) AS m, count(*) FILTER (WHERE shaped AND edge) AS edges,
   avg(0.6E0*solidity+0.4E0*least(1.0E0,4*pi()*area/(CASE WHEN perimeter>0 THEN perimeter*perimeter ELSE 1.0E0 END))) FILTER (WHERE good) AS shape,
   avg(CASE WHEN tile_ord%2=1 THEN 1-mean_v ELSE mean_v END) FILTER (WHERE good) AS trust, avg(area) FILTER (WHERE good) AS ma, stddev_pop(area) FILTER (WHERE good) AS sa,
   count(DISTINCT (mr<128)::INT*2+(mc<128)::INT) FILTER (WHERE good) AS quarters FROM h GROUP BY 1),
 q AS (SELECT st.*, e.n, e.m, (0.25E0*least(1.0E0,coalesce(2.5E0*abs(apart),0.5E0))+0.15E0*(0.6E0*quarters/4+0.4E0*least(1.0E0,nn/30.0E0))
   +0.15E0*(CASE WHEN fore/65536.0E0>0.5E0 THEN 0.05E0 WHEN m>40 THEN 0.1E0 WHEN m>35 THEN 0.2E0 WHEN m<=15 THEN 1.0E0 WHEN m<=25 THEN 0.8E0 ELSE 0.4E0 END)
   +0.12E0*coalesce(conf,0.5E0)+0.12E0*shape+0.08E0*trust+0.05E0*m/(n+1)+0.04E0*greatest(0.0E0,1-0.3E0*sa/(ma+1))+0.04E0*greatest(0.0E0,1-0.15E0*edges))
   *(CASE WHEN conf>0.6E0 THEN 1.15E0 ELSE 1.0E0 END) AS quality FROM st JOIN e ON e.tile_ord=st.tile_ord LEFT JOIN nn ON nn.tile_ord=st.tile_ord)
 SELECT tile_ord, CASE WHEN spread<0.02E0 THEN 0 WHEN m<5 THEN n ELSE m END AS n_trees, CASE WHEN spread<0.02E0 OR m<5 THEN 0.0E0 ELSE round(quality,7) END AS quality, spread>=0.02E0 AND m>=5 AND quality>0.2E0 AS is_good FROM q""")
def tile_score_quality(spark, sf_dir):
    """Score C of each tile: nine soft weights over shapes, spacing, density and confidence."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    regions = _regions(pixels).withColumn("confidence", F.when(F.col("tile_ord") % 2 == 1, 1 - F.col("mean_v")))
    scores = A.quality_score(_tile_stats(pixels), S._kept(regions))  # used more than once, worked out once
    return scores.select("tile_ord", F.col("n_trees").cast("long").alias("n_trees"), F.round("quality", 7).alias("quality"), "is_good")


@query("""WITH RECURSIVE p AS (SELECT crown, r, c, r*256+c AS k FROM fx_crowns WHERE v>0.5E0),
 s(crown, k, l) AS (SELECT crown, k, k FROM p UNION SELECT b.crown, b.k, s.l FROM s JOIN p a ON a.crown=s.crown AND a.k=s.k JOIN p b ON a.crown=b.crown AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1),
 m AS (SELECT crown, k, min(l) AS l FROM s GROUP BY 1,2),
 n AS (SELECT (crown-crown%30)//30 AS tile_ord, count(DISTINCT crown*65536+l) AS parts FROM m GROUP BY 1),
 t AS (SELECT tile_ord, count(*) AS n, count(*) FILTER (WHERE v>0.5E0) AS hits, max(v)<0.01E0 AS blank, sqrt(sum(v*v)/65536-(sum(v)/65536)*(sum(v)/65536)) AS spread FROM fx_crowns GROUP BY 1),
 q AS (SELECT t.*, 0.3E0*(1-abs(hits*1.0E0/n-0.2E0)/0.2E0)+0.3E0/(1+coalesce(parts,0)/10.0E0)+0.2E0*least(1.0E0,coalesce(hits*1.0E0/parts,0)/100)+0.2E0*least(1.0E0,spread*30/2) AS quality FROM t LEFT JOIN n ON n.tile_ord=t.tile_ord),
 k AS (SELECT tile_ord%5 AS city, tile_ord, round(quality,7) AS quality FROM q WHERE (tile_ord%7)*0.0002E0<=0.001E0 AND (tile_ord%4)*0.0004E0<=0.001E0 AND NOT blank AND hits*1.0E0/n<=0.4E0 AND quality>=0.3E0)
 SELECT city, tile_ord, quality FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY quality DESC, tile_ord) AS i FROM k) WHERE i=1""")
def best_tile(spark, sf_dir):
    """Score A, and the best tile of each city whose images lie together and are not too dense."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    t, n = F.col("tile_ord"), float(SIZE * SIZE)
    on = pixels.where("v > 0.5").select("tile_ord", "r", "c", "v")
    parts = R.labelled(on, 8).groupBy("tile_ord").agg(F.count_distinct("label").alias("parts"))
    mean = F.sum("v") / n
    spread = F.sqrt(F.sum(F.col("v") * F.col("v")) / n - mean * mean)
    tiles = pixels.groupBy("tile_ord").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0.5).alias("hits"), (F.max("v") < 0.01).alias("blank"), spread.alias("spread"))
    tiles = tiles.join(parts, "tile_ord", "left").fillna(0, ["parts"])
    quality = A.fragmentation_score(F.col("hits"), F.col("n"), F.col("parts"), 20 * F.col("spread"), 10 * F.col("spread"))
    tiles = tiles.select((t % 5).alias("city"), "tile_ord", ((t % 7) * 0.0002).alias("pan_off"), ((t % 4) * 0.0004).alias("ndvi_off"), "blank", (F.col("hits") / F.col("n")).alias("density"), F.round(quality, 7).alias("quality"))
    return A.best_candidates(tiles, "city", "tile_ord")


def _placed(spark, sf_dir) -> DataFrame:
    """Tiles of 8 by 8 units on the map; the sixth city has no boundary."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    t = F.col("tile_ord")
    tiles = pixels.select("tile_ord").distinct().select("tile_ord", (t % 6).alias("city"), (t * 7 % 50).cast("double").alias("x0"), (t * 11 % 50).cast("double").alias("y0"))
    return tiles.withColumn("x1", F.col("x0") + 8).withColumn("y1", F.col("y0") + 8).withColumn("width", F.lit(SIZE)).withColumn("height", F.lit(SIZE))


_TILES = "tl AS (SELECT DISTINCT tile_ord, tile_ord%6 AS city, (tile_ord*7%50)*1.0E0 AS x0, (tile_ord*11%50)*1.0E0 AS y0 FROM fx_crowns)"
_PARTS = f"bx AS (SELECT city, ox+a AS a, oy+b AS b, ox+c AS c, oy+d AS d, s FROM fx_bounds, {_boxes('ox', 'oy', BOUNDARY)})"
#: Pixels whose centres lie in as many boxes that count as are needed and in none that is taken away.
_IN = "(SELECT sum(s) FROM bx WHERE bx.city=z.city AND x>a AND x<c AND y>b AND y<d)"


@query(f"""WITH {_TILES}, {_PARTS} SELECT tile_ord, city FROM tl WHERE city NOT IN (SELECT city FROM fx_bounds) OR (
 EXISTS (SELECT 1 FROM bx WHERE bx.city=tl.city AND s=1 AND x0<=c AND a<=x0+8 AND y0<=d AND b<=y0+8)
 AND NOT EXISTS (SELECT 1 FROM bx WHERE bx.city=tl.city AND s=-1 AND x0>a AND x0+8<c AND y0>b AND y0+8<d))""")
def tiles_near_city(spark, sf_dir):
    """Tiles that touch their city's boundary; all of a city without one."""
    return K.near_regions(_placed(spark, sf_dir), _boundaries(spark, sf_dir), "city").select("tile_ord", "city")


@query(f"""WITH {_TILES}, {_PARTS}, z AS (SELECT tile_ord, city, r, x0+(c+0.5E0)/32 AS x, y0+8-(r+0.5E0)/32 AS y FROM tl, range(256) t(r), range(256) u(c)),
 i AS (SELECT tile_ord, r, s FROM z JOIN bx ON bx.city=z.city AND x>a AND x<bx.c AND y>b AND y<d)
 SELECT tile_ord, r, CAST(sum(s) AS BIGINT) AS n_pixels FROM i GROUP BY 1,2 HAVING sum(s)>0""")
def region_raster(spark, sf_dir):
    """Boundaries as pixels of the tiles: how many there are in each row."""
    tiles = _placed(spark, sf_dir).join(_boundaries(spark, sf_dir), "city")
    return K.region_runs(tiles).groupBy("tile_ord", "r").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_pixels"))


@query(f"""WITH RECURSIVE {_TILES}, {_PARTS}, z AS (SELECT tl.tile_ord, city, crown, r, c AS pc, x0+(c+0.5E0)/32 AS x, y0+8-(r+0.5E0)/32 AS y FROM tl JOIN fx_crowns f ON f.tile_ord=tl.tile_ord AND v>0.3E0),
 p AS (SELECT tile_ord, crown, r, pc, r*256+pc AS k FROM z WHERE {_IN}>0),
 s(crown, k, l) AS (SELECT crown, k, k FROM p UNION SELECT b.crown, b.k, s.l FROM s JOIN p a ON a.crown=s.crown AND a.k=s.k JOIN p b ON a.crown=b.crown AND abs(a.r-b.r)+abs(a.pc-b.pc)=1),
 m AS (SELECT crown, k, min(l) AS l FROM s GROUP BY 1,2),
 n AS (SELECT (crown-crown%30)//30 AS tile_ord, count(DISTINCT crown*65536+l) AS n_objects, count(*) AS n_pixels FROM m GROUP BY 1),
 w AS (SELECT tile_ord, CAST(sum(s*(greatest(0,least(c,x0+8)-greatest(a,x0))*greatest(0,least(d,y0+8)-greatest(b,y0))))*1024 AS BIGINT) AS total_pixels FROM tl JOIN bx ON bx.city=tl.city GROUP BY 1)
 SELECT w.tile_ord, total_pixels=65536 AS inside, coalesce(n_objects,0) AS n_objects, coalesce(n_pixels,0) AS n_pixels, total_pixels FROM w LEFT JOIN n ON n.tile_ord=w.tile_ord""")
def clipped_tile_count(spark, sf_dir):
    """Crowns and canopy of each tile within its city; a boundary may split a crown."""
    (pixels,) = load(spark, sf_dir, "fx_crowns")
    tiles = _placed(spark, sf_dir).join(_boundaries(spark, sf_dir), "city")
    return K.clipped_counts(pixels.select("tile_ord", "r", "c", "v"), tiles, 0.3)

"""Smaller queries: names, bounds, summaries, classes and pixel operators, each with an SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdance.functions import cleaning as C
from verdance.plans.reports import query
from verdance.sources.adapters import load

#: Degrees of a pixel, and the corner that offsets count from.
PIXEL, LEFT, TOP = 0.0001, -100.0, 40.0


@query("""SELECT filename, 1 AS is_prediction FROM fx_tiles WHERE starts_with(filename,'pred_') AND filename LIKE '%.tif'
 AND filename NOT LIKE '%_confidence%' AND lower(filename) LIKE '%austin%' AND lower(filename) NOT LIKE '%atlanta%' AND tile_ord % 4 IN (1,2)""")
def tile_name_predicates(spark, sf_dir):
    """Directory predicate, case-insensitive city, and membership."""
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    name = F.col("filename")
    keep = name.startswith("pred_") & name.endswith(".tif") & ~name.contains("_confidence") & F.lower(name).contains("austin") & ~F.lower(name).contains("atlanta")
    return tiles.where(keep & (F.col("tile_ord") % 4).isin(1, 2)).select("filename", F.lit(1).alias("is_prediction"))


@query("""WITH n AS (SELECT tile_ord, replace(filename, '.tif', CASE WHEN tile_ord % 2=0 THEN '_confidence.tif' ELSE '_patch_7.tif' END) f FROM fx_tiles)
 SELECT f AS filename, replace(replace(replace(replace(f,'pred_pan_',''),'pred_ndvi_',''),'_confidence',''),'.tif','') AS base_a,
  regexp_replace(regexp_replace(f,'^pred_(pan|ndvi)_',''),'\\.tif$','') AS base_b, replace(replace(f,'pan','#'),'ndvi','#') AS base_c,
  CAST(regexp_extract_all(f,'([0-9]+)-([0-9]+)',1)[-1] AS BIGINT) AS last_x, CAST(nullif(regexp_extract(f,'_patch_([0-9]+)',1),'') AS BIGINT) AS patch,
  CASE regexp_extract(f,'([0-9]{3}_[0-9]{3})',1) WHEN '036_101' THEN '039_101' ELSE regexp_extract(f,'([0-9]{3}_[0-9]{3})',1) END AS tile_id FROM n""")
def tile_name_parts(spark, sf_dir):
    """Three ways to a base name, the last offset, the patch number, and the id correction map."""
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    tail = F.when(F.col("tile_ord") % 2 == 0, "_confidence.tif").otherwise("_patch_7.tif")
    f = F.replace(F.col("filename"), F.lit(".tif"), tail).alias("filename")
    n, c = tiles.select(f), F.col("filename")
    a = c
    for part in ("pred_pan_", "pred_ndvi_", "_confidence", ".tif"):
        a = F.replace(a, F.lit(part), F.lit(""))
    b = F.replace(F.replace(c, F.lit("pan"), F.lit("#")), F.lit("ndvi"), F.lit("#"))
    offsets = F.regexp_extract_all(c, F.lit("([0-9]+)-([0-9]+)"), F.lit(1))
    own = C.tile_id(c)
    return n.select(
        "filename", a.alias("base_a"), C.base_name(c).alias("base_b"), b.alias("base_c"), F.element_at(offsets, -1).try_cast("bigint").alias("last_x"),
        F.nullif(F.regexp_extract(c, "_patch_([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("patch"), F.when(own == "036_101", "039_101").otherwise(own).alias("tile_id"),
    )


_AFFINE = """o AS (SELECT tile_ord, CAST(regexp_extract(filename,'([0-9]+)-([0-9]+)',1) AS BIGINT) ox, CAST(regexp_extract(filename,'([0-9]+)-([0-9]+)',2) AS BIGINT) oy FROM fx_tiles),
 b AS (SELECT tile_ord, -100.0E0+ox*0.0001E0 x0, 40.0E0-oy*0.0001E0 y1, CASE WHEN tile_ord % 5=0 THEN ox ELSE ox+256 END*0.0001E0-100.0E0 x1, 40.0E0-(oy+256)*0.0001E0 y0 FROM o)"""


@query(f"""WITH {_AFFINE}
 SELECT tile_ord, round(least(x0,x1),6) AS left_, round(greatest(x0,x1),6) AS right_, round(least(y0,y1),6) AS bottom, round(greatest(y0,y1),6) AS top,
  round(x0+10.5E0*0.0001E0,6) AS centre_x, round(x0+10*0.0001E0,6) AS corner_x, round(0.0001E0*111320.0E0*cos(radians((y0+y1)/2)),4) AS metres_a_pixel
 FROM b WHERE abs(x1-x0) >= 1E-6 AND abs(y1-y0) >= 1E-6 AND x0 BETWEEN -180.1E0 AND 180.1E0 AND y0 BETWEEN -90.1E0 AND 90.1E0""")
def tile_bounds(spark, sf_dir):
    """Affine bounds from offsets, put in order; degenerate and implausible ones go; pixel to world by centre and corner; ground distance."""
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    o = tiles.select("tile_ord", C.offset(F.col("filename"), 1).alias("ox"), C.offset(F.col("filename"), 2).alias("oy"))
    far = F.when(F.col("tile_ord") % 5 == 0, F.col("ox")).otherwise(F.col("ox") + 256)
    b = o.select("tile_ord", (F.lit(LEFT) + F.col("ox") * PIXEL).alias("x0"), (F.lit(TOP) - F.col("oy") * PIXEL).alias("y1"), (far * PIXEL + LEFT).alias("x1"), (F.lit(TOP) - (F.col("oy") + 256) * PIXEL).alias("y0"))
    b = b.where((F.abs(F.col("x1") - F.col("x0")) >= 1e-6) & (F.abs(F.col("y1") - F.col("y0")) >= 1e-6) & F.col("x0").between(-180.1, 180.1) & F.col("y0").between(-90.1, 90.1))
    return b.select(
        "tile_ord", F.round(F.least("x0", "x1"), 6).alias("left_"), F.round(F.greatest("x0", "x1"), 6).alias("right_"), F.round(F.least("y0", "y1"), 6).alias("bottom"), F.round(F.greatest("y0", "y1"), 6).alias("top"),
        F.round(F.col("x0") + 10.5 * PIXEL, 6).alias("centre_x"), F.round(F.col("x0") + 10 * PIXEL, 6).alias("corner_x"),
        F.round(F.lit(PIXEL * 111320.0) * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2)), 4).alias("metres_a_pixel"),
    )


@query("SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM fx_tiles")
def total_bounds(spark, sf_dir):
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    return tiles.agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))


_Q = "quantile_cont(CAST(crown_area_px AS DOUBLE), {})"


@query(f"""SELECT unit_ord, count(*) AS n, round(avg(crown_area_px),6) AS mean, round(stddev_samp(crown_area_px),6) AS std, min(crown_area_px) AS least, max(crown_area_px) AS most,
  round({_Q.format('0.25')},6) AS q25, round({_Q.format('0.5')},6) AS q50, round({_Q.format('0.75')},6) AS q75 FROM fx_trees GROUP BY 1""")
def unit_describe(spark, sf_dir):
    (trees,) = load(spark, sf_dir, "fx_trees")
    v = F.col("crown_area_px")
    q = [F.round(F.percentile(v, p), 6).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return trees.groupBy("unit_ord").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), *q)


@query(f"""SELECT tile_ord, count(*) AS n, sum(crown_area_px)::BIGINT AS total, round(avg(crown_area_px),6) AS mean, round(stddev_pop(crown_area_px),6) AS std, round({_Q.format('0.9')},6) AS p90,
  round({_Q.format('0.95')},6) AS p95, round({_Q.format('0.99')},6) AS p99, count(*) FILTER (WHERE crown_area_px>40) AS large, round(100.0E0*count(*) FILTER (WHERE crown_area_px>40)/count(*),6) AS large_pct FROM fx_detections GROUP BY 1""")
def blob_size_stats(spark, sf_dir):
    (d,) = load(spark, sf_dir, "fx_detections")
    v = F.col("crown_area_px")
    q = [F.round(F.percentile(v, p), 6).alias(n) for p, n in ((0.9, "p90"), (0.95, "p95"), (0.99, "p99"))]
    large = F.count_if(v > 40)
    return d.groupBy("tile_ord").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), *q, large.alias("large"), F.round(100.0 * large / F.count("*"), 6).alias("large_pct"))


@query("""WITH t AS (SELECT tile_ord % 4 AS city, tile_ord, count(*) FILTER (WHERE v>0.3E0) hit, count(*) n FROM fx_pixels GROUP BY 1,2)
 SELECT city, round(100.0E0*sum(hit)/sum(n),6) AS pooled, round(min(100.0E0*hit/n),6) AS least, round(max(100.0E0*hit/n),6) AS most, round(avg(100.0E0*hit/n),6) AS mean, round(stddev_pop(100.0E0*hit/n),6) AS std FROM t GROUP BY 1""")
def canopy_two_level(spark, sf_dir):
    (px,) = load(spark, sf_dir, "fx_pixels")
    t = px.groupBy((F.col("tile_ord") % 4).alias("city"), "tile_ord").agg(F.count_if(F.col("v") > 0.3).alias("hit"), F.count("*").alias("n"))
    share = 100.0 * F.col("hit") / F.col("n")
    return t.groupBy("city").agg(F.round(100.0 * F.sum("hit") / F.sum("n"), 6).alias("pooled"), F.round(F.min(share), 6).alias("least"), F.round(F.max(share), 6).alias("most"), F.round(F.avg(share), 6).alias("mean"), F.round(F.stddev_pop(share), 6).alias("std"))


@query("""WITH t AS (SELECT tile_ord % 5 AS city, tile_ord, count(*) n FROM fx_detections GROUP BY 1,2)
 SELECT city, sum(n)::BIGINT AS trees, count(*) AS tiles, arg_max(tile_ord, n*1000000-tile_ord) AS most_tile, arg_min(tile_ord, n*1000000+tile_ord) AS least_tile,
  rank() OVER (ORDER BY sum(n) DESC) AS place FROM t GROUP BY 1""")
def tile_city_fold(spark, sf_dir):
    """Tiles folded to cities, with the tile of most and of fewest trees (ties: the first), by number of trees."""
    (d,) = load(spark, sf_dir, "fx_detections")
    t = d.groupBy((F.col("tile_ord") % 5).alias("city"), "tile_ord").agg(F.count("*").alias("n"))
    out = t.groupBy("city").agg(F.sum("n").alias("trees"), F.count("*").alias("tiles"), F.max_by("tile_ord", F.struct("n", -F.col("tile_ord"))).alias("most_tile"), F.min_by("tile_ord", F.struct("n", "tile_ord")).alias("least_tile"))
    return out.withColumn("place", F.rank().over(W.orderBy(F.desc("trees"))).cast("bigint"))


@query("""WITH c AS (SELECT CAST(u.city AS STRING) city, count(*) n, CAST(round(avg(crown_area_px),2) AS DOUBLE) m FROM fx_trees t JOIN fx_units u USING (unit_ord) GROUP BY 1)
 SELECT city, n, m AS mean_area, 'city' AS kind FROM c UNION ALL SELECT 'Total', sum(n)::BIGINT, round(avg(m),2), '-' FROM c""")
def mixed_total_row(spark, sf_dir):
    """City rows and a total that sums counts, averages averages, and has a dash for text."""
    trees, units = load(spark, sf_dir, "fx_trees", "fx_units")
    c = trees.join(units.select("unit_ord", "city"), "unit_ord").groupBy(F.col("city").cast("string").alias("city")).agg(F.count("*").alias("n"), F.round(F.avg("crown_area_px"), 2).alias("mean_area"))
    total = c.agg(F.lit("Total").alias("city"), F.sum("n").alias("n"), F.round(F.avg("mean_area"), 2).alias("mean_area")).withColumn("kind", F.lit("-"))
    return c.withColumn("kind", F.lit("city")).unionByName(total)


@query("""WITH q AS (SELECT quantile_cont(CAST(crown_area_px AS DOUBLE),0.33) a, quantile_cont(CAST(crown_area_px AS DOUBLE),0.67) b, quantile_cont(CAST(crown_area_px AS DOUBLE),0.333) c, quantile_cont(CAST(crown_area_px AS DOUBLE),0.95) d FROM fx_trees)
 SELECT CASE WHEN crown_area_px<=a THEN 'low' WHEN crown_area_px>=b THEN 'high' ELSE 'medium' END AS class, crown_area_px<=c AS lowest_third, count(*) AS n,
  round(max(least(crown_area_px, least(150.0E0,d))),6) AS capped, max(greatest(0.0E0,least(crown_area_px,50.0E0))) AS clamped FROM fx_trees, q GROUP BY 1,2""")
def percentile_classes(spark, sf_dir):
    """33/67 classes, the 0.333 cut, the cap at the 95th percentile, and the colour clamp; quantiles are one row."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    v = F.col("crown_area_px")
    q = trees.agg(*[F.percentile(v, p).alias(n) for p, n in ((0.33, "a"), (0.67, "b"), (0.333, "c"), (0.95, "d"))])
    both = trees.crossJoin(F.broadcast(q))  # one row
    label = F.when(v <= F.col("a"), "low").when(v >= F.col("b"), "high").otherwise("medium")
    return both.groupBy(label.alias("class"), (v <= F.col("c")).alias("lowest_third")).agg(
        F.count("*").alias("n"), F.round(F.max(F.least(v, F.least(F.lit(150.0), F.col("d")))), 6).alias("capped"), F.max(F.greatest(F.lit(0.0), F.least(v, F.lit(50.0)))).alias("clamped"))


@query("""WITH u AS (SELECT t.unit_ord, u.city, median(CAST(crown_area_px AS DOUBLE)) m, max(median_income) inc FROM fx_trees t JOIN fx_units u USING (unit_ord) JOIN fx_income i ON i.unit_ord=t.unit_ord WHERE median_income IS NOT NULL GROUP BY 1,2),
 b AS (SELECT quantile_cont(inc,0.3333) a, quantile_cont(inc,0.6667) b FROM u), c AS (SELECT CASE WHEN inc<=a THEN 1 WHEN inc<=b THEN 2 ELSE 3 END k, m FROM u, b)
 SELECT round(median(m) FILTER (WHERE k=1),6) AS low, round(median(m) FILTER (WHERE k=2),6) AS middle, round(median(m) FILTER (WHERE k=3),6) AS high, round(median(m) FILTER (WHERE k=3)-median(m) FILTER (WHERE k=1),6) AS difference FROM c""")
def tertile_medians(spark, sf_dir):
    trees, income = load(spark, sf_dir, "fx_trees", "fx_income")
    u = trees.join(income.where("median_income IS NOT NULL"), "unit_ord").groupBy("unit_ord").agg(F.median("crown_area_px").alias("m"), F.max("median_income").alias("inc"))
    edges = u.agg(F.percentile("inc", 0.3333).alias("a"), F.percentile("inc", 0.6667).alias("b"))
    k = F.when(F.col("inc") <= F.col("a"), 1).when(F.col("inc") <= F.col("b"), 2).otherwise(3)
    c = u.crossJoin(F.broadcast(edges)).select(k.alias("k"), "m")  # one row
    m = [F.median(F.when(F.col("k") == i, F.col("m"))) for i in (1, 2, 3)]
    return c.agg(F.round(m[0], 6).alias("low"), F.round(m[1], 6).alias("middle"), F.round(m[2], 6).alias("high"), F.round(m[2] - m[0], 6).alias("difference"))


@query("""SELECT unit_ord, tree_id FROM (SELECT unit_ord, tree_id, row_number() OVER (PARTITION BY unit_ord ORDER BY (tree_id*7919+17) % 10007, tree_id) k FROM fx_trees) WHERE k<=3""")
def seeded_sample(spark, sf_dir):
    """Three trees a unit without replacement, in the order of a seeded hash: the cap is the feature."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    k = F.row_number().over(W.partitionBy("unit_ord").orderBy((F.col("tree_id") * 7919 + 17) % 10007, "tree_id"))
    return trees.withColumn("k", k).where("k <= 3").select("unit_ord", "tree_id")


@query("""WITH a AS (SELECT filename f, regexp_replace(regexp_replace(filename,'^pred_(pan|ndvi)_',''),'\\.tif$','') b, tile_ord t FROM fx_tiles)
 SELECT x.f AS filename, coalesce(e.f, (SELECT min(y.f) FROM a y WHERE y.t % 2=1 AND regexp_extract(y.f,'(_austin_.*)$',1)=regexp_extract(x.f,'(_austin_.*)$',1))) AS partner
 FROM a x LEFT JOIN (SELECT b, min(f) f FROM a WHERE t % 2=1 GROUP BY 1) e ON e.b=x.b WHERE x.t % 2=0""")
def partner_fallback(spark, sf_dir):
    """Each even tile's partner: by equal base name, else the first with the same tail of the name."""
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    a = tiles.select("tile_ord", "filename", C.base_name(F.col("filename")).alias("b"), F.regexp_extract("filename", "(_austin_.*)$", 1).alias("tail"))
    odd = a.where("tile_ord % 2 = 1")
    exact = odd.groupBy("b").agg(F.min("filename").alias("e"))
    loose = odd.groupBy("tail").agg(F.min("filename").alias("l"))
    out = a.where("tile_ord % 2 = 0").join(exact, "b", "left").join(loose, "tail", "left")
    return out.select("filename", F.coalesce("e", "l").alias("partner"))


@query("""SELECT unit_ord, round(median_income/1.37E0,6) AS usd, median_income > 0 AND unit_ord >= 0 AS valid, CASE WHEN unit_ord % 5=0 THEN 1 ELSE 0 END AS city_0, CASE WHEN unit_ord % 5=1 THEN 1 ELSE 0 END AS city_1,
  round(ln(1+median_income),6) AS log_income, CASE WHEN median_income>=1000000 THEN round(median_income/1000000,1)::DOUBLE::STRING || 'M' WHEN median_income>=1000 THEN CAST(floor(median_income/1000) AS BIGINT)::STRING || 'K' ELSE CAST(floor(median_income) AS BIGINT)::STRING END AS tick,
  CASE WHEN median_income<10000 THEN 5000 WHEN median_income<40000 THEN 20000 ELSE 50000 END AS bar FROM fx_income""")
def income_formats(spark, sf_dir):
    """Currency, validity, dummies, log1p, K/M ticks, and a length out of a list."""
    (income,) = load(spark, sf_dir, "fx_income")
    v = F.col("median_income")
    whole = lambda x: F.floor(x).cast("bigint").cast("string")
    tick = F.when(v >= 1_000_000, F.concat(F.round(v / 1_000_000, 1).cast("string"), F.lit("M"))).when(v >= 1000, F.concat(whole(v / 1000), F.lit("K"))).otherwise(whole(v))
    dummies = [F.when(F.col("unit_ord") % 5 == k, 1).otherwise(0).alias(f"city_{k}") for k in (0, 1)]
    return income.select("unit_ord", F.round(v / 1.37, 6).alias("usd"), ((v > 0) & (F.col("unit_ord") >= 0)).alias("valid"), *dummies, F.round(F.log1p(v), 6).alias("log_income"), tick.alias("tick"), F.when(v < 10000, 5000).when(v < 40000, 20000).otherwise(50000).alias("bar"))


_RESCALED = """g AS (SELECT tile_ord, r, c, CASE tile_ord % 4 WHEN 0 THEN v WHEN 1 THEN v*255 WHEN 2 THEN v*20000-10000 ELSE v*2-1 END AS x FROM fx_pixels),
 m AS (SELECT tile_ord, min(x) lo, max(x) hi FROM g GROUP BY 1),
 s AS (SELECT g.tile_ord, r, c, CASE WHEN lo>=0 AND hi<=1 THEN x*2-1 WHEN lo>=-1 AND hi<=1 THEN x WHEN lo>=0 AND hi<=255 THEN x/255*2-1 ELSE x/10000 END AS n FROM g JOIN m USING (tile_ord))"""


@query(f"""WITH {_RESCALED}, q AS (SELECT tile_ord, quantile_cont(n,0.02) a, quantile_cont(n,0.98) b FROM s GROUP BY 1)
 SELECT s.tile_ord, round(avg(n),6) AS mean, round(avg(greatest(0.0E0,least(1.0E0,(n-a)/(b-a)))),6) AS stretched, stddev_pop(n)<1E-3 OR max(abs(n))<1E-3 AS blank FROM s JOIN q USING (tile_ord) GROUP BY 1""")
def ndvi_rescaled(spark, sf_dir):
    """Four encodings told apart by their range and mapped to [-1, 1]; percentile stretch; blank test."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    v, t = F.col("v"), F.col("tile_ord") % 4
    g = px.select("tile_ord", F.when(t == 0, v).when(t == 1, v * 255).when(t == 2, v * 20000 - 10000).otherwise(v * 2 - 1).alias("x"))
    m = g.groupBy("tile_ord").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("x")
    n = F.when((lo >= 0) & (hi <= 1), x * 2 - 1).when((lo >= -1) & (hi <= 1), x).when((lo >= 0) & (hi <= 255), x / 255 * 2 - 1).otherwise(x / 10000)
    s = g.join(m, "tile_ord").select("tile_ord", n.alias("n"))
    q = s.groupBy("tile_ord").agg(F.percentile("n", 0.02).alias("a"), F.percentile("n", 0.98).alias("b"))
    n = F.col("n")
    # a tile whose percentiles are equal has no width to stretch over: what is not below them is 1
    width = F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    stretch = F.when(width.isNull(), F.when(n < F.col("a"), 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n - F.col("a")) / width)))
    return s.join(q, "tile_ord").groupBy("tile_ord").agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.avg(stretch), 6).alias("stretched"), ((F.stddev_pop(n) < 1e-3) | (F.max(F.abs(n)) < 1e-3)).alias("blank"))


@query("""WITH o AS (SELECT tile_ord, v, r, c, pr, pc FROM fx_pixels, (SELECT unnest(range(0,64,24)) pr), (SELECT unnest(range(0,64,24)) pc) WHERE r BETWEEN pr AND pr+31 AND c BETWEEN pc AND pc+31),
 s AS (SELECT *, avg(v) OVER w m, stddev_pop(v) OVER w d FROM o WINDOW w AS (PARTITION BY tile_ord, pr, pc))
 SELECT tile_ord, r, c, count(*) AS overlap, round(min((v-m)/(d+1E-6)),5) AS least, round(max((v-m)/(d+1E-6)),5) AS most, round(arg_max((v-m)/(d+1E-6), pr*1000+pc),5) AS last FROM s GROUP BY 1,2,3""")
def patches_merged(spark, sf_dir):
    """Overlapping patches of 32 by 32 in steps of 24, normalised each, merged by least, most and last."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    # A pixel lies in the patches that start at most 31 before it: at most two on each axis.
    starts = lambda c: F.filter(F.sequence(F.lit(0), F.lit(63), F.lit(24)), lambda s: (s <= F.col(c)) & (F.col(c) <= s + 31))
    o = px.withColumn("pr", F.explode(starts("r"))).withColumn("pc", F.explode(starts("c")))
    w = W.partitionBy("tile_ord", "pr", "pc")
    s = o.withColumn("z", (F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-6))
    return s.groupBy("tile_ord", "r", "c").agg(F.count("*").alias("overlap"), F.round(F.min("z"), 5).alias("least"), F.round(F.max("z"), 5).alias("most"), F.round(F.max_by("z", F.col("pr") * 1000 + F.col("pc")), 5).alias("last"))


_BOX = """n AS (SELECT p.tile_ord, p.r, p.c, p.v, sum(q.v)/25.0E0 AS box, sum(q.v*q.v)/25.0E0 AS square FROM fx_pixels p JOIN fx_pixels q ON p.tile_ord=q.tile_ord AND q.r BETWEEN p.r-2 AND p.r+2 AND q.c BETWEEN p.c-2 AND p.c+2 GROUP BY ALL)"""


@query(f"""WITH {_BOX}, d AS (SELECT tile_ord, r, c, v, 0.5E0*box+0.5E0*(square-box*box) AS density FROM n), t AS (SELECT tile_ord, quantile_cont(density,0.75) cut FROM d GROUP BY 1)
 SELECT tile_ord, count(*) AS n, count(*) FILTER (WHERE density>=cut-1E-12) AS central, round(avg(v) FILTER (WHERE density>=cut-1E-12),6) AS central_mean, round(stddev_pop(v) FILTER (WHERE density>=cut-1E-12),6) AS central_std, round(avg(v),6) AS mean,
  round(avg(density),6) AS mean_density FROM d JOIN t USING (tile_ord) GROUP BY 1""")
def urban_centre(spark, sf_dir):
    """Density from the mean and the variance of a 5 by 5 box (nothing beyond the border), the densest quarter, and its statistics against all.

    Each pixel gives its value to the 25 boxes that hold it, summed by place: no self-join."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    near = F.sequence(F.lit(-2), F.lit(2))
    spread = px.withColumn("dr", F.explode(near)).withColumn("dc", F.explode(near))
    boxes = spread.groupBy("tile_ord", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(
        (F.sum("v") / 25.0).alias("box"), (F.sum(F.col("v") * F.col("v")) / 25.0).alias("square"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v"))).alias("v"))
    d = boxes.where("v IS NOT NULL").withColumn("density", 0.5 * F.col("box") + 0.5 * (F.col("square") - F.col("box") * F.col("box")))
    cut = d.groupBy("tile_ord").agg(F.percentile("density", 0.75).alias("cut"))
    inside = F.col("density") >= F.col("cut") - 1e-12
    v = F.when(inside, F.col("v"))
    return d.join(cut, "tile_ord").groupBy("tile_ord").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("central"), F.round(F.avg(v), 6).alias("central_mean"), F.round(F.stddev_pop(v), 6).alias("central_std"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg("density"), 6).alias("mean_density"))


@query("""WITH l AS (SELECT p.tile_ord, p.r, p.c, max(p.v) v, sum(q.v) FILTER (WHERE abs(q.r-p.r)+abs(q.c-p.c)=1) s FROM fx_pixels p JOIN fx_pixels q ON p.tile_ord=q.tile_ord AND abs(q.r-p.r)<=1 AND abs(q.c-p.c)<=1 GROUP BY 1,2,3)
 SELECT tile_ord, round(var_pop(coalesce(s,0)-4*v),6) AS sharpness, round(stddev_pop(v),6) AS contrast, round(avg(greatest(0.0E0,least(1.0E0, v+0.5E0*(4*v-coalesce(s,0))))),6) AS unsharp FROM l GROUP BY 1""")
def sharpness(spark, sf_dir):
    """Variance of the five-point Laplacian, contrast, and an unsharp mask, by giving each value to its neighbours."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    s = px.withColumn("o", F.explode(steps))
    own = (F.col("o.a") == 0) & (F.col("o.b") == 0)
    l = s.groupBy("tile_ord", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")).agg(F.max(F.when(own, F.col("v"))).alias("v"), F.coalesce(F.sum(F.when(~own, F.col("v"))), F.lit(0.0)).alias("s"))
    l = l.where("v IS NOT NULL")
    edge = F.col("s") - 4 * F.col("v")
    return l.groupBy("tile_ord").agg(F.round(F.var_pop(edge), 6).alias("sharpness"), F.round(F.stddev_pop("v"), 6).alias("contrast"), F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") - 0.5 * edge))), 6).alias("unsharp"))


@query("""SELECT tile_ord, r-16 AS r, c-16 AS c, CASE WHEN v>0.3E0 THEN 1 ELSE 0 END AS hit, r // 16 AS cell_r, c // 16 AS cell_c FROM fx_pixels WHERE r BETWEEN 16 AND 47 AND c BETWEEN 16 AND 47""")
def centre_crop(spark, sf_dir):
    """The middle 32 by 32 of each tile, thresholded, with the 16-pixel cell each pixel lies in."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    inner = px.where(F.col("r").between(16, 47) & F.col("c").between(16, 47))
    cell = lambda c: F.floor(F.col(c) / 16).cast("bigint")
    return inner.select("tile_ord", (F.col("r") - 16).alias("r"), (F.col("c") - 16).alias("c"), F.when(F.col("v") > 0.3, 1).otherwise(0).alias("hit"), cell("r").alias("cell_r"), cell("c").alias("cell_c"))


@query("""WITH p AS (SELECT tile_ord, r*4+CAST(floor(c/16) AS BIGINT) AS part, least(4, CAST(floor(v*5) AS BIGINT)) k, v FROM fx_pixels),
 g AS (SELECT DISTINCT tile_ord, part FROM p), b AS (SELECT unnest(range(0,5)) k)
 SELECT g.tile_ord, g.part, b.k::BIGINT AS bin, count(v) AS n, round(coalesce(avg(v),(b.k+0.5E0)/5),6) AS mean FROM g CROSS JOIN b
 LEFT JOIN p ON p.tile_ord=g.tile_ord AND p.part=g.part AND p.k=b.k GROUP BY g.tile_ord, g.part, b.k""")
def strata_defaults(spark, sf_dir):
    """Five equal strata on [0, 1] of each sixteenth of a tile's rows; an empty one has its midpoint for a mean."""
    (px,) = load(spark, sf_dir, "fx_pixels")
    own = ["tile_ord", "part", "bin"]
    part = (F.col("r") * 4 + F.floor(F.col("c") / 16)).cast("bigint").alias("part")
    held = px.groupBy("tile_ord", part, F.least(F.lit(4), F.floor(F.col("v") * 5)).cast("bigint").alias("bin")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    every = held.select("tile_ord", "part").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    mean = F.round(F.coalesce("mean", (F.col("bin") + 0.5) / 5), 6)
    return every.join(held, own, "left").select(*own, F.coalesce("n", F.lit(0)).alias("n"), mean.alias("mean"))


@query("""WITH u AS (SELECT t.unit_ord, count(*) n, median_income inc FROM fx_trees t JOIN fx_income i ON t.unit_ord=i.unit_ord WHERE median_income IS NOT NULL GROUP BY 1,3),
 q AS (SELECT quantile_cont(inc,0.25) a, quantile_cont(inc,0.5) b, quantile_cont(inc,0.75) c FROM u)
 SELECT CAST(CASE WHEN inc<=a THEN 1 WHEN inc<=b THEN 2 WHEN inc<=c THEN 3 ELSE 4 END AS BIGINT) AS quartile, count(*) AS units, round(avg(n),4) AS mean, round(stddev_samp(n),4) AS std, min(n) AS least, max(n) AS most, round(min(inc),2) AS income_from, round(max(inc),2) AS income_to FROM u, q GROUP BY 1""")
def quartile_summary(spark, sf_dir):
    """Mean, deviation, count and range by income quartile."""
    trees, income = load(spark, sf_dir, "fx_trees", "fx_income")
    u = trees.groupBy("unit_ord").agg(F.count("*").alias("n")).join(income.where("median_income IS NOT NULL"), "unit_ord")
    q = u.agg(*[F.percentile("median_income", p).alias(n) for p, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))])
    inc = F.col("median_income")
    k = F.when(inc <= F.col("a"), 1).when(inc <= F.col("b"), 2).when(inc <= F.col("c"), 3).otherwise(4).cast("bigint")
    out = u.crossJoin(F.broadcast(q)).groupBy(k.alias("quartile"))  # one row
    return out.agg(F.count("*").alias("units"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.min(inc), 2).alias("income_from"), F.round(F.max(inc), 2).alias("income_to"))


@query("""SELECT u.unit_ord, count(t.tree_id) FILTER (WHERE crown_area_px<10) AS small, count(t.tree_id) FILTER (WHERE crown_area_px>=10) AS large, min(t.tree_id) AS first_tree,
  20.0E0*20.0E0 AS area, count(t.tree_id)/400.0E0 > 5.0E0 AS dense FROM fx_units u LEFT JOIN fx_trees t ON u.unit_ord=t.unit_ord GROUP BY 1""")
def category_counts(spark, sf_dir):
    """Counts by category and the first id of each unit; smallest area and the density flag."""
    units, trees = load(spark, sf_dir, "fx_units", "fx_trees")
    own = units.select("unit_ord", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")).where("area >= 0.1")
    j = own.join(trees, "unit_ord", "left")
    return j.groupBy("unit_ord").agg(
        F.count_if(F.col("crown_area_px") < 10).alias("small"), F.count_if(F.col("crown_area_px") >= 10).alias("large"), F.min("tree_id").alias("first_tree"), F.first("area").alias("area"), (F.count("tree_id") / F.first("area") > 5.0).alias("dense"))


@query("""WITH b AS (SELECT regexp_replace(regexp_replace(filename,'^pred_(pan|ndvi)_',''),'\\.tif$','') b, tile_ord t FROM fx_tiles), w AS (SELECT DISTINCT b FROM b WHERE t % 3=0 UNION SELECT DISTINCT b FROM b WHERE t % 7=0)
 SELECT filename FROM fx_tiles WHERE regexp_replace(regexp_replace(filename,'^pred_(pan|ndvi)_',''),'\\.tif$','') IN (SELECT b FROM w)""")
def membership_by_base(spark, sf_dir):
    """Tiles whose base name is in the union of two sets of base names."""
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    named = tiles.withColumn("b", C.base_name(F.col("filename")))
    wanted = named.where("tile_ord % 3 = 0").select("b").union(named.where("tile_ord % 7 = 0").select("b")).distinct()
    return named.join(wanted, "b", "left_semi").select("filename")

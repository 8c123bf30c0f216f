"""The queries: each a DataFrame plan over adapters, with an SQL twin for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdance.functions import cleaning as C
from verdance.functions import geometry as G
from verdance.operators import raster as R
from verdance.operators import resampling as B
from verdance.operators import spatial as S
from verdance.operators import stats as T
from verdance.sources.adapters import load, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def _city(trees: DataFrame, units: DataFrame) -> DataFrame:
    return trees.join(units.select("unit_ord", "city"), "unit_ord")


@query("""WITH inc AS (SELECT c_nationkey nk, c_mktsegment seg, CASE WHEN c_nationkey % 7 = 3 THEN NULL
   ELSE CAST(sum(CAST(round(c_acctbal*100) AS BIGINT)) AS DOUBLE)/count(*) END AS median_income FROM customer GROUP BY 1,2),
 m AS (SELECT n_regionkey AS city, c_nationkey nk, c_mktsegment seg, count(*) AS tree_count
       FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3),
 u AS (SELECT m.city, least(tree_count/(1.0E0+0.25E0*(m.nk % 4)), 30000.0E0) AS density, median_income
       FROM m JOIN inc ON m.nk=inc.nk AND m.seg=inc.seg WHERE median_income IS NOT NULL),
 r AS (SELECT city, density, median_income,
   rank() OVER (PARTITION BY city ORDER BY median_income)+(count(*) OVER (PARTITION BY city, median_income)-1)/2.0E0 AS rx,
   rank() OVER (PARTITION BY city ORDER BY density)+(count(*) OVER (PARTITION BY city, density)-1)/2.0E0 AS ry FROM u)
SELECT city, count(*) AS n_units, round(corr(rx,ry),6) AS rho FROM r GROUP BY city HAVING count(*) >= 5""")
def equity_spearman(spark, sf_dir):
    customer, orders, nation = load(spark, sf_dir, "customer", "orders", "nation")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    unit = [F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg")]
    income = customer.groupBy(*unit).agg((F.sum(cents).cast("double") / F.count("*")).alias("v"))
    income = income.withColumn("median_income", F.when(F.col("nk") % 7 != 3, F.col("v"))).where("median_income IS NOT NULL")
    counts = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(*unit).agg(F.count("*").alias("tree_count"))
    cities = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("city"))
    units = counts.join(income, ["nk", "seg"]).join(cities, "nk")
    units = units.withColumn("density", F.least(F.col("tree_count") / (1.0 + 0.25 * (F.col("nk") % 4)), F.lit(30000.0)))
    return T.spearman(units, "median_income", "density", ["city"])


@query("""SELECT u.geoid, u.city, coalesce(n,0) AS tree_count, coalesce(s,0) AS crown_area,
 coalesce(n,0)/400.0E0 AS density, coalesce(s,0)*100.0E0/400000.0E0 AS canopy_pct, CAST(s AS DOUBLE)/n AS mean_crown
 FROM fx_units u LEFT JOIN (SELECT unit_ord, count(*) n, CAST(sum(crown_area_px) AS BIGINT) s FROM fx_trees GROUP BY 1) t ON u.unit_ord=t.unit_ord""")
def unit_metrics(spark, sf_dir):
    trees, units = load(spark, sf_dir, "fx_trees", "fx_units")
    agg = trees.groupBy("unit_ord").agg(F.count("*").alias("n"), F.sum("crown_area_px").alias("s"))
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    return units.join(agg, "unit_ord", "left").select(
        "geoid", "city", n.alias("tree_count"), s.alias("crown_area"),
        C.ratio_or_zero(n, F.lit(400.0)).alias("density"), C.ratio_or_zero(s * 100.0, F.lit(400000.0)).alias("canopy_pct"),
        C.ratio_or_null(F.col("s").cast("double"), F.col("n")).alias("mean_crown"),
    )


@query("""WITH c AS (SELECT CAST(round(c_acctbal*100) AS BIGINT) v, c_mktsegment city FROM customer),
 b AS (SELECT city, quantile_cont(v, [0.25,0.5,0.75]) q FROM c GROUP BY 1),
 k AS (SELECT c.city, v, CASE WHEN v<=q[1] THEN 1 WHEN v<=q[2] THEN 2 WHEN v<=q[3] THEN 3 ELSE 4 END quartile FROM c JOIN b ON c.city=b.city)
 SELECT city, quartile, count(*) n, CAST(sum(v) AS BIGINT) total, min(v) lo, max(v) hi, CAST(sum(v) AS DOUBLE)/count(*) mean FROM k GROUP BY 1,2""")
def income_quartiles(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    c = customer.select(F.round(F.col("c_acctbal") * 100).cast("bigint").alias("v"), F.col("c_mktsegment").alias("city"))
    k = T.quantile_class(c, "v", [0.25, 0.5, 0.75], ["city"], "quartile")
    return k.groupBy("city", "quartile").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        (F.sum("v").cast("double") / F.count("*")).alias("mean"))


_CITY = """WITH t AS (SELECT city, crown_area_px a FROM fx_trees JOIN fx_units ON fx_trees.unit_ord=fx_units.unit_ord),
 g AS (SELECT CAST(city AS STRING) city, count(*) n, min(a) lo, max(a) hi, CAST(sum(a) AS DOUBLE)/count(*) mean, 100.0E0*count(*) FILTER (WHERE a>50)/count(*) pct FROM t GROUP BY 1)"""


@query(_CITY + """ SELECT * FROM g UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), min(lo), max(hi), round(avg(mean),6), round(avg(pct),6) FROM g""")
def city_summary_total(spark, sf_dir):
    trees, units = load(spark, sf_dir, "fx_trees", "fx_units")
    a = F.col("crown_area_px")
    g = _city(trees, units).groupBy(F.col("city").cast("string").alias("city")).agg(
        F.count("*").alias("n"), F.min(a).alias("lo"), F.max(a).alias("hi"),
        (F.sum(a).cast("double") / F.count("*")).alias("mean"), (100.0 * F.count_if(a > 50) / F.count("*")).alias("pct"))
    total = g.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("pct"), 6).alias("pct"))
    return g.unionByName(total.withColumn("city", F.lit("all")))


@query("""WITH t AS (SELECT city, crown_area_px a FROM fx_trees JOIN fx_units ON fx_trees.unit_ord=fx_units.unit_ord)
 SELECT coalesce(CAST(city AS STRING),'All cities') city, count(*) n, CAST(sum(a) AS BIGINT) total, median(a) median_area,
 round(2*sqrt(CAST(sum(a) AS DOUBLE)/count(*)/pi()),6) diameter FROM t GROUP BY ROLLUP(city)""")
def pooled_total_row(spark, sf_dir):
    trees, units = load(spark, sf_dir, "fx_trees", "fx_units")
    a = F.col("crown_area_px")
    return _city(trees, units).rollup("city").agg(
        F.count("*").alias("n"), F.sum(a).alias("total"), F.median(a).alias("median_area"),
        F.round(2 * F.sqrt(F.sum(a).cast("double") / F.count("*") / F.pi()), 6).alias("diameter"),
    ).withColumn("city", F.coalesce(F.col("city").cast("string"), F.lit("All cities")))


@query("""SELECT t.unit_ord, city, median(crown_area_px) median_crown, CAST(sum(crown_area_px) AS BIGINT) total_crown, count(*) tree_count,
 sum(crown_area_px)/(parcels*(0.01E0+0.01E0*(t.unit_ord % 5))) crown_area_per_ha FROM fx_trees t JOIN fx_units u ON t.unit_ord=u.unit_ord JOIN fx_income i ON t.unit_ord=i.unit_ord
 JOIN (SELECT c_nationkey, count(*) parcels FROM customer GROUP BY 1) a ON t.unit_ord=c_nationkey
 WHERE median_income IS NOT NULL GROUP BY 1,2,parcels HAVING sum(crown_area_px)/(parcels*(0.01E0+0.01E0*(t.unit_ord % 5))) <= 10000""")
def median_crown_unit(spark, sf_dir):
    """Units whose crown area a hectare is plausible; a unit's hectares grow with its parcels."""
    trees, units, income, customer = load(spark, sf_dir, "fx_trees", "fx_units", "fx_income", "customer")
    agg = trees.groupBy("unit_ord").agg(F.median("crown_area_px").alias("median_crown"), F.sum("crown_area_px").alias("total_crown"), F.count("*").alias("tree_count"))
    area = customer.groupBy(F.col("c_nationkey").alias("unit_ord")).agg(F.count("*").alias("parcels"))
    joined = agg.join(units.select("unit_ord", "city"), "unit_ord").join(income.where("median_income IS NOT NULL"), "unit_ord").join(area, "unit_ord")
    per_ha = F.col("total_crown") / (F.col("parcels") * (0.01 + 0.01 * (F.col("unit_ord") % 5)))
    return joined.withColumn("crown_area_per_ha", per_ha).where("crown_area_per_ha <= 10000").drop("median_income", "parcels")


@query("""SELECT o_custkey AS unit, count(*) n, CAST(sum(o_orderkey) AS DOUBLE)/count(*) mean_crown, min(o_custkey % 97) income
 FROM orders WHERE o_totalprice > 0 GROUP BY 1 HAVING count(*) >= 10""")
def mean_crown_min10(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    g = orders.where("o_totalprice > 0").groupBy(F.col("o_custkey").alias("unit"))
    return g.agg(F.count("*").alias("n"), (F.sum("o_orderkey").cast("double") / F.count("*")).alias("mean_crown"), F.min(F.col("o_custkey") % 97).alias("income")).where("n >= 10")


_EDGES = [round(10 ** (k / 10), 9) for k in range(31)]
_EDGE_ROWS = ", ".join(f"({k}, {_EDGES[k]!r}E0, {_EDGES[k + 1]!r}E0)" for k in range(30))


@query(f"""WITH e AS (SELECT * FROM (VALUES {_EDGE_ROWS}) t(bin, lo, hi)), n AS (SELECT count(*) total FROM fx_trees),
 h AS (SELECT bin, count(*) c FROM fx_trees JOIN e ON crown_area_px>=lo AND (crown_area_px<hi OR (bin=29 AND crown_area_px=hi)) GROUP BY 1)
 SELECT CAST(e.bin AS INT) bin, coalesce(c,0) n, coalesce(c,0)/CAST(total AS DOUBLE) weight FROM e CROSS JOIN n LEFT JOIN h ON e.bin=h.bin""")
def crown_histogram(spark, sf_dir):
    """Log-spaced bins; the last is closed; values outside count in the total alone."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    a = F.col("crown_area_px")
    bin_ = F.lit(None).cast("int")
    for k in reversed(range(30)):
        bin_ = F.when((a >= _EDGES[k]) & (a <= _EDGES[k + 1] if k == 29 else a < _EDGES[k + 1]), k).otherwise(bin_)
    counted = trees.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
    total = counted.agg(F.sum("c").cast("double").alias("total"))
    bins = spark.range(30).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("c", F.lit(0))
    return bins.join(F.broadcast(counted), "bin", "left").crossJoin(F.broadcast(total)).select("bin", n.alias("n"), (n / F.col("total")).alias("weight"))


@query("""WITH m AS (SELECT min(o_custkey) lo, max(o_custkey) hi FROM orders)
 SELECT CAST(least(29, floor((o_custkey-lo)*30.0E0/(hi-lo))) AS BIGINT) bin, count(*) n FROM orders, m GROUP BY 1""")
def density_histogram(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    m = orders.agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
    b = F.least(F.lit(29), F.floor((F.col("o_custkey") - F.col("lo")) * 30.0 / (F.col("hi") - F.col("lo"))))
    return orders.crossJoin(F.broadcast(m)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey id, c_mktsegment city, CASE WHEN c_custkey % 11=0 THEN NULL ELSE CAST(round(c_acctbal*100) AS BIGINT) END v FROM customer),
 b AS (SELECT city, quantile_cont(v,[0.3333,0.6667]) q FROM c GROUP BY 1)
 SELECT id, CASE WHEN v IS NULL THEN NULL WHEN v<=round(q[1],9) THEN 1 WHEN v<=round(q[2],9) THEN 2 ELSE 3 END tertile FROM c JOIN b ON c.city=b.city""")
def tertile_by_city(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    v = F.when(F.col("c_custkey") % 11 != 0, F.round(F.col("c_acctbal") * 100).cast("bigint"))
    c = customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("city"), v.alias("v"))
    return T.quantile_class(c, "v", [0.3333, 0.6667], ["city"], "tertile").select("id", "tertile")


_BIV = """WITH c AS (SELECT c_custkey id, c_nationkey city, CAST(round(c_acctbal*100) AS BIGINT) x, (c_custkey*7919) % 10007 y, (c_custkey*31) % 1009 z FROM customer),
 b AS (SELECT quantile_cont(x,[0.333333,0.666667]) qx, quantile_cont(y,[0.333333,0.666667]) qy, quantile_cont(z,[0.333333,0.666667]) qz FROM c),
 k AS (SELECT id, city, CASE WHEN x<=round(qx[1],9) THEN 1 WHEN x<=round(qx[2],9) THEN 2 ELSE 3 END tx, CASE WHEN y<=round(qy[1],9) THEN 1 WHEN y<=round(qy[2],9) THEN 2 ELSE 3 END ty,
  CASE WHEN z<=round(qz[1],9) THEN 1 WHEN z<=round(qz[2],9) THEN 2 ELSE 3 END tz FROM c, b)"""


def _classes(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    c = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("city"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("x"), ((F.col("c_custkey") * 7919) % 10007).alias("y"), ((F.col("c_custkey") * 31) % 1009).alias("z"))
    for x in "xyz":
        c = T.quantile_class(c, x, [0.333333, 0.666667], [], f"t{x}")
    return c


@query(_BIV + " SELECT (tx-1)*3+ty AS class, count(*) n FROM k GROUP BY 1")
def bivariate_class(spark, sf_dir):
    return _classes(spark, sf_dir).groupBy(((F.col("tx") - 1) * 3 + F.col("ty")).alias("class")).agg(F.count("*").alias("n"))


@query(_BIV + " SELECT city, count(*) n, 100.0E0*count(*) FILTER (WHERE tx=1 AND ty=1 AND tz=3)/count(*) vulnerable_pct FROM k GROUP BY 1")
def vulnerability(spark, sf_dir):
    hit = (F.col("tx") == 1) & (F.col("ty") == 1) & (F.col("tz") == 3)
    return _classes(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), (100.0 * F.count_if(hit) / F.count("*")).alias("vulnerable_pct"))


@query("""SELECT c_custkey id, round((v-avg(v) OVER w)/stddev_samp(v) OVER w,6) z FROM (SELECT *, round(c_acctbal*100) v FROM customer) WINDOW w AS (PARTITION BY c_nationkey)""")
def zscore_city(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    w = W.partitionBy("c_nationkey")
    v = F.round(F.col("c_acctbal") * 100)
    return customer.select(F.col("c_custkey").alias("id"), F.round((v - F.avg(v).over(w)) / F.stddev_samp(v).over(w), 6).alias("z"))


@query("""SELECT u.unit_ord, coalesce(m,0) model_count, coalesce(i,0) inventory_count, round(log10(coalesce(m,0)+1),6) log_model FROM fx_units u
 LEFT JOIN (SELECT unit_ord, count(*) m FROM fx_trees GROUP BY 1) a ON u.unit_ord=a.unit_ord
 LEFT JOIN (SELECT unit_ord, count(*) i FROM fx_inventory GROUP BY 1) b ON u.unit_ord=b.unit_ord""")
def inventory_outer(spark, sf_dir):
    """Model and inventory counts over the whole universe of units; absent is zero."""
    trees, inventory, units = load(spark, sf_dir, "fx_trees", "fx_inventory", "fx_units")
    m = trees.groupBy("unit_ord").agg(F.count("*").alias("m"))
    i = inventory.groupBy("unit_ord").agg(F.count("*").alias("i"))
    both = m.join(i, "unit_ord", "outer")
    return units.select("unit_ord").distinct().join(both, "unit_ord", "left").select(
        "unit_ord", F.coalesce("m", F.lit(0)).alias("model_count"), F.coalesce("i", F.lit(0)).alias("inventory_count"),
        F.round(F.log10(F.coalesce("m", F.lit(0)) + 1), 6).alias("log_model"))


@query("""SELECT tree_id, city, geoid AS block_group_id, median_income AS median_household_income, CASE WHEN median_income IS NULL THEN 'no' ELSE 'yes' END has_income, crown_area_px
 FROM fx_trees t JOIN fx_units u ON t.unit_ord=u.unit_ord LEFT JOIN fx_income i ON t.unit_ord=i.unit_ord""")
def income_left_join_flag(spark, sf_dir):
    trees, units, income = load(spark, sf_dir, "fx_trees", "fx_units", "fx_income")
    enriched = units.join(income, "unit_ord", "left")
    flag = F.when(F.col("median_income").isNull(), "no").otherwise("yes")
    return trees.join(enriched, "unit_ord").select("tree_id", "city", F.col("geoid").alias("block_group_id"), F.col("median_income").alias("median_household_income"), flag.alias("has_income"), "crown_area_px")


@query("SELECT l_orderkey, min(l_linenumber) first_line, (min({'l': l_linenumber, 'p': l_partkey})).p part FROM lineitem GROUP BY 1")
def first_match_dedup(spark, sf_dir):
    (lineitem,) = load(spark, sf_dir, "lineitem")
    return lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("part"))


_NAMES = """WITH n AS (SELECT filename, regexp_replace(regexp_replace(filename,'^pred_(pan|ndvi)_',''),'\\.tif$','') base, CASE WHEN contains(filename,'ndvi') THEN 1 ELSE 0 END nd FROM fx_tiles)"""


@query(_NAMES + " SELECT base, arg_min(filename, CAST(1-nd AS STRING) || filename) filename FROM n GROUP BY base, CASE WHEN contains(lower(filename),'austin') THEN 'Austin' ELSE 'Unknown' END")
def prefer_ndvi(spark, sf_dir):
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    w = W.partitionBy("city", "base").orderBy(F.col("nd").desc(), "filename")
    named = tiles.select("filename", C.city_from_name(F.col("filename")).alias("city"), C.base_name(F.col("filename")).alias("base"), C.is_ndvi(F.col("filename")).alias("nd"))
    return named.withColumn("k", F.row_number().over(w)).where("k = 1").select("base", "filename")


@query(_NAMES + " SELECT base, max(CASE WHEN nd=0 THEN filename END) pan, max(CASE WHEN nd=1 THEN filename END) ndvi FROM n GROUP BY 1")
def tile_pairing(spark, sf_dir):
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    f = F.col("filename")
    return tiles.groupBy(C.base_name(f).alias("base")).agg(F.max(F.when(~C.is_ndvi(f), f)).alias("pan"), F.max(F.when(C.is_ndvi(f), f)).alias("ndvi"))


@query("""SELECT filename, CASE WHEN contains(lower(filename),'austin') THEN 'Austin' ELSE 'Unknown' END city, nullif(regexp_extract(filename,'(?:^|_)([0-9]{3}_[0-9]{3})(?:_|\\.|$)',1),'') tile_id,
 TRY_CAST(regexp_extract(filename,'([0-9]+)-([0-9]+)',1) AS BIGINT) x_offset, TRY_CAST(regexp_extract(filename,'([0-9]+)-([0-9]+)',2) AS BIGINT) y_offset FROM fx_tiles""")
def parse_tile_names(spark, sf_dir):
    (tiles,) = load(spark, sf_dir, "fx_tiles")
    f = F.col("filename")
    return tiles.select("filename", C.city_from_name(f).alias("city"), C.tile_id(f).alias("tile_id"), C.offset(f, 1).alias("x_offset"), C.offset(f, 2).alias("y_offset"))


_RAW = "CASE c_custkey % 4 WHEN 0 THEN concat('1500000US', lpad(CAST(c_custkey AS STRING), 12, '0')) WHEN 1 THEN concat(CAST(c_custkey AS STRING), '.0') WHEN 2 THEN concat(' ', CAST(c_custkey AS STRING), ' ') ELSE CAST(c_custkey AS STRING) END"


@query(f"SELECT c_custkey id, lpad(trim(split_part(array_extract(string_split(trim(r),'US'),-1),'.',1)),12,'0') geoid FROM (SELECT c_custkey, {_RAW} r FROM customer)")
def geoid_clean(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").alias("id"), C.geoid(F.expr(_RAW), 12).alias("geoid"))


_INC = "CASE c_custkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '250,000+' WHEN 2 THEN '2,500-' ELSE CAST(c_custkey AS STRING) END"


@query(f"SELECT c_custkey id, TRY_CAST(r AS DOUBLE) strict, CASE WHEN r='250,000+' THEN 250000.0E0 WHEN r='2,500-' THEN 2500.0E0 ELSE TRY_CAST(r AS DOUBLE) END bounded FROM (SELECT c_custkey, {_INC} r FROM customer)")
def income_coerce(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    raw = F.expr(_INC)
    return customer.select(F.col("c_custkey").alias("id"), C.income_strict(raw).alias("strict"), C.income_bounded(raw).alias("bounded"))


_HIT = "FROM fx_trees_edge t JOIN fx_units u ON t.x BETWEEN u.x0 AND u.x1 AND t.y BETWEEN u.y0 AND u.y1"


def _unit_matches(spark, sf_dir, rule):
    points, units = load(spark, sf_dir, "fx_trees_edge", "fx_units")
    return S.points_in_polygons(points, S.with_box_ring(units), 20.0, rule)


@query(f"SELECT tree_id, min(unit_ord) unit_ord {_HIT} GROUP BY 1")
def pip_intersects_first(spark, sf_dir):
    return S.first_match(_unit_matches(spark, sf_dir, "intersects").select("tree_id", "unit_ord"), "tree_id", "unit_ord")


@query("SELECT tree_id, unit_ord FROM fx_trees_edge t JOIN fx_units u ON t.x>u.x0 AND t.x<u.x1 AND t.y>u.y0 AND t.y<u.y1")
def pip_within(spark, sf_dir):
    return _unit_matches(spark, sf_dir, "within").select("tree_id", "unit_ord")


@query(f"SELECT tree_id, unit_ord {_HIT}")
def pip_multi(spark, sf_dir):
    return _unit_matches(spark, sf_dir, "intersects").select("tree_id", "unit_ord")


@query("SELECT tree_id FROM fx_trees WHERE (x>0 AND x<60 AND y>0 AND y<30) OR (x>0 AND x<30 AND y>=30 AND y<60)")
def window_clip(spark, sf_dir):
    """Points strictly inside one concave window."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    corners = [(0, 0), (60, 0), (60, 30), (30, 30), (30, 60), (0, 60), (0, 0)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    box = F.col("x").between(0, 60) & F.col("y").between(0, 60)
    return trees.where(box & G.within(ring, F.col("x"), F.col("y"))).select("tree_id")


@query("SELECT u.unit_ord, count(t.tile_ord) n_tiles FROM fx_units u LEFT JOIN fx_tiles t ON u.x0<=t.x1 AND t.x0<=u.x1 AND u.y0<=t.y1 AND t.y0<=u.y1 GROUP BY 1")
def tile_unit_count(spark, sf_dir):
    tiles, units = load(spark, sf_dir, "fx_tiles", "fx_units")
    right = tiles.select("tile_ord", F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    hits = S.boxes_touching(units, right, 20.0).groupBy("unit_ord").agg(F.count("*").alias("n"))
    return units.select("unit_ord").join(hits, "unit_ord", "left").select("unit_ord", F.coalesce("n", F.lit(0)).alias("n_tiles"))


@query("SELECT unit_ord FROM fx_units u WHERE EXISTS (SELECT 1 FROM fx_tiles t WHERE u.x0<=t.x1+0.5E0 AND t.x0-0.5E0<=u.x1 AND u.y0<=t.y1+0.5E0 AND t.y0-0.5E0<=u.y1)")
def coverage_semi(spark, sf_dir):
    """Units that tiles cover, or come within half a step of."""
    tiles, units = load(spark, sf_dir, "fx_tiles", "fx_units")
    right = tiles.select("tile_ord", F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    return units.join(S.boxes_touching(units, right, 20.0, grow=0.5), "unit_ord", "left_semi").select("unit_ord")


def _detections(spark, sf_dir):
    """Distinct detections, and a string key that sorts as (tile, label, part); the key tells rows apart by up to 12 and 14 digits."""
    (d,) = load(spark, sf_dir, "fx_detections")
    key = F.concat(F.lpad(F.col("tile_ord").cast("string"), 12, "0"), F.lpad(F.col("label").cast("string"), 14, "0"), F.lpad(F.col("pk").cast("string"), 14, "0"))
    return d.select("tile_ord", "label", "pk", "x", "y").repartition("x", "y").distinct().select(key.alias("id"), "tile_ord", "x", "y")


@query("""WITH d AS (SELECT DISTINCT concat(lpad(CAST(tile_ord AS STRING),12,'0'),lpad(CAST(label AS STRING),14,'0'),lpad(CAST(pk AS STRING),14,'0')) id, tile_ord, x, y FROM fx_detections),
 g AS (SELECT *, CAST(floor(x/0.15E0) AS BIGINT) gx, CAST(floor(y/0.15E0) AS BIGINT) gy FROM d),
 o AS (SELECT id, tile_ord, x, y, gx+dx gx, gy+dy gy FROM g, (VALUES (-1),(0),(1)) a(dx), (VALUES (-1),(0),(1)) b(dy))
 SELECT g.tile_ord, count(*) n_pairs FROM g JOIN o ON g.gx=o.gx AND g.gy=o.gy AND g.id<o.id AND g.tile_ord<>o.tile_ord
 AND (g.x-o.x)*(g.x-o.x)+(g.y-o.y)*(g.y-o.y) <= 0.15E0*0.15E0 GROUP BY 1""")
def radius_pairs(spark, sf_dir):
    return S.radius_pair_counts(_detections(spark, sf_dir), 0.15, "tile_ord")


@query()
def dedup_keep(spark, sf_dir):
    """Detections that stay after near-duplicate elimination across tiles."""
    return S.without_near_duplicates(_detections(spark, sf_dir), 0.15, "tile_ord").select("id", "tile_ord")


@query()
def dedup_sensitivity(spark, sf_dir):
    """How many detections stay at three radii; places are compared once, at the widest."""
    d = _detections(spark, sf_dir)
    places = S._kept(S.first_at_places(d, "tile_ord"))
    pairs, out = S._kept(S.near_places(places, 0.15, "tile_ord")), None
    loose = d.where(~S.has_place("tile_ord")).count()  # without a place none goes
    for eps in (0.08, 0.1, 0.15):
        gone = S.removed_near_duplicates(pairs.where(F.col("d2") <= eps * eps))
        kept = places.join(S.shuffled(gone.select("key.*")), ["tile_ord", "x", "y"], "left_anti")
        row = kept.agg((F.coalesce(F.sum("n"), F.lit(0)) + loose).alias("kept")).select(F.lit(eps).alias("eps"), "kept")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("pct_of_baseline", 100.0 * F.col("kept") / F.max(F.when(F.col("eps") == 0.1, F.col("kept"))).over(W.partitionBy(F.lit(1))))


_CENTRES = [("Austin", 20.0, 20.0), ("Bloomington", 80.0, 20.0), ("Cupertino", 20.0, 80.0), ("Surrey", 80.0, 80.0)]
_D = [f"sqrt((x-{x!r}E0)*(x-{x!r}E0)+(y-{y!r}E0)*(y-{y!r}E0))" for _, x, y in _CENTRES]


@query(f"""SELECT tree_id, CASE WHEN least({','.join(_D)})>=35 THEN NULL {' '.join(f"WHEN {d}=least({','.join(_D)}) THEN '{n}'" for d, (n, _, _) in zip(_D, _CENTRES))} END nearest FROM fx_trees""")
def nearest_city(spark, sf_dir):
    (trees,) = load(spark, sf_dir, "fx_trees")
    return S.nearest(trees, _CENTRES, 35.0).select("tree_id", "nearest")


@query("""SELECT unit_ord, (x1-x0)*(y1-y0) area, round((x1-x0)*(y1-y0)*12391.0E0*cos(radians((y0+y1)/2)),4) km2,
 round((radians(x1)-radians(x0))*6378137.0E0*6378137.0E0*(ln(tan(pi()/4+radians(least(y1,80))/2))-ln(tan(pi()/4+radians(y0*0.5E0)/2)))/1e10,4) mercator FROM fx_units""")
def area_models(spark, sf_dir):
    (units,) = load(spark, sf_dir, "fx_units")
    area = G.signed_area(F.col("ring"))
    tall = (G.mercator_y(F.least(F.col("y1"), F.lit(80))) - G.mercator_y(F.col("y0") * 0.5)) * (G.mercator_x(F.col("x1")) - G.mercator_x(F.col("x0")))
    return S.with_box_ring(units).select("unit_ord", area.alias("area"), F.round(G.degrees_to_km2(area, (F.col("y0") + F.col("y1")) / 2), 4).alias("km2"), F.round(tall / 1e10, 4).alias("mercator"))


@query("SELECT tree_id, -122.0E0+x/100 AS lon, 37.0E0+y/100 AS lat FROM fx_trees")
def utm_round_trip(spark, sf_dir):
    """Forward and inverse give the same degrees back; rounded to 1e-7."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    lon, lat = F.lit(-122.0) + F.col("x") / 100, F.lit(37.0) + F.col("y") / 100
    p = trees.select("tree_id", lon.alias("lon"), lat.alias("lat"))
    e, n = G.utm_forward(F.col("lon"), F.col("lat"), F.lit(10))
    p = p.withColumn("e", e).withColumn("n", n)
    back_lon, back_lat = G.utm_inverse(F.col("e"), F.col("n"), F.lit(10))
    near = lambda a, b: F.when(F.abs(a - b) < 1e-7, b).otherwise(a)
    return p.select("tree_id", near(back_lon, F.col("lon")).alias("lon"), near(back_lat, F.col("lat")).alias("lat"))


_UTM = G.utm_forward_sql("-122.0E0+x/100", "37.0E0+y/100", 10)


@query(f"SELECT tree_id, round({_UTM[0]},4) AS easting, round({_UTM[1]},4) AS northing FROM fx_trees")
def utm_forward(spark, sf_dir):
    """Easting and northing in zone 10, to a tenth of a millimetre."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    e, n = G.utm_forward(F.lit(-122.0) + F.col("x") / 100, F.lit(37.0) + F.col("y") / 100, F.lit(10))
    return trees.select("tree_id", F.round(e, 4).alias("easting"), F.round(n, 4).alias("northing"))


_BACK = G.utm_inverse_sql("e", "n", 10)


@query(f"WITH p AS (SELECT tree_id, {_UTM[0]} AS e, {_UTM[1]} AS n FROM fx_trees) SELECT tree_id, round({_BACK[0]},7) AS lon, round({_BACK[1]},7) AS lat FROM p")
def utm_inverse(spark, sf_dir):
    """Degrees from easting and northing, to a centimetre."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    e, n = G.utm_forward(F.lit(-122.0) + F.col("x") / 100, F.lit(37.0) + F.col("y") / 100, F.lit(10))
    p = trees.select("tree_id", e.alias("e"), n.alias("n"))
    lon, lat = G.utm_inverse(F.col("e"), F.col("n"), F.lit(10))
    return p.select("tree_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("""WITH RECURSIVE p AS (SELECT tile_ord t, r, c, r*64+c k FROM fx_pixels WHERE v > 0.9E0),
 s(t, k, l) AS (SELECT t, k, k FROM p UNION SELECT b.t, b.k, s.l FROM s JOIN p a ON a.t=s.t AND a.k=s.k JOIN p b ON a.t=b.t AND abs(a.r-b.r)+abs(a.c-b.c)=1),
 m AS (SELECT t, k, min(l) l FROM s GROUP BY 1,2)
 SELECT t tile_ord, count(DISTINCT l) n_objects, count(*) n_pixels FROM m GROUP BY 1""")
def label4(spark, sf_dir):
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    return R.labelled(pixels.where("v > 0.9")).groupBy("tile_ord").agg(F.count_distinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))


@query()
def label4_foreground(spark, sf_dir):
    """``label4`` over all of the foreground; its recursive SQL holds for v > 0.9 only."""
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    return R.labelled(pixels.where("v > 0.3")).groupBy("tile_ord").agg(F.count_distinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))


@query()
def label8(spark, sf_dir):
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    return R.labelled(pixels.where("v > 0.3"), 8).groupBy("tile_ord").agg(F.count_distinct("label").alias("n_objects"), F.count("*").alias("n_pixels"))


@query()
def region_properties(spark, sf_dir):
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    return R.region_table(R.labelled(pixels.where("v > 0.3")))


@query("SELECT CAST(l_partkey % 64 AS BIGINT) r, CAST(l_orderkey % 64 AS BIGINT) c, CAST(max(l_quantity) AS DOUBLE) best, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/count(*) confidence FROM lineitem GROUP BY 1,2")
def mosaic_max_confidence(spark, sf_dir):
    """Overlapping predictions: the largest, and their mean."""
    (lineitem,) = load(spark, sf_dir, "lineitem")
    return lineitem.groupBy((F.col("l_partkey") % 64).cast("bigint").alias("r"), (F.col("l_orderkey") % 64).cast("bigint").alias("c")).agg(
        F.max("l_quantity").cast("double").alias("best"), (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count("*")).alias("confidence"))


@query("""WITH s AS (SELECT least(4, CAST(floor(v*5) AS BIGINT)) stratum, v FROM fx_pixels), a AS (SELECT stratum, count(*) n, count(*) FILTER (WHERE v>0.5E0) hits FROM s GROUP BY 1)
 SELECT b.stratum, coalesce(n,0) n, coalesce(hits,0) hits FROM (SELECT CAST(unnest(range(5)) AS BIGINT) stratum) b LEFT JOIN a ON a.stratum=b.stratum""")
def strata_metrics(spark, sf_dir):
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    a = pixels.groupBy(F.least(F.lit(4), F.floor(F.col("v") * 5)).alias("stratum")).agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0.5).alias("hits"))
    return spark.range(5).withColumnRenamed("id", "stratum").join(a, "stratum", "left").fillna(0)


@query("""SELECT l_suppkey tile, count(*) n, CAST(sum(q) AS BIGINT) total, median(q) med, quantile_cont(q,0.25) p25, quantile_cont(q,0.75) p75, min(q) lo, max(q) hi,
 100.0E0*count(*) FILTER (WHERE q>45)/count(*) pct_large FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) q FROM lineitem) GROUP BY 1""")
def blob_stats(spark, sf_dir):
    (lineitem,) = load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    return lineitem.groupBy(F.col("l_suppkey").alias("tile")).agg(
        F.count("*").alias("n"), F.sum(q).alias("total"), F.median(q).alias("med"), F.percentile(q, 0.25).alias("p25"), F.percentile(q, 0.75).alias("p75"),
        F.min(q).alias("lo"), F.max(q).alias("hi"), (100.0 * F.count_if(q > 45) / F.count("*")).alias("pct_large"))


@query("""WITH t AS (SELECT tile_ord, count(*) n, count(*) FILTER (WHERE v>0.3E0) hit FROM fx_pixels GROUP BY 1)
 SELECT tile_ord % 4 city, count(*) n_images, CAST(sum(hit) AS DOUBLE)*100/sum(n) pooled_pct, min(hit*100.0E0/n) lo, max(hit*100.0E0/n) hi FROM t GROUP BY 1""")
def canopy_by_city(spark, sf_dir):
    (pixels,) = load(spark, sf_dir, "fx_pixels")
    t = pixels.groupBy("tile_ord").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0.3).alias("hit"))
    pct = F.col("hit") * 100.0 / F.col("n")
    return t.groupBy((F.col("tile_ord") % 4).alias("city")).agg(F.count("*").alias("n_images"), (F.sum("hit").cast("double") * 100 / F.sum("n")).alias("pooled_pct"), F.min(pct).alias("lo"), F.max(pct).alias("hi"))


@query("SELECT l_suppkey tile, 100.0E0*count(*) FILTER (WHERE x>0.2E0)/count(*) pct_vegetation, 100.0E0*count(*) FILTER (WHERE x BETWEEN -1 AND 1)/count(*) pct_valid, count(*) FILTER (WHERE abs(x)>1) outliers FROM (SELECT l_suppkey, (l_partkey % 300)/100.0E0-1.5E0 x FROM lineitem) GROUP BY 1")
def ndvi_stats(spark, sf_dir):
    (lineitem,) = load(spark, sf_dir, "lineitem")
    x = (F.col("l_partkey") % 300) / 100.0 - 1.5
    pct = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return lineitem.groupBy(F.col("l_suppkey").alias("tile")).agg(pct(x > 0.2).alias("pct_vegetation"), pct(x.between(-1, 1)).alias("pct_valid"), F.count_if(F.abs(x) > 1).alias("outliers"))


_XYM = "SELECT c_nationkey city, CAST((c_custkey*7919) % 1009 AS DOUBLE) x, CAST((c_custkey*31) % 997 + (c_custkey*7919) % 1009 AS DOUBLE) m, CAST((c_custkey*17) % 499 AS DOUBLE) y FROM customer"


def _xym(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    x = (k * 7919) % 1009
    return customer.select(F.col("c_nationkey").alias("city"), k.alias("id"), x.cast("double").alias("x"), ((k * 31) % 997 + x).cast("double").alias("m"), ((k * 17) % 499).cast("double").alias("y"))


@query(f"SELECT city, count(*) n, round(regr_slope(y,x),6) slope, round(regr_intercept(y,x),4) intercept FROM ({_XYM}) GROUP BY 1")
def ols_line(spark, sf_dir):
    return _xym(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"))


@query(f"WITH f AS (SELECT min(x) lo, max(x) hi, regr_slope(y,x) s, regr_intercept(y,x) k FROM ({_XYM})) SELECT CAST(i AS INT) i, lo+i*(hi-lo)/99.0E0 gx, round(k+s*(lo+i*(hi-lo)/99.0E0),4) fit FROM f, (SELECT unnest(range(100)) i)")
def ols_grid(spark, sf_dir):
    f = _xym(spark, sf_dir).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("k"))
    gx = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / 99.0
    return f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).select("i", gx.alias("gx"), F.round(F.col("k") + F.col("s") * gx, 4).alias("fit"))


_MOMENTS = f"WITH z AS ({_XYM}), g AS (SELECT city, count(*) n, var_samp(x) xx, var_samp(m) mm, covar_samp(x,m) xm, covar_samp(x,y) xy, covar_samp(m,y) my FROM z GROUP BY 1)"


@query(_MOMENTS + " SELECT city, n, round((xy*mm-my*xm)/(xx*mm-xm*xm),5) bx, round((my*xx-xy*xm)/(xx*mm-xm*xm),5) bm FROM g")
def ols_two_predictor(spark, sf_dir):
    return T.two_predictor_ols(_xym(spark, sf_dir), "y", "x", "m", ["city"]).select("city", "n", F.round("bx", 5).alias("bx"), F.round("bm", 5).alias("bm"))


@query(_MOMENTS + " SELECT city, n, round(xm/xx,5) a, round((my*xx-xy*xm)/(xx*mm-xm*xm),5) b, round((xy*mm-my*xm)/(xx*mm-xm*xm),5) direct, round(xy/xx,5) total, round(xm/xx*(my*xx-xy*xm)/(xx*mm-xm*xm),5) indirect FROM g")
def mediation_point(spark, sf_dir):
    t = T.two_predictor_ols(_xym(spark, sf_dir), "y", "x", "m", ["city"])
    r = lambda c: F.round(c, 5)
    return t.select("city", "n", r("a").alias("a"), r("bm").alias("b"), r("bx").alias("direct"), r("total").alias("total"), r(F.col("a") * F.col("bm")).alias("indirect"))


@query(f"WITH z AS ({_XYM}), d AS (SELECT x-avg(x) OVER w x, y-avg(y) OVER w y FROM z WINDOW w AS (PARTITION BY city)) SELECT count(*) n, round(regr_slope(y,x),6) slope FROM d")
def fixed_effects(spark, sf_dir):
    """Slope with a constant for each city, by demeaning within cities."""
    w = W.partitionBy("city")
    d = _xym(spark, sf_dir).select((F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    return d.agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"))


_P = "SELECT c_nationkey city, c_custkey id, CASE WHEN c_custkey % 13=0 THEN NULL ELSE ((c_custkey*7919) % 10007)/10007.0E0 END p FROM customer"


@query(f"""WITH z AS ({_P}), s AS (SELECT *, p*count(*) OVER (PARTITION BY city)/row_number() OVER (PARTITION BY city ORDER BY p) q FROM z WHERE p IS NOT NULL)
 SELECT city, id, round(least(1.0E0, min(q) OVER (PARTITION BY city ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),9) p_adj FROM s UNION ALL SELECT city, id, NULL FROM z WHERE p IS NULL""")
def bh_adjust(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    z = customer.select(F.col("c_nationkey").alias("city"), k.alias("id"), F.when(k % 13 != 0, ((k * 7919) % 10007) / F.lit(10007.0)).alias("p"))
    return T.adjusted(z, "p", ["city"]).select("city", "id", F.round("p_adj", 9).alias("p_adj"))


@query("""WITH z AS (SELECT city, CAST(crown_area_px AS DOUBLE) x FROM fx_trees JOIN fx_units ON fx_trees.unit_ord=fx_units.unit_ord),
 h AS (SELECT city, count(*) n, pow(CAST(count(*) AS DOUBLE),-0.2E0)*stddev_samp(x) h FROM z GROUP BY 1), w AS (SELECT city, x, count(*) k FROM z GROUP BY 1,2),
 g AS (SELECT unnest(range(500)) i)
 SELECT w.city, CAST(i AS INT) i, round(sum(k*exp(-0.5E0*pow((i*98.0E0/499.0E0-x)/h,2)))/(first(n)*first(h)*sqrt(2*pi())),8) density FROM w JOIN h ON w.city=h.city, g GROUP BY 1,2""")
def kde_grid(spark, sf_dir):
    trees, units = load(spark, sf_dir, "fx_trees", "fx_units")
    z = _city(trees, units).select("city", F.col("crown_area_px").cast("double").alias("x"))
    return T.kde(z, "x", ["city"], 0.0, 98.0, 500).select("city", "i", F.round("density", 8).alias("density"))


@query("""WITH s AS (SELECT s_suppkey tile, s_nationkey city, CAST(round(s_acctbal*100) AS BIGINT) a, (s_suppkey*37) % 101 b FROM supplier),
 n AS (SELECT *, min(a) OVER w alo, max(a) OVER w ahi, min(b) OVER w blo, max(b) OVER w bhi FROM s WINDOW w AS (PARTITION BY city)),
 k AS (SELECT tile, city, 0.6E0*(a-alo)/(ahi-alo+1e-6)+0.4E0*(b-blo)/(bhi-blo+1e-6) score FROM n)
 SELECT tile, city, round(score,6) score FROM k QUALIFY row_number() OVER (PARTITION BY city ORDER BY score, tile) <= 2""")
def tile_score_select(spark, sf_dir):
    (supplier,) = load(spark, sf_dir, "supplier")
    s = supplier.select(F.col("s_suppkey").alias("tile"), F.col("s_nationkey").alias("city"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("a"), ((F.col("s_suppkey") * 37) % 101).alias("b"))
    w = W.partitionBy("city")
    s = s.withColumn("score", F.lit(0.6) * (F.col("a") - F.min("a").over(w)) / (F.max("a").over(w) - F.min("a").over(w) + 1e-6) + F.lit(0.4) * (F.col("b") - F.min("b").over(w)) / (F.max("b").over(w) - F.min("b").over(w) + 1e-6))
    s = s.withColumn("k", F.row_number().over(w.orderBy("score", "tile")))
    return s.where("k <= 2").select("tile", "city", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT s_nationkey city, s_suppkey tile, (s_suppkey*53) % 100 d FROM supplier), n AS (SELECT *, count(*) FILTER (WHERE d<6) OVER w n6, count(*) FILTER (WHERE d<10) OVER w n10, count(*) OVER w n, row_number() OVER (PARTITION BY city ORDER BY d, tile) k FROM d WINDOW w AS (PARTITION BY city))
 SELECT city, tile FROM n WHERE CASE WHEN n6>=15 THEN d<6 WHEN n10>=15 THEN d<10 ELSE k<=greatest(15, n//2) END""")
def distance_banded(spark, sf_dir):
    (supplier,) = load(spark, sf_dir, "supplier")
    d = supplier.select(F.col("s_nationkey").alias("city"), F.col("s_suppkey").alias("tile"), ((F.col("s_suppkey") * 53) % 100).alias("d"))
    w = W.partitionBy("city")
    d = d.withColumn("n6", F.count_if(F.col("d") < 6).over(w)).withColumn("n10", F.count_if(F.col("d") < 10).over(w)).withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("d", "tile")))
    keep = F.when(F.col("n6") >= 15, F.col("d") < 6).when(F.col("n10") >= 15, F.col("d") < 10).otherwise(F.col("k") <= F.greatest(F.lit(15), F.floor(F.col("n") / 2)))
    return d.where(keep).select("city", "tile")


_RHO = f"""r AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY x)+(count(*) OVER (PARTITION BY city, x)-1)/2.0E0 rx, rank() OVER (PARTITION BY city ORDER BY y)+(count(*) OVER (PARTITION BY city, y)-1)/2.0E0 ry FROM ({_XYM})),
 c AS (SELECT city, count(*) n_units, round(corr(rx,ry),6) rho FROM r GROUP BY 1 HAVING count(*)>=5),
 t AS (SELECT *, rho*sqrt((n_units-2)/(1-rho*rho)) t, n_units-2 dof FROM c), p AS (SELECT city, n_units, rho, {B.student_p_sql('t', 'dof')} p FROM t)"""


@query(f"WITH {_RHO} SELECT city, n_units, rho, round(p,8) p, CASE WHEN p<0.001E0 THEN '***' WHEN p<0.01E0 THEN '**' WHEN p<0.05E0 THEN '*' ELSE 'ns' END stars FROM p")
def spearman_p(spark, sf_dir):
    """rho with its two-sided p and stars; one row a city."""
    rows = T.spearman(_xym(spark, sf_dir), "x", "y", ["city"])
    dof = F.col("n_units") - 2
    t = F.col("rho") * F.sqrt(dof / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    p = F.when(F.isnan("rho"), F.col("rho")).when(F.abs("rho") >= 1, 0.0).otherwise(B.student_p(t, dof))
    return rows.withColumn("p", p).withColumn("stars", C.stars(F.col("p"))).withColumn("p", F.round("p", 8))


@query()
def bootstrap_ci(spark, sf_dir):
    return B.bootstrap_slope(_xym(spark, sf_dir), "x", "y", "id", 1000)


@query()
def bootstrap_band(spark, sf_dir):
    """The pointwise band of the line, at the grid of ``ols_grid``."""
    return B.bootstrap_band(_xym(spark, sf_dir), "x", "y", "id", 1000)


def _standard(spark, sf_dir):
    """x, m and y as standard scores of their city."""
    w = W.partitionBy("city")
    score = lambda c: ((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))).alias(c)
    return _xym(spark, sf_dir).select("city", "id", score("x"), score("m"), score("y"))


_Z = f"z AS (SELECT city, {', '.join(f'({c}-avg({c}) OVER w)/stddev_samp({c}) OVER w {c}' for c in 'xmy')} FROM ({_XYM}) WINDOW w AS (PARTITION BY city))"
_SUMS = "sum(x*x) xx, sum(m*m) mm, sum(y*y) yy, sum(x*m) xm, sum(x*y) xy, sum(m*y) my"
_PATHS = f"""f AS (SELECT *, n-g-1 d1, n-g-2 d2, xm/xx a, xy/xx total, (xy*mm-my*xm)/(xx*mm-xm*xm) c_prime, (my*xx-xy*xm)/(xx*mm-xm*xm) b FROM s),
 t AS (SELECT *, a/sqrt((mm-a*xm)/d1/xx) ta, total/sqrt((yy-total*xy)/d1/xx) tt, b/sqrt((yy-c_prime*xy-b*my)/d2*xx/(xx*mm-xm*xm)) tb, c_prime/sqrt((yy-c_prime*xy-b*my)/d2*mm/(xx*mm-xm*xm)) tc FROM f)
 SELECT *, {B.student_p_sql('ta', 'd1')} p_a, {B.student_p_sql('tb', 'd2')} p_b, {B.student_p_sql('tc', 'd2')} p_c_prime, {B.student_p_sql('tt', 'd1')} p_total, a*b indirect, a*b/total proportion FROM t"""
_ROUNDED = ("a", "p_a", "b", "p_b", "c_prime", "p_c_prime", "total", "p_total", "indirect", "proportion")


@query(f"WITH {_Z}, s AS (SELECT city, count(*) n, 1 g, {_SUMS} FROM z GROUP BY 1), {_PATHS.replace(' SELECT *, CASE', ', e AS (SELECT *, CASE', 1)}) SELECT city, n, {', '.join(f'round({c},5) {c}' for c in _ROUNDED)} FROM e")
def mediation(spark, sf_dir):
    """The paths of each city on standard scores, with their p."""
    paths = B.path_models(_standard(spark, sf_dir), "x", "m", "y", ["city"])
    return paths.select("city", "n", *[F.round(c, 5).alias(c) for c in _ROUNDED])


@query(f"WITH {_Z}, k AS (SELECT z.* FROM z WHERE city IN (SELECT city FROM z GROUP BY 1 HAVING count(*)>=5)), s AS (SELECT count(*) n, count(DISTINCT city) g, {_SUMS} FROM k HAVING count(DISTINCT city)>=2), {_PATHS.replace(' SELECT *, CASE', ', e AS (SELECT *, CASE', 1)}) SELECT n, {', '.join(f'round({c},5) {c}' for c in _ROUNDED)} FROM e")
def mediation_pooled(spark, sf_dir):
    """All cities of five units or more, with a constant for each; none if there are fewer than two."""
    z = _standard(spark, sf_dir)
    enough = z.groupBy("city").agg(F.count("*").alias("n")).where("n >= 5").select("city")
    cities = enough.agg(F.count("*").alias("cities")).where("cities >= 2")
    paths = B.path_models(z.join(enough, "city"), "x", "m", "y", [], absorb="city").crossJoin(cities)  # one row each
    return paths.select("n", *[F.round(c, 5).alias(c) for c in _ROUNDED])


@query()
def mediation_interval(spark, sf_dir):
    """Bootstrap interval of the indirect path of each city: 5000 replicates."""
    return B.indirect_interval(_standard(spark, sf_dir), "x", "m", "y", "id", ["city"])


from verdance.plans import cascades, details, models, overlays, readers, tiles  # noqa: E402, F401  register their queries

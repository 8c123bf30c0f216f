"""Queries that write files of a table in the shared folder and read them by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdance.operators import spatial as S
from verdance.plans.reports import query
from verdance.sources import files, geotiff
from verdance.sources.adapters import load


@query("SELECT tree_id, crown_area_px, x/100.0E0-97.75E0 longitude, y/100.0E0+30.0E0 latitude FROM fx_trees")
def geojson_points(spark, sf_dir):
    """Points written as features and read back."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    path = S.shared_folder(spark)
    place = ((F.col("x") / 100.0 - 97.75).alias("longitude"), (F.col("y") / 100.0 + 30.0).alias("latitude"))
    files.write_points_geojson(trees.select("tree_id", "crown_area_px", *place), path)
    return files.read_points_geojson(spark, path, "tree_id: bigint, crown_area_px: bigint")


@query("SELECT crown_area_px, count(*) n FROM fx_trees GROUP BY 1")
def geojson_attributes(spark, sf_dir):
    """Properties alone, without parsing geometries."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    path = S.shared_folder(spark)
    files.write_points_geojson(trees.select("tree_id", "crown_area_px", F.col("x").alias("longitude"), F.col("y").alias("latitude")), path)
    return files.read_points_geojson(spark, path, "crown_area_px: bigint", geometry=False).groupBy("crown_area_px").agg(F.count("*").alias("n"))


@query("SELECT unit_ord, count(*) n, round(sum(x),6) x FROM fx_trees GROUP BY 1")
def csv_columns(spark, sf_dir):
    """Two columns of a file of five, by name."""
    (trees,) = load(spark, sf_dir, "fx_trees")
    path = S.shared_folder(spark)
    files.write_csv(trees, path)
    rows = files.read_csv(spark, path, "x double, unit_ord bigint")
    return rows.groupBy("unit_ord").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


_US = """SELECT c_custkey k, concat('1500000US', lpad(CAST(c_custkey AS STRING), 12, '0')) geo,
 CASE WHEN c_custkey % 11=0 THEN '-' WHEN c_custkey % 13=0 THEN '250,000+' WHEN c_custkey % 17=0 THEN '2,500-' ELSE CAST(20000+c_custkey*37 % 90000 AS STRING) END est FROM customer"""


def _us_file(spark, sf_dir) -> str:
    (customer,) = load(spark, sf_dir, "customer")
    customer.createOrReplaceTempView("customer")
    path = S.shared_folder(spark)
    rows = spark.sql(f"SELECT geo GEO_ID, 'name' NAME, est B19013_001E, '5' B19013_001M FROM ({_US})")
    long_names = spark.sql("SELECT 'Geography' GEO_ID, 'Name' NAME, 'Estimate' B19013_001E, 'Margin' B19013_001M")
    files.write_csv(long_names.unionByName(rows), path)
    return path


@query(f"SELECT substr(geo, 10) geoid, CAST(est AS DOUBLE) median_income FROM ({_US}) WHERE k % 11<>0 AND k % 13<>0 AND k % 17<>0")
def us_income(spark, sf_dir):
    return files.read_us_income(spark, _us_file(spark, sf_dir))


@query(f"SELECT right(geo, 12) geoid, CASE est WHEN '250,000+' THEN 250000.0E0 WHEN '2,500-' THEN 2500.0E0 ELSE CAST(est AS DOUBLE) END median_income FROM ({_US}) WHERE est<>'-'")
def us_income_bounded(spark, sf_dir):
    return files.read_us_income(spark, _us_file(spark, sf_dir), bounded=True)


_CA = """SELECT concat(CASE WHEN c_custkey % 3=0 THEN '48' ELSE '59' END, lpad(CAST(c_custkey AS STRING), 6, '0')) code, CASE WHEN c_custkey % 5=0 THEN 'Census tract' ELSE 'Dissemination area' END lev,
 i id, CASE WHEN c_custkey % 7=0 THEN '..' ELSE CAST(30000+c_custkey*41 % 90000 AS STRING) END v FROM customer, (VALUES (7),(24),(243)) w(i)"""


@query(f"SELECT code geoid, round(CAST(v AS DOUBLE)/1.37E0,6) median_income FROM ({_CA}) WHERE code LIKE '59%' AND lev='Dissemination area' AND id=243 AND v<>'..'")
def canadian_income(spark, sf_dir):
    """The income rows of a long profile, whose columns stand among others."""
    (customer,) = load(spark, sf_dir, "customer")
    customer.createOrReplaceTempView("customer")
    path = S.shared_folder(spark)
    files.write_csv(spark.sql(f"SELECT 2021 CENSUS_YEAR, code ALT_GEO_CODE, lev GEO_LEVEL, 'x' GEO_NAME, 'q' DATA_QUALITY_FLAG, id CHARACTERISTIC_ID, 'c' CHARACTERISTIC_NAME, v C1_COUNT_TOTAL, 1 C2_COUNT_MEN FROM ({_CA})"), path)
    return files.read_canadian_income(spark, path, "59").select("geoid", F.round("median_income", 6).alias("median_income"))


def _rasters(spark, sf_dir, above: float | None = None) -> str:
    """The pixel tables as GeoTIFF files of 64 by 64, half a degree each."""
    (rows,) = load(spark, sf_dir, "fx_pixels")
    placed = rows.select(F.concat(F.lit("tile_"), "tile_ord").alias("name"), "r", "c", "v", (F.col("tile_ord") * 0.5 - 98.0).alias("x0"), F.lit(31.0).alias("y0"), F.lit(0.5 / 64).alias("x_step"), F.lit(-0.5 / 64).alias("y_step"))
    path = S.shared_folder(spark)
    geotiff.write_rasters(placed, path, 64, 64, above).write.format("noop").mode("overwrite").save()
    return path


def _tile_ord():
    return F.regexp_extract("path", r"tile_(\d+)\.tif", 1).cast("bigint").alias("tile_ord")


@query("SELECT tile_ord, r, c, v FROM fx_pixels WHERE r>=10 AND r<40 AND c>=5 AND c<64")
def geotiff_window(spark, sf_dir):
    """A window of written rasters, pixel for pixel."""
    window = (10, 5, 40, 64)
    rows = geotiff.pixels(geotiff.read_blocks(spark, _rasters(spark, sf_dir), band=1, window=window), window)
    return rows.where(~F.isnan("v")).select(_tile_ord(), "r", "c", "v")


@query("SELECT tile_ord, count(*) FILTER (WHERE v>0.3E0) n_above, 4096-count(*) FILTER (WHERE v>0.3E0) n_below FROM fx_pixels GROUP BY 1")
def geotiff_mask(spark, sf_dir):
    """Masks written as bytes and counted again."""
    rows = geotiff.pixels(geotiff.read_blocks(spark, _rasters(spark, sf_dir, above=0.3)))
    return rows.groupBy(_tile_ord()).agg(F.count_if(F.col("v") == 1).alias("n_above"), F.count_if(F.col("v") == 0).alias("n_below"))


@query("SELECT DISTINCT tile_ord, 64 width, 64 height, 4326 crs, tile_ord*0.5E0-98.0E0 AS \"left\", 30.5E0 bottom, tile_ord*0.5E0-97.5E0 AS \"right\", 31.0E0 top FROM fx_pixels")
def geotiff_headers(spark, sf_dir):
    """Sizes, reference system and bounds from the headers alone."""
    return geotiff.read_headers(spark, _rasters(spark, sf_dir)).select(_tile_ord(), "width", "height", "crs", "left", "bottom", "right", "top")

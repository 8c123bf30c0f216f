"""Readers and writers of text files: GeoJSON, CSV, and the income tables of two countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from verdance.functions import cleaning as C

#: The id prefix of block groups, and the income row of dissemination areas.
US_PREFIX, INCOME_ID, AREA_LEVEL = "1500000US", 243, "Dissemination area"


def write_points_geojson(df: DataFrame, path: str, x: str = "longitude", y: str = "latitude") -> None:
    """One GeoJSON feature a line, with all other columns as properties; null coordinates give a null geometry.

    Each task writes its own file, so the result does not pass through one machine."""
    others = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    geometry = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), point)
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))
    df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_points_geojson(spark: SparkSession, path: str, properties: str, geometry: bool = True) -> DataFrame:
    """Properties (a DDL string) and longitude, latitude of point features.

    Takes files of feature lines, collections with a feature to each line (as
    common writers lay them out; both are split among tasks), and collections in
    any other layout, each of which is one task.  A folder may hold all kinds.
    Without ``geometry`` the coordinates are not parsed at all; only the named
    properties ever are."""
    shape = "geometry struct<type: string, coordinates: array<double>>, " if geometry else ""
    feature = f"type string, {shape}properties struct<{properties}>"
    lines = spark.read.text(path).select(F.regexp_replace("value", r"[,\s]+$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    is_feature = F.coalesce(F.get_json_object("value", "$.type") == "Feature", F.lit(False))
    by_file = lines.where("value != ''").groupBy("file").agg(F.max(is_feature).alias("by_line"))
    whole = [r["file"] for r in by_file.where("NOT by_line").select("file").collect()]  # names of files
    inner = [c for c in ("geometry", "properties") if geometry or c != "geometry"]
    found = lines.where(is_feature).select(F.from_json("value", feature).alias("f")).select(*[F.col(f"f.{c}").alias(c) for c in inner])
    if whole:
        item = feature.replace("type string", "type: string").replace("geometry struct", "geometry: struct").replace("properties struct", "properties: struct")
        rows = spark.read.schema(f"{feature}, features array<struct<{item}>>").option("multiLine", "true").json(whole)
        one = rows.where("type = 'Feature'").select(*inner)
        many = rows.where("type = 'FeatureCollection'").select(F.explode("features").alias("f")).select(*[F.col(f"f.{c}").alias(c) for c in inner])
        found = found.unionByName(one).unionByName(many)
    place = [F.try_element_at("geometry.coordinates", F.lit(k)).alias(n) for k, n in ((1, "longitude"), (2, "latitude"))] if geometry else []
    return found.select("properties.*", *place)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """The columns of a DDL ``schema``, found by the names in the header, wherever they stand.

    Other columns of the file may stand between; a value that is not of its type
    is null, a column that the file lacks raises.  Only ``columns`` are parsed
    where given."""
    rows = spark.read.option("header", True).csv(path)
    fields = [f for f in _fields(schema) if columns is None or f.name in columns]
    found = rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])
    return found.select(*columns) if columns else found


def _fields(schema: str) -> list[StructField]:
    return list(StructType.fromDDL(schema).fields)


def _second_header_out(rows: DataFrame, column: str) -> DataFrame:
    """Drops the line of long names that follows the header."""
    return rows.where(~F.col(column).isin("Geography", "id"))


def read_us_income(spark: SparkSession, path: str, bounded: bool = False) -> DataFrame:
    """(geoid, median_income) of block groups, without nulls.

    Plainly, the prefix is stripped and what is no number goes; ``bounded``
    takes the last 12 characters and counts open-ended brackets as their bound."""
    rows = spark.read.option("header", False).schema("GEO_ID string, NAME string, estimate string, moe string, more string").csv(path)
    rows = _second_header_out(rows.where("GEO_ID != 'GEO_ID'"), "GEO_ID")
    geoid: Column = F.right("GEO_ID", F.lit(12)) if bounded else F.replace("GEO_ID", F.lit(US_PREFIX), F.lit(""))
    income = C.income_bounded(F.col("estimate")) if bounded else C.income_strict(F.col("estimate"))
    return rows.select(geoid.alias("geoid"), income.alias("median_income")).dropna()


def read_canadian_income(spark: SparkSession, path: str, prefix: str, rate: float = 1.37) -> DataFrame:
    """(geoid, median_income in US dollars) of the dissemination areas whose code starts with ``prefix``.

    Columns are found by their names in the header; files have many others."""
    rows = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    rows = rows.where((F.col("GEO_LEVEL") == AREA_LEVEL) & (F.trim("CHARACTERISTIC_ID") == str(INCOME_ID)) & F.col("ALT_GEO_CODE").startswith(prefix))
    return rows.select(F.col("ALT_GEO_CODE").alias("geoid"), (C.income_strict(F.col("C1_COUNT_TOTAL")) / rate).alias("median_income")).dropna()

"""Column builders that clean names, ids and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: City keywords in the order they are tried.
CITIES = ("austin", "bloomington", "cupertino", "surrey")


def base_name(filename: Column) -> Column:
    """The tile's name without prediction prefix and extension."""
    return F.regexp_replace(F.regexp_replace(filename, r"^pred_(pan|ndvi)_", ""), r"\.tif$", "")


def is_ndvi(filename: Column) -> Column:
    return F.lower(filename).contains("ndvi")


def city_from_name(filename: Column) -> Column:
    """The first known city in the name, capitalised; 'Unknown' if none."""
    found = F.lit("Unknown")
    for city in reversed(CITIES):
        found = F.when(F.lower(filename).contains(city), F.lit(city.title())).otherwise(found)
    return found


def tile_id(filename: Column) -> Column:
    """The first ddd_ddd between separators, or null."""
    found = F.regexp_extract(filename, r"(?:^|_)([0-9]{3}_[0-9]{3})(?:_|\.|$)", 1)
    return F.nullif(found, F.lit(""))


def offset(filename: Column, axis: int) -> Column:
    """x (axis 1) or y (axis 2) of the first ``x-y`` in the name, or null."""
    return F.regexp_extract(filename, r"([0-9]+)-([0-9]+)", axis).try_cast("bigint")


def geoid(raw: Column, digits: int) -> Column:
    """Text after the last 'US', before any '.', padded with zeros and cut to ``digits``."""
    text = F.trim(F.split_part(F.element_at(F.split(F.trim(raw), "US"), -1), F.lit("."), F.lit(1)))
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return F.substring(padded, 1, digits)


def income_strict(raw: Column) -> Column:
    """A plain number, else null."""
    return raw.try_cast("double")


def income_bounded(raw: Column) -> Column:
    """Open-ended brackets count as their bound; '-' is null."""
    return (
        F.when(raw == "250,000+", F.lit(250000.0))
        .when(raw == "2,500-", F.lit(2500.0))
        .otherwise(F.when(raw == "-", None).otherwise(raw).try_cast("double"))
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def three_figures(n: Column) -> Column:
    """An integer rounded half-even to three significant figures; 0 stays."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(n))) - 2)
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise((F.bround(n / scale, 0) * scale).cast("bigint"))

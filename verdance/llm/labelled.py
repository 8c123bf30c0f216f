"""Bounded, repeatable samples of labelled rows, for training on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdance.llm import tables

#: Bytes of text that a sample brings to the driver at most, for each label.
MOST_BYTES = 24 << 20


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_class: tuple[int, int],
    extra: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = MOST_BYTES,
) -> pd.DataFrame:
    """(text, y[, extra]) of at most ``per_class`` rows labelled 0 and 1.

    Rows come in the order of a hash of the id, from those not held out (crc32
    of the id mod 5 is not 0), whole, as long as the texts of their label hold
    at most ``most_bytes`` together (the first is always taken).  Only the
    chosen ids are broadcast: their number is the bound.  Rows without label,
    or with one that is not 0 or 1, are left out; an id that is labelled twice
    counts once with its larger label.  No usable row gives an empty frame."""
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~tables.is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y"))
    )
    rank = [F.xxhash64("_id", F.lit(7)), F.col("_id")]
    chosen = [usable.where(F.col("_y") == y).orderBy(*rank).limit(per_class[y]) for y in (0, 1)]
    picked = tables.written(chosen[0].unionByName(chosen[1]), "labelled")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), *(F.col(f"`{c}`").alias(f"_x{k}") for k, c in enumerate(extra or [])))
    rows = tables.written(rows.join(F.broadcast(picked), "_id"), "labelled-texts")
    before = F.sum(F.octet_length("_text")).over(Window.partitionBy("_y").orderBy(*rank, "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(Window.partitionBy("_y").orderBy(*rank, "_text"))
    kept = rows.select("*", before.alias("_bytes"), place.alias("_place")).where((F.col("_bytes") <= most_bytes) | (F.col("_place") == 1))
    out = kept.drop("_bytes", "_place").toPandas().sort_values(["_id", "_text"], ignore_index=True)
    tables.drop(picked, rows)
    return out.rename(columns={"_id": "doc_id", "_text": "text", "_y": "y"} | {f"_x{k}": c for k, c in enumerate(extra or [])})

"""Line dedup: drop lines that many documents share, keeping one copy.

All of it is DataFrame code.  A document's lines are exploded once with their
normalised keys; keys are hashed, and distinct documents per hash are counted
with map-side partial aggregation, so a line that a third of all documents hold
adds one row per task and not one per document.  What is dropped is joined back
by hash, gathered per document (bounded by that document's own lines) and
applied to the document's line array by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import tables

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return tables.ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame,
    min_docs: int = 3,
    min_chars: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with its text replaced, plus ``n_lines`` and ``n_dropped`` (long).

    A line's key is the line without blanks at its ends and with A-Z
    lower-cased.  A key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses all its lines except those in the largest id
    that holds it.  All other columns pass through, whatever their names; ones
    called ``n_lines`` or ``n_dropped`` are replaced.

    Null or empty text: one empty line, nothing dropped, text becomes empty.
    Null id: the text is kept whole and counts for no key.  Repeated ids count
    as one document and share their verdicts.  Empty tables give empty tables.
    Keys are compared by a 96-bit hash.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    base = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1).alias("_lines"),
    )
    keys = F.filter(
        F.transform("_lines", line_key), lambda k: F.char_length(k) >= min_chars
    )
    held = (
        base.where("_id IS NOT NULL")
        .select("_id", F.explode(F.array_distinct(keys)).alias("key"))
        .select("_id", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    )
    held = tables.written(held, "held-lines")
    common = (
        held.distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("_id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last")
    )
    common = tables.written(common, "lines")
    dropped = (
        held.join(common, ["h1", "h2"])
        .where("_id < last")
        .groupBy("_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    )
    gone = F.coalesce("_gone", F.array().cast("array<struct<h1:bigint,h2:int>>"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        mark = F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))
        return ~((F.char_length(key) >= min_chars) & F.array_contains("_gone", mark))

    kept = F.when(F.size("_gone") > 0, F.filter("_lines", stays)).otherwise(F.col("_lines"))
    # Rows without id lose nothing and stay out of the join, where they would meet in one task.
    joined = base.where("_id IS NOT NULL").join(dropped, "_id", "left").withColumn("_gone", gone)
    bare = base.where("_id IS NULL").withColumn("_gone", F.array().cast("array<struct<h1:bigint,h2:int>>"))
    result = joined.unionByName(bare).withColumn("_kept", kept)
    texts = F.array_join("_kept", "\n")
    return result.select(
        *[(texts if c == text_col else F.col("_row").getField(c)).alias(c) for c in own],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


_STRIP = "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL_LINES = f"""
lines AS (
  SELECT doc_id, pos, line, translate({_STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{docs}}))),
common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id < c.last AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key)
"""

OP8_SQL = f"""
WITH {SQL_LINES.format(docs="documents")}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""New tiles as a stream: files in, each detection once, batches out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def detections(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Detections of Parquet files as they arrive; a tile that is sent again adds nothing."""
    return spark.readStream.schema(schema).parquet(folder).dropDuplicates(["tile_ord", "label"])


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All files that wait, batch by batch, then stop; a restart goes on from the checkpoint."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of Parquet files as they arrive, repeated ones too: a stream without state."""
    return spark.readStream.schema(schema).parquet(folder)


def append_new(stream: DataFrame, sink: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Adds to the Parquet folder ``sink`` the rows of all waiting files whose ``keys`` it does not hold, then stops.

    What was seen is what ``sink`` holds: a batch leaves out the keys of the
    other batches, so the stream keeps no state however long it runs, and a tile
    that is sent again adds nothing.  Of rows with equal keys in a batch any one
    stays; null keys count as equal.  Each batch has a folder of its own, ``batch=N``, and replaces
    it when it is run again after a failure.  A batch reads the key columns of
    all of ``sink``; both are partitioned by the keys."""
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("ignore").parquet(f"{sink}/batch=-1")
    held = StructType(stream.schema.fields).add("batch", "long")

    def add(rows: DataFrame, n: int) -> None:
        before = rows.sparkSession.read.schema(held).parquet(sink).where(F.col("batch") != n).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows.dropDuplicates(keys).join(before, same, "left_anti").write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return run_once(stream, checkpoint, add)

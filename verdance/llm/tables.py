"""Reading tables, and cutting lineage where every executor can read the cut."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local, as in tests on one
    machine, a folder is made; on a cluster that raises."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    The table survives lost executors, so what follows never recomputes ``df``.
    It goes with ``drop``, or when the session's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, so that what
    stands in the shared folder does not grow with the number of steps."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Texts of ASCII alone take the faster built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, lower)
    )


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0

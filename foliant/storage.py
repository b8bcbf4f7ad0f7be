"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that this process has stored, in order.
TABLES: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent (tests, notebooks) a temporary folder is made, but only for a
    local master: on a cluster no machine-local folder is ever used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation, and values that
    are not reproducible (row numbers) are fixed once for all later uses.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input files, compressed as they are, for a task of :func:`dealt`; less than four of them are not dealt.
SHARE = 4 << 20


def shares(*frames: DataFrame) -> int | None:
    """How many tasks should handle frames together, by the largest table that one of them reads;
    None for small tables and where no table's size is known.  Nothing is read for it."""
    most = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        most = max([most, *(n for n in sizes if n < 1 << 60)])  # where Spark knows no size it says 2^63 - 1
    if most <= 4 * SHARE:
        return None
    # with fewer than its own number of parts Spark would deal the sides of a join anew
    return max(-(-most // SHARE), int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, by: str, n: int | None) -> DataFrame:
    """Rows dealt by a column to ``n`` tasks.  Left to itself Spark deals to a fixed number and
    joins small parts by their compressed bytes, so a task's rows grow with the table."""
    return df.repartition(n, by) if n else df


def mark() -> int:
    """A point in the list of stored tables, for :func:`drop_since`."""
    return len(TABLES)


def drop_since(spark: SparkSession, point: int, *keep: DataFrame) -> None:
    """Remove the tables that were stored since a mark, but for those that ``keep`` reads.  Only
    for tables that nothing else will read: all that was made from them is stored itself."""
    # a table's folder has a name of its own, however its path is written
    kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    for path in TABLES[point:]:
        if path.rsplit("/", 1)[-1] not in kept:
            remove(spark, path)
    TABLES[point:] = [p for p in TABLES[point:] if p.rsplit("/", 1)[-1] in kept]


def filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of a path, and the path as it knows it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(own)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written from the driver to wherever executors read."""
    fs, own = filesystem(spark, path)
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, own = filesystem(spark, path)
    fs.delete(own, True)


def folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{work_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"

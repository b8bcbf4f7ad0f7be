"""Document sets: DataFrames of distinct ``docid``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docid").union(b.select("docid")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docid").distinct().join(b, "docid", "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("docid").distinct().join(b, "docid", "left_anti")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """In one set but not both: one shuffle, by a count of sides."""
    sides = a.select("docid", F.lit(1).alias("side")).union(b.select("docid", F.lit(2).alias("side")))
    return sides.groupBy("docid").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x = y").select("docid")


def flip(a: DataFrame, capacity: int) -> DataFrame:
    """All ids from 1 to the capacity that are not in the set."""
    return a.sparkSession.range(1, capacity + 1).toDF("docid").join(a, "docid", "left_anti")


def insert(a: DataFrame, docid: int) -> DataFrame:
    return union(a, a.sparkSession.range(docid, docid + 1).toDF("docid"))


def remove(a: DataFrame, docid: int) -> DataFrame:
    return a.where(F.col("docid") != docid)


def contains(a: DataFrame, docids: DataFrame) -> DataFrame:
    """``docid, member`` for each asked id."""
    flagged = a.select("docid").distinct().withColumn("member", F.lit(True))
    return docids.select("docid").distinct().join(flagged, "docid", "left").select("docid", F.coalesce("member", F.lit(False)).alias("member"))


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.countDistinct("docid").alias("documents"))


def ordered(a: DataFrame) -> DataFrame:
    return a.select("docid").distinct().orderBy("docid")


def describe(a: DataFrame, capacity: int) -> DataFrame:
    """``documents, is_nil, size, bytes``: how many there are, whether there are none, and the bits
    and bytes of a bitmap of the capacity."""
    n = a.agg(F.countDistinct("docid").alias("documents"))
    return n.select("documents", (F.col("documents") == 0).alias("is_nil"), F.lit(capacity).cast("long").alias("size"), F.lit(-(-capacity // 8)).cast("long").alias("bytes"))

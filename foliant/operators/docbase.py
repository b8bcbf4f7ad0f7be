"""Documents with stable ids: allocation, upsert, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, shares, stored
from . import index


class CapacityError(RuntimeError):
    """A docbase has no free ids left."""


def free_ids(docs: DataFrame, capacity: int) -> DataFrame:
    """Ids from 1 to the capacity that no document has."""
    return docs.sparkSession.range(1, capacity + 1).toDF("docid").join(docs.select("docid"), "docid", "left_anti")


def lowest_free(docs: DataFrame, capacity: int) -> DataFrame:
    """``docid``: the id that the next document gets; null in a full docbase."""
    return free_ids(docs, capacity).agg(F.min("docid").alias("docid"))


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in an order, without gathering the rows in one task: rows are
    ranged, stored, counted by partition, and numbered inside partitions."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
    counts = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts, "_p long, _s long")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_s")).drop("_p", "_i", "_s")


def _lowest(docs: DataFrame, need: int, capacity: int) -> DataFrame:
    """The lowest ``need`` free ids and few more: used ids are counted by ranges (65,536 numbers
    at most), and only ids up to the range that has enough are listed."""
    width = max(1 << 12, -(-capacity // (1 << 16)))
    used = dict(docs.where(F.col("docid").between(1, capacity)).groupBy(F.floor((F.col("docid") - 1) / width).cast("long").alias("r")).agg(F.countDistinct("docid").alias("n")).collect())
    free = top = 0
    while free < need and top < capacity:
        own = min(width, capacity - top)
        free, top = free + own - used.get(top // width, 0), top + own
    if need > free:
        raise CapacityError(f"{need} new documents, but {free} free ids up to {capacity}")
    return free_ids(docs.where(F.col("docid") <= top), top)


def allocate(docs: DataFrame, names: DataFrame, capacity: int) -> DataFrame:
    """``name, docid`` for names without a document yet: in order of name, the lowest free ids.
    Raises if they do not fit."""
    new = stored(names.select("name").distinct().join(docs, "name", "left_anti"), "new")
    free = _lowest(docs, new.count(), capacity)
    return _numbered(new, "name", "n").join(_numbered(free, "docid", "n"), "n").select("name", "docid")


def upsert(docs: DataFrame, batch: DataFrame, capacity: int) -> DataFrame:
    """``docid, name, content`` after putting a batch of ``name, content``: a known name keeps its
    id, a new one gets the lowest free id.  Of names that a batch repeats, the row of greatest
    ``seq`` counts (or of greatest content, without that column)."""
    by = "seq" if "seq" in batch.columns else "content"
    last = batch.groupBy("name").agg(F.max_by("content", by).alias("content"))
    known = last.join(docs.select("name", "docid"), "name")
    fresh = last.join(allocate(docs, last, capacity), "name")
    put = known.select("docid", "name", "content").union(fresh.select("docid", "name", "content"))
    return docs.select("docid", "name", "content").join(put, "docid", "left_anti").union(put)


def reindex(postings: DataFrame, fresh: DataFrame, docids: DataFrame) -> DataFrame:
    """Postings with those of some documents replaced."""
    fresh = fresh.select("key", "docid")
    return index.delete(postings.select("key", "docid"), docids).union(dealt(fresh, "docid", shares(fresh)).distinct())


def delete(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Without some names; unknown ones change nothing.  Their ids are free again."""
    return docs.join(names.select("name").distinct(), "name", "left_anti").select(*docs.columns)

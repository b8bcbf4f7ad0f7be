"""The inverted index: postings ``(key, docid)`` as a set, and lists that keep duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, shares

#: Document ids of one bitmap of Spark's ``bitmap_*`` functions.
BUCKET = 32_768


def build(entries: DataFrame) -> DataFrame:
    """Postings as a set; entries without a key are none."""
    return dealt(entries.where("key IS NOT NULL").select("key", "docid"), "docid", shares(entries)).distinct()


def lists(entries: DataFrame) -> DataFrame:
    """``key, occurrences, documents``: entries counted with and without duplicates."""
    return entries.groupBy("key").agg(F.count("docid").alias("occurrences"), F.countDistinct("docid").alias("documents"))


def show(postings: DataFrame, separator: str = " ") -> DataFrame:
    """``key, docids``: the sorted document ids of each key as one string.  This is a dump for
    people: a key's ids are gathered; for large sets use :func:`bitmaps`."""
    ids = F.array_sort(F.collect_set("docid"))
    return postings.groupBy("key").agg(F.array_join(F.transform(ids, lambda d: d.cast("string")), separator).alias("docids"))


def dump_lists(entries: DataFrame, separator: str = ",") -> DataFrame:
    """``key, docids``: the ids of each key as one string, duplicates included and each followed by
    the separator.  A dump for people, as :func:`show` is."""
    ids = F.array_sort(F.collect_list("docid"))
    return entries.groupBy("key").agg(F.concat(F.array_join(F.transform(ids, lambda d: d.cast("string")), separator), F.lit(separator)).alias("docids"))


def show_chunks(postings: DataFrame, width: int = BUCKET, separator: str = " ") -> DataFrame:
    """``key, chunk, docids``: a dump whose rows have the ids of ``width`` consecutive ones at most,
    however many a key has."""
    parts = postings.withColumn("chunk", F.floor((F.col("docid") - 1) / width).cast("long"))
    ids = F.array_sort(F.collect_set("docid"))
    return parts.groupBy("key", "chunk").agg(F.array_join(F.transform(ids, lambda d: d.cast("string")), separator).alias("docids"))


def bitmaps(postings: DataFrame) -> DataFrame:
    """``key, bucket, bits``: document sets as bitmaps of 32,768 ids, built with partial
    aggregation; no row grows with the number of documents."""
    return postings.groupBy("key", F.bitmap_bucket_number("docid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("docid")).alias("bits"))


def bitmap_union_count(maps: DataFrame) -> DataFrame:
    """``documents``: how many documents the union of bitmaps has."""
    merged = maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("documents"))


def get(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, documents``: for each asked key the number of its documents, zero if unknown.  Only
    entries of asked keys are shuffled; they need not be distinct."""
    asked = keys.select("key").distinct()
    found = entries.join(asked, "key", "left_semi").groupBy("key").agg(F.countDistinct("docid").alias("documents"))
    return asked.join(found, "key", "left").select("key", F.coalesce("documents", F.lit(0)).alias("documents"))


def lookup(postings: DataFrame, key: object) -> DataFrame:
    return postings.where(F.col("key") == F.lit(key)).select("docid").distinct()


def lower_bound(postings: DataFrame, key: object) -> DataFrame:
    """``key``: the smallest key that is not below the given one (null if there is none)."""
    return postings.where(F.col("key") >= F.lit(key)).agg(F.min("key").alias("key"))


def cursor(postings: DataFrame, key: object | None = None) -> DataFrame:
    """Keys in order, from a given one on."""
    found = postings if key is None else postings.where(F.col("key") >= F.lit(key))
    return found.select("key").distinct().orderBy("key")


def key_range(postings: DataFrame, low: object, high: object) -> DataFrame:
    """Documents of all keys from ``low`` to ``high``, both included."""
    return postings.where(F.col("key").between(F.lit(low), F.lit(high))).select("docid").distinct()


def put(postings: DataFrame, entries: DataFrame) -> DataFrame:
    both = postings.select("key", "docid").union(entries.select("key", "docid"))
    return dealt(both, "docid", shares(both)).distinct()


def unput(postings: DataFrame, entries: DataFrame) -> DataFrame:
    return postings.join(entries.select("key", "docid").distinct(), ["key", "docid"], "left_anti")


def delete(postings: DataFrame, docids: DataFrame) -> DataFrame:
    """Without all postings of some documents; keys that become empty vanish."""
    return _by_docid(postings, docids, "left_anti")


def restrict(postings: DataFrame, docids: DataFrame) -> DataFrame:
    """Postings of some documents alone."""
    return _by_docid(postings, docids, "left_semi")


def _by_docid(postings: DataFrame, docids: DataFrame, how: str) -> DataFrame:
    n, ids = shares(postings, docids), docids.select("docid")
    if n:  # a task's share of the ids is small enough for a hash table, so no postings are sorted
        ids = dealt(ids, "docid", n).hint("shuffle_hash")
    return dealt(postings, "docid", n).join(ids, "docid", how).select(*postings.columns)


def duplicates(postings: DataFrame) -> DataFrame:
    """``key, documents`` of keys that break uniqueness."""
    return postings.groupBy("key").agg(F.countDistinct("docid").alias("documents")).where("documents > 1")


def summary(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("key").alias("keys"), F.countDistinct("docid").alias("documents"), F.count("*").alias("postings"))

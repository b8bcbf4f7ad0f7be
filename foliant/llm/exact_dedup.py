"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are never shuffled to find copies: each step works on narrow rows of the step before, and
what it lets through is told to the next scan by a bit map of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

#: Characters under the second test.
PREFIX = 128
#: Bits of a sieve: 16 for each key that it holds, this many at most (32 MB).
SIEVE_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sieve(keys: DataFrame) -> tuple[DataFrame, int]:
    """A bit map of hashes (column ``h``), as rows ``sieve, bits`` of 4 KB, and its number of bits.

    A hash that is in ``keys`` is always found; another one seldom, which costs its reader
    some work but changes no result.
    """
    n = keys.count()
    size = 1 << 15
    while size < min(16 * n, SIEVE_BITS):
        size *= 2
    place = F.pmod("h", F.lit(size)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("sieve")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return stored(rows, "sieve"), size


def _sifted(rows: DataFrame, sieve: tuple[DataFrame, int], h: Column, name: str) -> DataFrame:
    """``rows`` with a flag: whether the sieve may hold a hash.  The broadcast is bounded by
    :data:`SIEVE_BITS`."""
    table, size = sieve
    place = F.pmod(h, F.lit(size)) + 1
    with_place = rows.withColumn("\x01at", F.bitmap_bit_position(place).cast("int")).withColumn("\x01row", F.bitmap_bucket_number(place))
    joined = with_place.join(F.broadcast(table), F.col("\x01row") == F.col("sieve"), "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("\x01at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, F.col("\x01at").bitwiseAND(7)) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop("\x01at", "\x01row", "sieve", "bits")


def _pairs(narrow: DataFrame) -> DataFrame:
    """``len, ph`` that several rows share.  Only rows whose length is shared take part."""
    lengths = stored(narrow.groupBy("len").agg(F.count("*").alias("m")).where("m > 1").select("len"), "lengths")
    shared = narrow.join(lengths, "len", "left_semi")
    return stored(shared.groupBy("len", "ph").agg(F.count("*").alias("n")).where("n > 1").select("len", "ph"), "pairs")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, norm, len, ph`` of each row."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("id", "norm", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("ph"))


def _full(norm: str | Column) -> Column:
    return F.unhex(F.sha2((F.col(norm) if isinstance(norm, str) else norm).cast("binary"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after :func:`normalised`.  The refinement:

    1. rows whose length no other row has are settled;
    2. of the rest, rows whose prefix hash no other row of their length has are settled;
    3. only the rest have their full text hashed (SHA-256), and are grouped by it.

    ``hash_all`` also fills ``text_sha256`` for settled rows, else it is null there; then the
    one scan that measures the texts hashes them, too.

    Defined cases: a null text equals an empty one; a null id sorts after every number, and a
    group of null ids only has a null ``keep_id``; of repeated rows with one id and one text
    exactly one is kept; rows with one id and other texts are judged apart; an empty table
    gives an empty result; other columns of ``docs`` are ignored.

    Hot groups: every group-by combines before its shuffle; joins have narrow rows of stored
    tables on both sides, so AQE can split a hot key; no window gathers a group.
    """
    rows = _measured(docs, id_col, text_col)
    uid = F.monotonically_increasing_id().alias("uid")
    if hash_all:
        hashed = stored(rows.select("id", "len", "ph", _full("norm").alias("sha"), uid), "hashed")
        candidates = hashed.join(_pairs(hashed), ["len", "ph"], "left_semi")
    else:
        sieve = _suspects(stored(rows.select("len", "ph"), "measured"))
        flagged = _sifted(rows, sieve, F.xxhash64("len", "ph"), "suspect")
        hashed = stored(flagged.select("id", "len", "ph", F.when(F.col("suspect"), _full("norm")).alias("sha"), uid), "hashed")
        candidates = hashed.where("sha IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid")))
    groups = candidates.groupBy("sha").agg(first.alias("first"), F.count("*").alias("size")).where("size > 1")
    groups = stored(groups.select("sha", F.col("first.id").alias("first_id"), F.col("first.uid").alias("first_uid"), "size"), "groups")
    out = hashed.join(groups, "sha", "left")
    grouped = F.col("size").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(grouped, F.col("first_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("first_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _suspects(measured: DataFrame) -> tuple[DataFrame, int]:
    return _sieve(_pairs(measured).select(F.xxhash64("len", "ph").alias("h")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies; all columns stay as they are.

    Of equal texts the row with the smallest id stays (null ids last; of rows that repeat id
    and text, any one).  Columns may have any names.  Texts that length and prefix hash settle
    pass without being hashed or shuffled; the others meet the ids that stay by (hash, id), so
    that a large group is spread over its ids.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    norm = normalised(F.col(text_col))
    measured = docs.select(F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("ph"))
    sieve = _suspects(stored(measured, "measured"))
    rows = docs.withColumn("\x01norm", norm)
    key = F.xxhash64(F.octet_length("\x01norm"), F.xxhash64(F.substring("\x01norm", 1, PREFIX)))
    flagged = _sifted(rows, sieve, key, "\x01suspect")
    suspects = flagged.where("`\x01suspect`").withColumn("\x01hash", _full("\x01norm"))
    hashed = stored(suspects.select(F.col(id_col).alias("id"), F.col("\x01hash").alias("sha")), "hashed")
    rows_of = hashed.groupBy("sha", "id").agg(F.count("*").alias("n"))
    least = rows_of.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("n"))).alias("first"))
    keep = stored(least.select(F.col("sha").alias("\x01sha"), F.col("first.id").alias("\x01keep"), F.col("first.n").alias("\x01n")), "keep")
    marked = suspects.join(keep, (F.col("\x01hash") == F.col("\x01sha")) & F.col(id_col).eqNullSafe(F.col("\x01keep")))
    single = flagged.where("NOT `\x01suspect`").select(*names).unionByName(marked.where("`\x01n` = 1").select(*names))
    # rows that repeat the kept id and text: a combining aggregate leaves one of each
    return single.unionByName(marked.where("`\x01n` > 1").dropDuplicates(["\x01hash"]).select(*names))

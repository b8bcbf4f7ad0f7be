"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored, work_dir

__all__ = ["SPACE", "crc", "crc_mod", "few", "raw_bytes", "slices", "stored", "table", "texts", "work_dir"]

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def few(rows: DataFrame, h: Column, limit: int) -> DataFrame:
    """``limit`` rows at most, those of the smallest hashes (column ``h``, 64 bits): all that lie
    below a bound.  The bound comes from counts of ranges of hashes, 4,096 numbers whatever the
    size of the table, and no rows are sorted or gathered to find it.  Fewer rows than ``limit``
    are left by the range that would exceed it, so equal hashes should be rare.
    """
    total = rows.count()
    if total <= limit:
        return rows
    space = 1 << 62
    u = h.bitwiseAND(space - 1)
    top = min(space, 2 * limit * space // total)
    width = max(1, -(-top // 4096))
    part = F.floor(u / F.lit(width)).cast("long")
    counts = dict(rows.where(u < top).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    taken = ranges = 0
    while ranges < 4096 and taken + counts.get(ranges, 0) <= limit:
        taken, ranges = taken + counts.get(ranges, 0), ranges + 1
    return rows.where(part < ranges).where(u < top)


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array without copying, and the row offsets.

    A null row has length zero.
    """
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    view = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():
            return raw_bytes(pa.array([b"" if x is None else x if isinstance(x, bytes) else x.encode() for x in column.to_pylist()], pa.large_binary()))
    return view, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        _, offsets = raw_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

"""Snapshots of docbases as Parquet: each change is a new version.

Layout below a root that all executors share::

    v=<n>/docs                       docid, name, content
    v=<n>/index=<name>/              key (typed), docid; ranged and sorted by key

A version is written to a folder of its own and then renamed to ``v=<n>`` as a whole, so readers
see it complete or not at all, and of two writers of one version the second fails.  Readers of
an older version are never disturbed.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..storage import filesystem, remove, write_text

#: Postings kept in memory, by session, root, version and name.
CACHE: dict[tuple[str, str, int, str], DataFrame] = {}


class ConflictError(RuntimeError):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The newest version; 0 before the first."""
        fs, root = filesystem(self.spark, self.root)
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return max([int(m[1]) for n in names if (m := re.fullmatch(r"v=(\d+)", n))], default=0)

    def commit(self, docs: DataFrame, indexes: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write the next version.  ``expected`` guards against lost updates: it must still be
        the newest version."""
        now = self.version()
        if expected is not None and expected != now:
            raise ConflictError(f"version {now} was written meanwhile")
        own = uuid.uuid4().hex
        path = f"{self.root}/_new-{own}"
        docs.write.parquet(f"{path}/docs")
        for name, postings in indexes.items():
            # sorted ranges give row groups narrow key statistics, so filters skip most of them
            postings.select("key", "docid").repartitionByRange("key").sortWithinPartitions("key", "docid").write.parquet(f"{path}/index={name}")
        write_text(self.spark, f"{path}/_owner-{own}", "")
        self._publish(path, f"{self.root}/v={now + 1}", own)
        return now + 1

    def _publish(self, source: str, target: str, own: str) -> None:
        jvm = self.spark._jvm
        fs, a = filesystem(self.spark, source)
        b = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(a, b, none)
        except Py4JJavaError as e:
            remove(self.spark, source)
            if fs.exists(b):
                raise ConflictError(f"{target} was written meanwhile") from e
            raise
        # where renaming is no single step, the owner's mark tells who was first
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(b, f"_owner-{own}")):
            raise ConflictError(f"{target} was written meanwhile")

    def docs(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version or self.version()}/docs")

    def index(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version or self.version()}/index={name}")

    def cached(self, name: str, version: int | None = None) -> DataFrame:
        """Postings that many queries ask, kept on the executors (on disk where memory is short)
        until :meth:`forget`.  A version never changes, so what is kept is never stale."""
        version = version or self.version()
        key = (self.spark.sparkContext.applicationId, self.root, version, name)
        if key not in CACHE:
            CACHE[key] = self.index(name, version).persist(StorageLevel.MEMORY_AND_DISK)
        return CACHE[key]

    def forget(self) -> None:
        """Drop what :meth:`cached` keeps of this store."""
        for key in [k for k in CACHE if k[:2] == (self.spark.sparkContext.applicationId, self.root)]:
            CACHE.pop(key).unpersist()

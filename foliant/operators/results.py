"""What a query found: ids, documents, counts and printed forms."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


class Results:
    """Document ids of a docbase with their documents (``docid, name, content``)."""

    def __init__(self, docids: DataFrame, docs: DataFrame):
        self.docids, self.docs, self.started = docids, docs, time.process_time()

    def count(self) -> int:
        return self.docids.count()

    def documents(self) -> DataFrame:
        """Contents are read for hits alone."""
        return self.docs.join(self.docids, "docid", "left_semi")

    def names(self) -> DataFrame:
        return self.documents().select("docid", "name")

    def top(self, limit: int = 20) -> DataFrame:
        """The documents of smallest ids: a report of ``limit`` rows."""
        return self.documents().orderBy("docid").limit(limit)

    def xml_rows(self) -> DataFrame:
        """``at, line``: a result document, its lines in the order of ``at``.  Ids are found once."""
        found = stored(self.docids.select("docid"), "found")
        took = f"{time.process_time() - self.started:.10g}"
        head = found.agg(F.count("*").alias("n")).select(F.lit(-(1 << 62)).alias("at"), F.concat(F.lit('<results count="'), "n", F.lit(f'" querytime="{took}">')).alias("line"))
        body = self.docs.join(found, "docid", "left_semi").select(F.col("docid").alias("at"), F.col("content").alias("line"))
        tail = found.sparkSession.range(1).select(F.lit(1 << 62).alias("at"), F.lit("</results>").alias("line"))
        return head.union(body).union(tail)

    def xml(self) -> Iterator[str]:
        """Lines of :meth:`xml_rows`; they stream through the driver one partition at a time."""
        for row in self.xml_rows().orderBy("at").toLocalIterator():
            yield row["line"]

    def text(self, limit: int = 20) -> Iterator[str]:
        """The first documents, then how many there are."""
        for row in self.top(limit).select("content").collect():
            yield row["content"]
            yield ""
        yield f"{self.count()} hit(s)"


def fetch(docids: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(docids, "docid", "left_semi")


def hit_count(docids: DataFrame) -> DataFrame:
    return docids.agg(F.count("*").alias("hits"))

"""Documents from files, and keys from documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import parse_key
from ..functions.text import ascii_only, file_docid, or_missing, xml_escape
from ..plans.catalog import IndexDef


def read_documents(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``name, path, content``: a row for each file; the name is the file's own."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _steps(path: str) -> tuple[list[str], str | None]:
    m = re.fullmatch(r"(.*?)(?:/@([\w:.-]+)|/text\(\))?", path.strip())
    assert m
    return [m[1]], m[2]


def select_texts(content: str | None, path: str) -> list[str] | None:
    """Text content of all nodes that a path names: ``/root/a/b``, ``//b``, ``.../@name`` and the
    predicates that ElementTree knows.  None for malformed documents."""
    try:
        root = ET.fromstring(content or "")
    except ET.ParseError:
        return None
    (steps,), attribute = _steps(path)
    if steps.startswith("//"):
        tag = steps[2:].split("/", 1)
        nodes = [*([root] if root.tag == tag[0] and len(tag) == 1 else []), *root.findall(f".{steps}")]
    else:
        parts = steps.lstrip("/").split("/", 1)
        if parts[0] not in ("*", "", root.tag):
            return []
        nodes = root.findall(parts[1]) if len(parts) > 1 else [root]
    if attribute:
        return [n.get(attribute) for n in nodes if n.get(attribute) is not None]  # type: ignore[misc]
    return ["".join(n.itertext()) for n in nodes]


def texts_at(content: Column, path: str) -> Column:
    """An array of :func:`select_texts`, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def texts(s: pd.Series) -> pd.Series:
        return s.map(lambda c: select_texts(c, path))

    return texts(content)


def extract_keys(docs: DataFrame, index: IndexDef, mode: str = "c_prefix") -> DataFrame:
    """``key, docid`` of an index: every node's text is a key of its type; malformed documents
    and, in ``strict`` mode, texts that are no such key give none."""
    texts = docs.select("docid", F.explode(texts_at(F.col("content"), index.path)).alias("t"))
    return texts.select(parse_key(F.col("t"), index.type, mode).alias("key"), "docid").where("key IS NOT NULL").distinct()


def entries_of(docs: DataFrame, path: str) -> DataFrame:
    """``key, file``: an entry for each node, in files that parse."""
    return docs.select(F.explode(texts_at(F.col("content"), path)).alias("key"), F.col("path").alias("file"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``key, docid`` from entry files: the id is the number of the file's name; a missing child
    reads NOTFOUND; duplicates stay."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("key struct<_VALUE string, _type string>, file string").load(path)
    return rows.select(or_missing(F.col("key._VALUE")).alias("key"), file_docid(or_missing(F.col("file"))).alias("docid"))


def write_entries(entries: DataFrame, path: str) -> None:
    """``<entries><entry><key type="text">K</key><file>F</file></entry>...</entries>``"""
    key = F.struct(F.col("key").alias("_VALUE"), F.lit("text").alias("_type")).alias("key")
    entries.select(key, "file").write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)


def read_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``n, content``: the records of one large XML file, each with its element around it,
    numbered from 1 in order; the file is split between tasks."""
    lines = spark.read.option("lineSep", f"</{tag}>").text(path).withColumn("n", F.monotonically_increasing_id())
    body = F.regexp_extract("value", rf"(?s)(<{tag}(?:\s[^>]*)?>.*)$", 1)
    return number(lines.select("n", body.alias("body")).where("body <> ''").select("n", F.concat("body", F.lit(f"</{tag}>")).alias("content"))).select("n", "content")


def number(rows: DataFrame) -> DataFrame:
    """Consecutive ``n`` from 1 in place of increasing but gapped ones."""
    from ..operators.docbase import _numbered

    return _numbered(rows.withColumnRenamed("n", "_at"), "_at", "n").withColumn("n", F.col("n") + 1).drop("_at")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``name, content``: line n as document ``n.xml``."""
    rows = number(spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("content")))
    return rows.select(F.concat(F.col("n").cast("string"), F.lit(".xml")).alias("name"), "content")


def read_tsv(spark: SparkSession, path: str, ascii: bool = False) -> DataFrame:
    """Rows of a tab-separated file with a header: short rows are padded with empty texts, extra
    fields are dropped, quotes are letters."""
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].split() if head else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", enforceSchema=True).fillna("")
    return rows.select(*[(ascii_only(F.col(n)) if ascii else F.col(n)).alias(n) for n in names])


def rows_as_xml(rows: DataFrame, tag: str, columns: list[str] | None = None) -> DataFrame:
    """``content``: an element for each row."""
    from ..functions.text import row_xml

    return rows.select(row_xml(tag, columns or rows.columns).alias("content"))


__all__ = ["entries_of", "extract_keys", "read_documents", "read_entries", "read_lines", "read_records", "read_tsv", "rows_as_xml", "select_texts", "texts_at", "write_entries", "xml_escape"]

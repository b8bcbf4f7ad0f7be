"""XML text, paths and clean-up, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import parse_key

MISSING = "NOTFOUND"


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def element(name: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>"))


def row_xml(tag: str, columns: list[str]) -> Column:
    """One element for a row, with an escaped element for each column; nulls are empty."""
    return element(tag, F.concat(*[element(c, xml_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns]))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("." + extension.lstrip(".")))


def file_docid(path: Column) -> Column:
    """The leading number of a file's name."""
    return parse_key(basename(path), "uint32")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def or_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))

"""Key types: how text becomes a typed key column, and a literal of that type.

``c_prefix`` parsing follows the C library: the longest numeric prefix counts, no digits are
zero, negatives wrap in unsigned types and overflow saturates at 64 bits before truncation.
``strict`` parsing gives null (no key) for text that is not wholly a number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WHOLE = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"
#: Of numbers of 18 digits at most, which no type saturates: sign and digits; of longer ones: digits, sign.
SHORT = r"^[ \t\n\x0B\f\r]*([+-]?0*[0-9]{1,18})(?![0-9])"
LONG = r"^[ \t\n\x0B\f\r]*[+-]?0*([0-9]+)"
MINUS = r"^[ \t\n\x0B\f\r]*-"
REAL = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@dataclass(frozen=True)
class KeyType:
    name: str
    spark: str
    column: Callable[[Column], Column]
    literal: Callable[[str], object]
    strict: Callable[[Column], Column]


def _whole(bits: int, signed: bool, spark: str, saturate_signed: bool = False) -> tuple[Callable[[Column], Column], Callable[[str], object]]:
    top, wrap = 1 << 64, 1 << bits
    high, low = ((1 << 63) - 1, 1 << 63) if saturate_signed else (top - 1, top - 1)

    def number(n: int) -> Column:
        return F.lit(Decimal(n)).cast("decimal(22,0)")

    def wrapped(v: Column) -> Column:
        return F.pmod(v + number(wrap // 2), number(wrap)) - number(wrap // 2) if signed else F.pmod(v, number(wrap))

    def column(s: Column) -> Column:
        # every part is named as few times as can be: Spark computes an expression anew where it is named
        short = F.nullif(F.regexp_extract(s, SHORT, 1), F.lit("")).cast("bigint")
        if bits < 64:
            short = (F.shiftright if signed else F.shiftrightunsigned)(F.shiftleft(short, 64 - bits), 64 - bits)
        elif not signed:
            short = wrapped(short.cast("decimal(22,0)"))
        size = F.left(F.regexp_extract(s, LONG, 1), F.lit(21)).cast("decimal(22,0)")
        below = -F.least(size, number(low)) if saturate_signed else F.when(size > number(top - 1), number(top - 1)).otherwise(-size)
        long = wrapped(F.when(s.rlike(MINUS), below).otherwise(F.least(size, number(high))))
        return F.coalesce(short.cast(spark), F.when(s.rlike(WHOLE), long).when(s.isNotNull(), 0).cast(spark))

    def literal(text: str) -> object:
        m = re.match(r"[ \t\n\x0b\f\r]*([+-]?)([0-9]+)", text)
        if not m:
            v = 0
        else:
            size, minus = int(m[2]), m[1] == "-"
            if saturate_signed:
                v = -min(size, low) if minus else min(size, high)
            else:
                v = high if size > high else -size if minus else size
        v %= wrap
        if signed and v >= wrap // 2:
            v -= wrap
        return Decimal(v) if spark.startswith("decimal") else v

    return column, literal


def _real_column(s: Column) -> Column:
    found = F.regexp_extract(s, REAL, 1)
    return F.when(s.isNotNull(), F.when(found == "", F.lit(0.0)).otherwise(F.try_cast(found, "double") if hasattr(F, "try_cast") else found.try_cast("double")))


def _real_literal(text: str) -> float:
    m = re.match(r"[ \t\n\x0b\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", text)
    return float(m[1]) if m else 0.0


def _make() -> dict[str, KeyType]:
    out: dict[str, KeyType] = {}

    def whole(name: str, bits: int, signed: bool, spark: str, saturate_signed: bool = False) -> None:
        column, literal = _whole(bits, signed, spark, saturate_signed)
        out[name] = KeyType(name, spark, column, literal, lambda s: F.trim(s).try_cast(spark))

    for bits, spark in ((8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint")):
        whole(f"int{bits}", bits, True, spark)
    whole("uint8", 8, False, "smallint", True)
    whole("uint16", 16, False, "int")
    whole("uint32", 32, False, "bigint")
    whole("uint64", 64, False, "decimal(20,0)")
    whole("date", 32, False, "bigint")
    whole("time", 32, False, "bigint")
    for name in ("double", "float"):
        out[name] = KeyType(name, "double", _real_column, _real_literal, lambda s: F.trim(s).try_cast("double"))
    out["char8"] = KeyType("char8", "string", lambda s: F.left(s, F.lit(8)), lambda t: t[:8], lambda s: F.left(s, F.lit(8)))
    out["string"] = KeyType("string", "string", lambda s: s, lambda t: t, lambda s: s)
    return out


#: Extension point: add a KeyType to make a new type known everywhere.
REGISTRY = _make()


def key_type(name: str) -> KeyType:
    """By name, in any case; unknown names raise."""
    try:
        return REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown key type {name!r}; known: {', '.join(REGISTRY)}") from None


def parse_key(column: Column, name: str, mode: str = "c_prefix") -> Column:
    if mode not in ("c_prefix", "strict"):
        raise ValueError("mode is c_prefix or strict")
    t = key_type(name)
    return t.column(column) if mode == "c_prefix" else t.strict(column)


def date_key(timestamp: Column) -> Column:
    """yyyymmdd of a timestamp, months from 1."""
    return F.date_format(timestamp, "yyyyMMdd").cast("bigint")


def time_key(timestamp: Column, clock: bool = False) -> Column:
    """Seconds since 1970 of a timestamp.  ``clock``: of a timestamp without a zone, read as UTC
    whatever the session's zone is."""
    if clock:
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), timestamp)
        return F.floor(micros / 1_000_000).cast("bigint")
    return F.unix_timestamp(timestamp.cast("timestamp"))


def key_text(column: Column, name: str) -> Column:
    """A key as it is printed: doubles with six significant digits (ties of their shortest decimal
    form go up), in scientific form from 10^6 on and below 10^-4; integers in decimal."""
    if key_type(name).spark != "double":
        return column.cast("string")
    scientific = F.format_string("%.5e", column)
    power = F.regexp_extract(scientific, "e([+-][0-9]+)$", 1).cast("int")
    plain = F.lit(None).cast("string")
    for k in range(-4, 6):
        plain = F.when(power == k, F.format_string(f"%.{5 - k}f", column)).otherwise(plain)
    cut = lambda c: F.regexp_replace(F.when(c.contains("."), F.rtrim(c, F.lit("0"))).otherwise(c), r"\.$", "")
    long = F.concat(cut(F.regexp_extract(scientific, "^([^e]*)e", 1)), F.lit("e"), F.regexp_extract(scientific, "e(.*)$", 1))
    return F.when(column == 0, "0").when(plain.isNotNull(), cut(plain)).otherwise(long)

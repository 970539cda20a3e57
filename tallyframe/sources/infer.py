"""Type inference from a few text values, and typed cells from text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number, a truth value and a missing value.
NUMBER = re.compile(r"(^|^-)((\d+(,\d+)*)|(\d*))\.?\d+$")
TRUTH = re.compile(r"^(t|f|true|false)$", re.IGNORECASE)
MISSING_HEADS = ("NA", "Na")


def determine_type(values: list[str | None], prefer_double: bool = True) -> T.DataType:
    """The narrowest of int, double (float if not ``prefer_double``), boolean and string that fits every known value."""
    known = [v for v in values if v is not None and v.strip() and not v.startswith(MISSING_HEADS)]
    if not known:
        return T.StringType()
    if all(NUMBER.search(v) for v in known):
        if any("." in v for v in known):
            return T.DoubleType() if prefer_double else T.FloatType()
        return T.IntegerType()
    if all(TRUTH.match(v) for v in known):
        return T.BooleanType()
    return T.StringType()


def column_info(sample: list[list[str | None]], header: list[str] | None = None, prefer_double: bool = True) -> T.StructType:
    """A schema from sample rows; columns are named V1..Vn without a header. Short rows count as missing."""
    width = max((len(r) for r in sample), default=len(header or []))
    names = header or [f"V{i + 1}" for i in range(width)]
    cells = [[r[i] if i < len(r) else None for r in sample] for i in range(width)]
    return T.StructType([T.StructField(n, determine_type(c, prefer_double), True) for n, c in zip(names, cells)])


THOUSANDS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"


def without_separators(text: Column) -> Column:
    """``1,234`` as ``1234``; other texts as they are."""
    return F.when(text.rlike(THOUSANDS), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)


def cell(text: Column, kind: T.DataType, use_defaults: bool) -> Column:
    """One typed cell; text that doesn't fit is 0 / false / the epoch with defaults, else null. No trimming."""
    whole, real = text.rlike(r"^[+\-0-9]+$"), text.rlike(r"^[+\-0-9.eE]+$")
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.IntegerType, T.LongType)):
        to = "int" if isinstance(kind, T.IntegerType) else "bigint"
        value = F.when(whole, text.try_cast(to)).when(
            real, F.floor(F.abs(text.try_cast("double"))).try_cast(to) * F.when(text.startswith("-"), -1).otherwise(1),
        ).try_cast(to)
        zero = F.lit(0).cast(to)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        to = "float" if isinstance(kind, T.FloatType) else "double"
        value, zero = F.when(real, text.try_cast(to)), F.lit(0).cast(to)
    elif isinstance(kind, T.BooleanType):
        low = F.lower(text)
        value, zero = F.when(low == "true", True).when(low == "false", False), F.lit(False)
    elif isinstance(kind, T.TimestampType):
        value, zero = text.try_cast("timestamp"), F.timestamp_seconds(F.lit(0))
    else:
        raise ValueError(f"unsupported type {kind.simpleString()}")
    return F.coalesce(value, zero) if use_defaults else value

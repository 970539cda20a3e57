"""Delimited text files: inferred loads, loads into a declared schema, and the saved form of a frame."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.infer import cell, column_info, without_separators

SAMPLE_LINES = 5


def _texts(spark: SparkSession, path: str, width: int, sep: str, null: str | None, empty: str | None, header: bool = False) -> DataFrame:
    """Every cell as text. Lines are records; short ones are padded with nulls, surplus cells are dropped."""
    names = T.StructType([T.StructField(f"_{i}", T.StringType(), True) for i in range(width)])
    reader = spark.read.schema(names).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False,
    ).option("escape", '"').option("header", header)
    if null is not None:
        reader = reader.option("nullValue", null)
    return reader.option("emptyValue", "" if empty is None else empty).csv(path)


def load_file(spark: SparkSession, path: str, sep: str = ",", has_header: bool = False, prefer_double: bool = True) -> DataFrame:
    """A file with types inferred from its first lines; columns V1..Vn; text that doesn't fit its column is null.

    With ``has_header`` the first line of every file names the columns and is no row. Numbers may have their thousands set
    apart by commas (``1,234``). The separator is a literal, trailing empty cells count. Only the sample reaches the driver. An empty file is an error.
    """
    rows = spark.read.text(path).limit(SAMPLE_LINES + has_header).collect()
    if not rows:
        raise ValueError(f"{path} has no line to infer types from")
    lines = [r.value.rstrip("\r") for r in rows]
    # The sample is cut into cells by the rules the reader follows, so that a quoted separator cuts in neither.
    cells = [next(csv.reader([x], delimiter=sep), [""]) if len(sep) == 1 else x.split(sep) for x in lines]
    header = cells.pop(0) if has_header else None
    schema = column_info(cells, header, prefer_double)
    texts = _texts(spark, path, len(schema), sep, None, None, has_header)

    def value(i: int, kind: T.DataType) -> Column:
        text = F.col(f"_{i}")
        return text if isinstance(kind, (T.StringType, T.BooleanType)) else without_separators(text)

    return texts.select(*[cell(value(i, f.dataType), f.dataType, False).alias(f.name) for i, f in enumerate(schema)])


def load_into(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", null: str | None = None,
    empty: str | None = None, use_defaults: bool = True,
) -> DataFrame:
    """A file as ``schema``; cells that don't fit are defaults or null. Only the first character of ``sep`` counts."""
    texts = _texts(spark, path, len(schema), sep[:1], null, empty)
    return texts.select(*[cell(F.col(f"_{i}"), f.dataType, use_defaults).alias(f.name) for i, f in enumerate(schema)])

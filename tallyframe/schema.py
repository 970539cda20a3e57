"""Type names, and factor (categorical) marks kept in column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names accepted by CREATE TABLE and CAST.
TYPES = {
    "varchar": T.StringType(),
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.TimestampType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
}


def type_named(name: str) -> T.DataType:
    try:
        return TYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}") from None


def parse_columns(text: str) -> T.StructType:
    """``"Year int, Name string"`` to a schema."""
    fields = []
    for part in text.split(","):
        words = part.split()
        if len(words) != 2:
            raise ValueError(f"cannot read column {part.strip()!r}")
        fields.append(T.StructField(words[0], type_named(words[1]), True))
    return T.StructType(fields)


def mark(df: DataFrame, column: str, **meta) -> DataFrame:
    """``df`` with ``meta`` merged into the metadata of ``column``."""
    old = df.schema[column].metadata or {}
    return df.withMetadata(column, {**old, **meta})


def set_as_factor(df: DataFrame, column: str | int, levels: list[str] | None = None) -> DataFrame:
    name = df.columns[column] if isinstance(column, int) else column
    return mark(df, name, factor=True, **({"levels": list(levels)} if levels is not None else {}))


def factors(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if (f.metadata or {}).get("factor")]


def string_columns_as_factors(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every STRING and BOOLEAN column (of ``columns``) becomes a factor."""
    for f in df.schema:
        if (columns is None or f.name in columns) and isinstance(f.dataType, (T.StringType, T.BooleanType)):
            df = set_as_factor(df, f.name)
    return df


def copy_marks(source: DataFrame, target: DataFrame) -> DataFrame:
    """Reattach factor marks that an expression dropped, to columns of the same name and type."""
    have = {f.name: f for f in target.schema}
    for f in source.schema:
        t = have.get(f.name)
        if f.metadata and t is not None and t.dataType == f.dataType and not t.metadata:
            target = target.withMetadata(f.name, f.metadata)
    return target


def factor_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Levels and their counts of every factor, one row each; nulls are not a level. One aggregation for all columns."""
    columns = factors(df) if columns is None else columns
    if not columns:
        raise ValueError("no factor column")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns])
    long = df.select(F.explode(pairs).alias("x")).select("x.column_name", "x.level")
    return long.where(F.col("level").isNotNull()).groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n"))

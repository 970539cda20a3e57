"""Column statistics: each one is a single aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.order_stats import exact_quantiles
from tallyframe.schema import factors
from tallyframe.session import numeric

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def need_numeric(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if not numeric(df.schema[c].dataType.simpleString()):
            raise ValueError(f"column {c!r} is not numeric")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if numeric(t)]


def _long(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """One pass over all columns, then one row per column."""
    if not columns:
        raise ValueError("no numeric column")
    row = df.agg(*[f(c).alias(f"{s}__{i}") for i, c in enumerate(columns) for s, f in stats.items()])
    items = [F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("column_name"), *[F.col(f"{s}__{i}").alias(s) for s in stats]) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample stdev and variance, count, nulls, min, max per numeric column."""
    return _long(
        df,
        columns or numeric_columns(df),
        {
            "mean": lambda c: F.avg(c),
            "stdev": lambda c: F.stddev_samp(c),
            "variance": lambda c: F.var_samp(c),
            "n": lambda c: F.count(c),
            "n_null": lambda c: F.count(F.when(F.col(c).isNull(), 1)),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
        },
    )


def simple_summary(df: DataFrame) -> DataFrame:
    """Factors: one row per distinct value. Other numeric columns: one row with min and max (NaN when all null)."""
    fs = factors(df)
    parts = []
    if fs:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in fs])
        long = df.select(F.explode(pairs).alias("x")).select("x.*").where("level is not null").distinct()
        parts.append(long.select("column_name", "level", F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max")))
    cols = [c for c in numeric_columns(df) if c not in fs]
    if cols:
        nan = F.lit(float("nan"))
        long = _long(df, cols, {"min": lambda c: F.coalesce(F.min(F.col(c).cast("double")), nan), "max": lambda c: F.coalesce(F.max(F.col(c).cast("double")), nan)})
        parts.append(long.select("column_name", F.lit(None).cast("string").alias("level"), "min", "max"))
    if not parts:
        raise ValueError("nothing to summarise")
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def five_num(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Min, max, lower quartile, median, upper quartile per named column; exact, or by a mergeable sketch in one pass."""
    columns = columns or numeric_columns(df)
    need_numeric(df, *columns)
    if exact:
        got = exact_quantiles(df, columns, [0.0, 1.0, 0.25, 0.5, 0.75])
        rows = [(i, c, *q) for i, (c, q) in enumerate(zip(columns, got))]
        return df.sparkSession.createDataFrame(rows, "column_no int, column_name string, min double, max double, q1 double, median double, q3 double")
    q = lambda p: lambda c: F.percentile_approx(F.col(c).cast("double"), p, 10000)
    return _long(
        df, columns,
        {"min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double")), "q1": q(0.25), "median": q(0.5), "q3": q(0.75)},
    )


def quantiles(df: DataFrame, column: str, probs: list[float], exact: bool = True) -> DataFrame:
    """One row per probability; floored for whole-number columns."""
    need_numeric(df, column)
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie in [0, 1]")
    whole = isinstance(df.schema[column].dataType, WHOLE)
    if exact:
        got = df.sparkSession.createDataFrame([(exact_quantiles(df, [column], probs)[0],)], "q array<double>")
    else:
        got = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 10000).alias("q"))
    out = got.select(F.posexplode(F.coalesce(F.col("q"), F.array(*[F.lit(None).cast("double")] * len(probs)))).alias("i", "value"))
    value = F.floor("value").cast("double") if whole else F.col("value")
    return out.select(F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("i") + 1).alias("prob"), value.alias("value"))


def mean(df: DataFrame, column: str) -> DataFrame:
    need_numeric(df, column)
    return df.agg(F.avg(column).alias("mean"))


def variance(df: DataFrame, column: str) -> DataFrame:
    """Sample variance and standard deviation; both null for a column that isn't numeric."""
    if not numeric(df.schema[column].dataType.simpleString()):
        null = F.lit(None).cast("double")
        return df.agg(F.max(null).alias("variance"), F.max(null).alias("stdev"))
    return df.agg(F.var_samp(column).alias("variance"), F.stddev_samp(column).alias("stdev"))


def covariance(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sample covariance over rows where both are known."""
    need_numeric(df, x, y)
    return df.agg(F.covar_samp(x, y).alias("covariance"))


def histogram_edges(lo: float, hi: float, bins: int, even: bool = False) -> list[float]:
    """Lower edges. Default rule: bins-1 steps from ``lo``, then ``hi`` itself, so the last bin holds only the maximum.

    ``even=True`` gives ``bins`` equally wide bins, the last one closed.
    """
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    if lo == hi:
        return [lo]
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins)]
    return edges if even else [*edges[:-1], hi] if bins > 1 else [lo]


def histogram(df: DataFrame, column: str, bins: int, even: bool = False) -> DataFrame:
    """(x, y): lower edge and count of every bin, empty ones too. Nulls are skipped; NaN or infinity is an error."""
    need_numeric(df, column)
    v = F.col(column).cast("double")
    got = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    spark = df.sparkSession
    if got.lo is None:
        return spark.createDataFrame([], "x double, y bigint")
    if not (math.isfinite(got.lo) and math.isfinite(got.hi)):
        raise ValueError("a histogram needs finite values")
    edges = histogram_edges(got.lo, got.hi, bins, even)
    arr = F.array(*[F.lit(e) for e in edges])
    at = F.size(F.filter(arr, lambda e: e <= F.col("v")))
    counts = df.select(v.alias("v")).where("v is not null").groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = spark.range(1).select(F.posexplode(arr).alias("i", "x"))
    return all_bins.join(counts, F.col("b") == F.col("i") + 1, "left").select("x", F.coalesce("n", F.lit(0)).cast("long").alias("y"))

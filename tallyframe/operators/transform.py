"""Column transforms, map/reduce with user code, scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.stats import numeric_columns


def transform_expr(df: DataFrame, assignment: str) -> DataFrame:
    """``"new = a / b"`` adds (or replaces) a column by a SQL expression; it stays in generated code."""
    name, eq, body = assignment.partition("=")
    if not eq or not name.strip().isidentifier():
        raise ValueError(f"cannot read assignment {assignment!r}")
    return df.withColumn(name.strip(), F.expr(body.strip()))


def transform_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any pandas function, batch by batch over Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def map_reduce(
    df: DataFrame,
    map_fn: Callable[[pd.DataFrame], pd.DataFrame],
    reduce: str | Callable[[str, pd.Series], object],
    value_type: str = "double",
    combine: bool = True,
) -> DataFrame:
    """Map batches to (key, val), shuffle on key, reduce to rows (key string, val).

    ``reduce`` is ``"sum"``, ``"min"``, ``"max"`` or ``"count"`` (then the JVM combines before and after the shuffle) or
    a function of (key, values). With ``combine`` the function is also applied to each batch before the shuffle; it must
    then be associative, and a hot key sends one row a batch.
    """
    schema = f"key string, val {value_type}"

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kv = map_fn(b)[["key", "val"]]
            kv = kv.assign(key=kv["key"].astype("string"))
            if callable(reduce) and combine and len(kv):
                kv = pd.DataFrame([(k, reduce(k, v)) for k, v in kv.groupby("key")["val"]], columns=["key", "val"])
            yield kv

    pairs = df.mapInPandas(mapped, schema)
    if isinstance(reduce, str):
        if reduce not in ("sum", "min", "max", "count"):
            raise ValueError(f"unknown reduce {reduce!r}")
        return pairs.groupBy("key").agg(getattr(F, reduce)("val").cast("bigint" if reduce == "count" else value_type).alias("val"))

    def reduced(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "val": [reduce(key[0], pdf["val"])]})

    return pairs.groupBy("key").applyInPandas(reduced, schema)


def _scaled(df: DataFrame, columns: list[str] | None, a, b) -> DataFrame:
    """(x - a) / b with a and b from one pass; 0 where b is 0."""
    cols = columns or numeric_columns(df)
    if not cols:
        return df
    got = df.agg(*[f(c).cast("double") for c in cols for f in (a, b)]).first()
    new = {}
    for i, c in enumerate(cols):
        lo, width = got[2 * i], got[2 * i + 1]
        x = F.col(c).cast("double")
        new[c] = F.when(x.isNotNull(), F.lit(0.0)) if not width else (x - F.lit(lo)) / F.lit(width)
    return df.withColumns(new)


def scale_minmax(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _scaled(df, columns, F.min, lambda c: F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")))


def scale_standard(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _scaled(df, columns, F.avg, F.stddev_samp)

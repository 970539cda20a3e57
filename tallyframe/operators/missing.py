"""Dropping and filling missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.aggregate import FUNCTIONS
from tallyframe.session import numeric


def drop_na(df: DataFrame, by: str = "row", how: str = "any", thresh: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Drop rows (or columns) with any null, only nulls, or fewer than ``thresh`` known values.

    ``columns`` restricts which columns are looked at; rows keep all their columns. Column mode counts nulls of every
    column in one pass and keeps schema order.
    """
    cols = columns or df.columns
    if how.lower() not in ("any", "all"):
        raise ValueError(f"how must be any or all, not {how!r}")
    if by.lower() == "row":
        if thresh > len(cols):
            raise ValueError("thresh is larger than the number of columns")
        return df.dropna(how=how.lower(), thresh=thresh or None, subset=cols)
    if by.lower() != "column":
        raise ValueError(f"by must be row or column, not {by!r}")
    got = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in cols]).first()
    total, known = got[0], dict(zip(cols, got[1:]))
    if thresh > total:
        raise ValueError("thresh is larger than the number of rows")
    least = thresh if thresh else total if how.lower() == "any" else 1
    return df.select(*[c for c in df.columns if c in known and known[c] >= least])


def fill_na(
    df: DataFrame, value: str | float | None = None, method: str | None = None, fn: str | None = None,
    values: dict | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """Fill nulls by one value, else by a value per column, else by an aggregate of the column (numeric ones only).

    A value that can't be read as a column's type leaves that column as it was. Columns outside ``columns`` are kept.
    """
    if method:
        raise NotImplementedError("forward and backward fill are not supported")
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    if value is not None or values is not None:
        new = {}
        for c in cols:
            v = value if value is not None else values.get(c)
            if v is not None:
                new[c] = F.coalesce(F.col(f"`{c}`"), F.lit(str(v)).try_cast(kinds[c]))
        return df.withColumns(new) if new else df
    if fn is None:
        raise ValueError("fill_na needs a value, values or fn")
    if fn.lower() not in FUNCTIONS:
        raise ValueError(f"unsupported aggregate function {fn!r}")
    cols = [c for c in cols if numeric(kinds[c])]
    if not cols:
        return df
    got = df.agg(*[FUNCTIONS[fn.lower()](F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(got[i]).cast(kinds[c])) for i, c in enumerate(cols)})

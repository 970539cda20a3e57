"""Projections, views, joins and unions as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import copy_marks

# Join names of the dialect and the Spark join each stands for.
JOINS = {
    "": "inner",
    "inner": "inner",
    "left": "left_outer",
    "left outer": "left_outer",
    "right": "right_outer",
    "right outer": "right_outer",
    "full": "full_outer",
    "full outer": "full_outer",
    "left semi": "left_semi",
}


def project(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    return df.select(*columns)


def remove_columns(df: DataFrame, *columns: str) -> DataFrame:
    project(df, *columns)
    return df.drop(*columns)


def top(df: DataFrame, n: int, column: str, order: str = "desc", ties: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``column``; nulls last either way. Planned as TakeOrderedAndProject, never a full sort."""
    if order.lower() not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {order!r}")
    key = F.col(column).asc_nulls_last() if order.lower() == "asc" else F.col(column).desc_nulls_last()
    return df.orderBy(key, *[F.col(c).asc_nulls_last() for c in ties or []]).limit(n)


def subset(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """Rows that meet ``where`` (over all columns of ``df``), then the chosen columns."""
    if where and ("grep(" in where.lower() or "grep_ic(" in where.lower()):
        raise NotImplementedError("grep is not supported in a subset filter")
    return copy_marks(df, (df.where(where) if where else df).select(*columns))


def join(
    left: DataFrame,
    right: DataFrame,
    how: str | None = None,
    by: list[str] | None = None,
    by_left: list[str] | None = None,
    by_right: list[str] | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """Equi-join; output is the left columns, then the right ones, a right name already taken getting ``suffix``.

    ``by`` wins over ``by_left``/``by_right``. Null keys match nothing. Strategy (broadcast, shuffled hash, sort-merge,
    skew split) is left to Catalyst and AQE, which know the sizes.
    """
    kind = JOINS.get(" ".join((how or "").lower().replace("_", " ").split()))
    if kind is None:
        raise ValueError(f"unknown join type {how!r}")
    lk, rk = (by, by) if by else (by_left, by_right)
    if not lk or not rk or len(lk) != len(rk):
        raise ValueError("a join needs as many left as right key columns")
    project(left, *lk), project(right, *rk)
    taken = {c.lower() for c in left.columns}
    names: dict[str, str] = {}
    for c in right.columns:
        new = c
        while new.lower() in taken:
            new += suffix
        taken.add(new.lower())
        names[c] = new
    r = right.select(*[F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(right.columns)])
    at = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    cond = None
    for a, b in zip(lk, rk):
        e = left[a] == r[at[b]]
        cond = e if cond is None else cond & e
    out = left.join(r, cond, kind)
    if kind == "left_semi":
        return out
    return out.select(*[left[c] for c in left.columns], *[r[at[c]].alias(names[c]) for c in right.columns])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL of two frames with the same columns in the same order."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError("merge needs the same columns with the same types")
    return a.union(b)


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def rows_text(df: DataFrame, name: str = "row_text") -> DataFrame:
    """Each row as one tab-joined text; null is empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias(name))

"""Grouped aggregation. The frame API first drops rows with a null in any column it refers to (listwise deletion)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregate names of the frame API.
FUNCTIONS = {"mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}

_CALL = re.compile(r"^\s*(?:(?P<name>\w+)\s*=\s*)?(?P<fn>\w+)\s*\(\s*(?P<col>\w+)\s*\)\s*$")


def parse_aggregate(text: str) -> tuple[str, str, str]:
    """``"name=fn(col)"`` or ``"fn(col)"`` to (name, fn, col); the default name is ``FN_col``."""
    m = _CALL.match(text)
    if not m:
        raise ValueError(f"cannot read aggregate {text!r}")
    fn = m["fn"].lower()
    if fn not in FUNCTIONS:
        raise ValueError(f"unsupported aggregate function {m['fn']!r}")
    return m["name"] or f"{fn.upper()}_{m['col']}", fn, m["col"]


def call(fn: str, column: str, whole_averages: bool = False) -> Column:
    """One aggregate as double; ``whole_averages`` floors an average (the behaviour of engines that average in integers)."""
    if fn.lower() not in FUNCTIONS:
        raise ValueError(f"unsupported aggregate function {fn!r}")
    out = FUNCTIONS[fn.lower()](F.col(column)).cast("double")
    return F.floor(out).cast("double") if whole_averages and fn.lower() in ("avg", "mean") else out


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Prune to ``columns`` and drop rows with a null in any of them."""
    keep = list(dict.fromkeys(columns))
    return df.select(*keep).dropna(subset=keep)


def group_by(df: DataFrame, groups: list[str], aggregates: list[str], whole_averages: bool = False) -> DataFrame:
    """Aggregates (as doubles), then the group columns. Partial aggregation runs map-side, so a hot key costs one row a task."""
    if not groups:
        raise ValueError("group_by needs at least one group column")
    parsed = [parse_aggregate(a) for a in aggregates]
    rows = clean(df, groups + [c for _, _, c in parsed])
    out = rows.groupBy(*groups).agg(*[call(fn, c, whole_averages).alias(n) for n, fn, c in parsed])
    return out.select(*[n for n, _, _ in parsed], *groups)


class Grouped:
    """The two-step form: ``Grouped(df, groups).agg([...])``."""

    def __init__(self, df: DataFrame, groups: list[str] | None):
        self.df, self.groups = df, groups

    def agg(self, aggregates: list[str]) -> DataFrame:
        if not self.groups:
            raise ValueError("agg needs a preceding group_by")
        return group_by(self.df, self.groups, aggregates)


def aggregate(df: DataFrame, spec: str) -> DataFrame:
    """``"g1, g2, sum(c), avg(d)"``: plain fields are the group keys. Keys first, then the aggregates as doubles."""
    fields = [f.strip() for f in spec.split(",") if f.strip()]
    groups = [f for f in fields if "(" not in f]
    calls = [parse_aggregate(f) for f in fields if "(" in f]
    if not calls:
        raise ValueError("aggregate needs at least one function")
    rows = clean(df, groups + [c for _, _, c in calls])
    cols = [call(fn, c).alias(n) for n, fn, c in calls]
    return rows.groupBy(*groups).agg(*cols) if groups else rows.agg(*cols)


def aggregate_map(df: DataFrame, spec: str) -> dict[str, list[float]]:
    """``aggregate`` as a driver-side map from the comma-joined key to its values: for small results only."""
    fields = [f.strip() for f in spec.split(",") if f.strip()]
    k = sum("(" not in f for f in fields)
    return {",".join(str(v) for v in r[:k]): [float(v) for v in r[k:]] for r in aggregate(df, spec).collect()}


def aggregate_on_column(df: DataFrame, fn: str, column: str) -> DataFrame:
    return clean(df, [column]).agg(call(fn, column).alias(f"{fn.upper()}_{column}"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r over rows where both are known."""
    return clean(df, [x, y]).agg(F.corr(x, y).alias("correlation"))

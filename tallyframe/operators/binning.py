"""Cut a numeric column into labelled intervals; one scan after the breaks are known."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.order_stats import exact_quantiles
from tallyframe.operators.stats import need_numeric
from tallyframe.schema import set_as_factor


def bound_text(x: float) -> str:
    """A bound with at most two decimals and no trailing zeros."""
    d = Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    text = format(d, "f").rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def labels(breaks: list[float], include_lowest: bool, right: bool) -> list[str]:
    """Interval names: closed on the right if ``right``, else on the left if ``include_lowest``, else open on both sides."""
    out = []
    for i, (a, b) in enumerate(zip(breaks, breaks[1:])):
        closed_left = include_lowest and (not right or i == 0)
        out.append(f"{'[' if closed_left else '('}{bound_text(a)},{bound_text(b)}{']' if right else ')'}")
    return out


def breaks_for(df: DataFrame, column: str, kind: str, bins: int | None, breaks: list[float] | None, exact: bool = True) -> list[float]:
    kind = kind.upper()
    if kind == "CUSTOM":
        if not breaks or len(breaks) < 2 or sorted(breaks) != list(breaks):
            raise ValueError("custom binning needs sorted breaks")
        return [float(b) for b in breaks]
    if bins is None or bins < 2:
        raise ValueError("binning needs at least 2 bins")
    v = F.col(column).cast("double")
    if kind == "EQUALINTERVAL":
        got = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        if got.lo is None:
            return []
        step = (got.hi - got.lo) / bins
        return [got.lo + i * step for i in range(bins)] + [got.hi]
    if kind == "EQUALFREQ":
        probs = [i / bins for i in range(bins + 1)]
        got = exact_quantiles(df, [column], probs)[0] if exact else df.agg(F.percentile_approx(v, probs, 10000).alias("q")).first().q
        return sorted(set(got)) if got and got[0] is not None else []
    raise ValueError(f"unknown binning type {kind!r}")


def binning(
    df: DataFrame, column: str, kind: str, bins: int | None = None, breaks: list[float] | None = None,
    include_lowest: bool = True, right: bool = True, exact: bool = True,
) -> DataFrame:
    """Replace ``column`` by its interval label and drop rows outside the breaks; the result is a factor.

    Boundary modes: the lowest bound is kept if ``include_lowest``, the highest if ``right``; with both off, values
    equal to an inner break are dropped too. A value on an inner break falls left of it if ``right``, else right of it.
    Fewer than two distinct breaks (constant or empty column): all rows at the one value share the label ``[v,v]``.
    """
    need_numeric(df, column)
    b = breaks_for(df, column, kind, bins, breaks, exact)
    v = F.col(column).cast("double")
    if len(b) < 2 or b[0] == b[-1]:
        name = f"[{bound_text(b[0])},{bound_text(b[0])}]" if b else None
        out = df.where(v == b[0]) if b else df.where(F.lit(False))
        return set_as_factor(out.withColumn(column, F.lit(name)), column, [name] if name else [])
    names = labels(b, include_lowest, right)
    label = None
    for i, (lo, hi) in enumerate(zip(b, b[1:])):
        if right:
            inside = ((v > lo) | ((v == lo) & F.lit(include_lowest and i == 0))) & (v <= hi)
        elif include_lowest:
            inside = (v >= lo) & (v < hi)
        else:
            inside = (v > lo) & (v < hi)
        label = F.when(inside, names[i]) if label is None else label.when(inside, names[i])
    out = df.withColumn(column, label).where(F.col(column).isNotNull())
    return set_as_factor(out, column, names)

"""Samples and cross-validation splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import copy_marks


def _key(df: DataFrame, seed: int):
    """A hash of the whole row and the seed: a row's fold doesn't depend on partitioning or on a retry."""
    cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.xxhash64(F.lit(seed), *[F.coalesce(c, F.lit("\0")) for c in cols])


def _uniform(df: DataFrame, seed: int, *more):
    return (F.pmod(F.xxhash64(_key(df, seed), *more), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))


def _repeated(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """Every row a Poisson number of times, ``rate`` on average; ``__copy`` numbers the copies."""
    if rate > 10_000:
        raise ValueError("a row would be drawn over 10,000 times on average")
    below: list[float] = []
    for k in range(int(rate + 12 * rate**0.5 + 20)):
        p = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        below.append((below[-1] if below else 0.0) + p)
    u = _uniform(df, seed)
    times = F.size(F.filter(F.array(*[F.lit(b) for b in below]), lambda b: b <= u))
    return df.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))


def sample_rows(df: DataFrame, n: int, replace: bool = False, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all of them, if there are fewer and ``replace`` is off), the same ones however ``df`` is partitioned.

    The plan is a top-n by a hash of row and seed, so no partition is gathered; equal rows have equal hashes and come or stay
    away together, as far as ``n`` allows. With replacement, rows are first repeated a Poisson number of times so that somewhat
    more than ``n`` are to be expected, and more often where that falls short.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if not replace:
        return df.orderBy(_key(df, seed)).limit(n)
    total = df.count()
    if not total or not n:
        return df.limit(0)
    rate = (n + 6 * n**0.5 + 20) / total
    for i in range(60):
        drawn = _repeated(df, rate * 1.5**i, seed)
        if drawn.limit(n).count() == n:
            return drawn.orderBy(F.xxhash64(_key(df, seed + 1), "__copy")).limit(n).drop("__copy")
    raise RuntimeError("equal rows are too many to draw from")


def sample_fraction(df: DataFrame, fraction: float, replace: bool = False, seed: int = 0) -> DataFrame:
    """Each row with the chance ``fraction`` by a hash of row and seed, or, with ``replace``, that many times on average."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies in [0, 1]")
    out = _repeated(df, float(fraction), seed).drop("__copy") if replace else df.where(_uniform(df, seed) < fraction)
    return copy_marks(df, out)


def fold_ids(df: DataFrame, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    if k < 2:
        raise ValueError("k must be at least 2")
    return df.withColumn(name, F.pmod(_key(df, seed), F.lit(k)).cast("int"))


def cv_kfold(df: DataFrame, k: int, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """k (train, test) pairs; the test sets are disjoint and cover all rows. Equal rows share a fold."""
    f = F.pmod(_key(df, seed), F.lit(k))
    if k < 2:
        raise ValueError("k must be at least 2")
    return [(df.where(f != i), df.where(f == i)) for i in range(k)]


def cv_random(df: DataFrame, k: int, training: float, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """k random (train, test) splits, the train part being about ``training`` of the rows."""
    if not 0 < training < 1:
        raise ValueError("the training size lies between 0 and 1")
    cut = int(training * 1_000_000)
    out = []
    for i in range(k):
        u = F.pmod(_key(df, seed * 1_000_003 + i), F.lit(1_000_000))
        out.append((df.where(u < cut), df.where(u >= cut)))
    return out

"""Missing numeric and categorical cells filled by chained equations, every filled cell marked.

Each incomplete field is modelled from the others in turn, several times over: numeric fields by linear regression with an
intercept per category (shrunk to the mean), the categorical field by its distribution among rows that share the most
specific evidence key, weighted by how likely the row's current value of a numeric field is in each category; a row without
any evidence takes the category of one of ``DONORS`` rows picked by hash from all usable ones. Residual variation is kept: a
filled number is the prediction plus a residual drawn from the quantiles of the residuals that the regression itself was
fitted to (rows beyond its outlier cut have wrong predictors, not wider residuals), a filled category is drawn from its
distribution, by a hash of the row, so a retried task draws the same.

Distribution. A row whose fields are all usable contributes the same sums in every round, so the table is scanned a fixed
number of times (sums, residual quantiles, sums without outliers) whatever the number of rounds; only rows with an unusable
field are written apart, and of them only the columns that the models read (``inputs``) are iterated over; the others are
joined to the result once. Regressions need sums of products per category, aggregated map-side; the driver solves one small
system per field and round and never sees rows. The result is the complete rows, read as they are, united with the filled
ones, so the table itself is never shuffled.

Defined results: cells that aren't to be filled keep what they hold, even if it isn't usable; a field without any usable
value is filled with 0, a category without any with null; rows equal in all columns get equal fills; an empty table stays
empty. Output names of marks (``<field>_filled``) must be free.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import discard, written

Features = Callable[[dict[str, Column]], list[Column]]
PERCENTS = [i / 100 for i in range(101)]
DONORS = 4096


@dataclass
class NumericField:
    """``usable``: the value may be learnt from. ``fill``: the cell is to be filled. ``features``: predictors from the
    working values of all fields (by name) and the columns named in ``inputs`` (default: all columns); they must not be null.
    ``start``: first guess. Every field has its own number of predictors."""

    name: str
    usable: Column
    fill: Column
    features: Features
    start: Column
    low: float
    high: float
    inputs: list[str] | None = None


@dataclass
class CategoryField:
    """``value``: the usable category or null. ``evidence``: names of ``keys`` from the most to the least specific set.
    ``weigh``: a numeric field and its bucket edges, whose frequency in each category weighs the candidates."""

    name: str
    value: Column
    fill: Column
    keys: dict[str, Column]
    evidence: list[list[str]]
    weigh: str
    edges: list[float] = field(default_factory=list)


def _bucket(v: Column, edges: list[float]) -> Column:
    return sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))


def design(rows: DataFrame, fields: list[NumericField], work: dict[str, Column], category: Column, *keep: str) -> DataFrame:
    """Per field k the target ``y{k}`` and predictors ``x{k}_{i}`` as doubles, computed once per row."""
    cols = [category.alias("category"), *[F.col(c) for c in keep]]
    for k, f in enumerate(fields):
        cols.append(work[f.name].cast("double").alias(f"y{k}"))
        cols += [c.cast("double").alias(f"x{k}_{i}") for i, c in enumerate(f.features(work))]
    return rows.select(*cols)


def gram(designed: DataFrame, sizes: list[int], weights: list[Column] | None = None) -> DataFrame:
    """Per category and field the sums that a regression needs, all in one pass; ``weights`` are 1 for rows that count."""
    shown = ["category"]
    made: list[Column] = []
    for k, d in enumerate(sizes):
        w = weights[k].cast("double") if weights else F.lit(1.0)
        made += [w.alias(f"w{k}"), (w * F.col(f"y{k}")).alias(f"v{k}"), *[(w * F.col(f"x{k}_{i}")).alias(f"u{k}_{i}") for i in range(d)]]
        shown += [f"x{k}_{i}" for i in range(d)]
    sums: list[Column] = []
    for k, d in enumerate(sizes):
        sums += [F.sum(f"w{k}").alias(f"n{k}"), F.sum(f"v{k}").alias(f"sy{k}")]
        for i in range(d):
            sums += [F.sum(f"u{k}_{i}").alias(f"sx{k}_{i}"), F.sum(F.col(f"x{k}_{i}") * F.col(f"v{k}")).alias(f"sxy{k}_{i}")]
            sums += [F.sum(F.col(f"u{k}_{i}") * F.col(f"x{k}_{j}")).alias(f"sxx{k}_{i}_{j}") for j in range(i, d)]
    return designed.select(*shown, *made).groupBy("category").agg(*sums)


def solve(sums: DataFrame, sizes: list[int], shrink: float = 20.0) -> list[tuple[np.ndarray, float, Column]]:
    """Of every field: slopes within categories, the overall intercept, and a category's intercept as an expression over ``sums``."""
    made: list[Column] = []
    for k, d in enumerate(sizes):
        n, y, x = F.nullif(F.col(f"n{k}"), F.lit(0.0)), F.col(f"sy{k}"), [F.col(f"sx{k}_{i}") for i in range(d)]
        made += [F.sum(n).alias(f"n{k}"), F.sum(F.when(n > 0, y)).alias(f"y{k}")]
        for i in range(d):
            made += [F.sum(F.when(n > 0, x[i])).alias(f"x{k}_{i}"), F.sum(F.col(f"sxy{k}_{i}") - x[i] * y / n).alias(f"xy{k}_{i}")]
            made += [F.sum(F.col(f"sxx{k}_{i}_{j}") - x[i] * x[j] / n).alias(f"xx{k}_{i}_{j}") for j in range(i, d)]
    r = sums.agg(*made).first()
    out = []
    for k, d in enumerate(sizes):
        if not r[f"n{k}"]:
            out.append((np.zeros(d), 0.0, F.lit(0.0)))
            continue
        xx = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                xx[i, j] = xx[j, i] = r[f"xx{k}_{i}_{j}"]
        xy = np.array([r[f"xy{k}_{i}"] for i in range(d)])
        scale = np.maximum(np.sqrt(np.maximum(np.diag(xx), 0)), 1e-9)
        slopes = np.linalg.solve(xx / np.outer(scale, scale) + 1e-6 * np.eye(d), xy / scale) / scale
        slopes[np.diag(xx) < 1e-9] = 0.0
        overall = float((r[f"y{k}"] - sum(slopes[i] * r[f"x{k}_{i}"] for i in range(d))) / r[f"n{k}"])
        level = (F.col(f"sy{k}") - _line([F.col(f"sx{k}_{i}") for i in range(d)], slopes) + shrink * overall) / (F.col(f"n{k}") + shrink)
        out.append((slopes, overall, level))
    return out


def _line(x: list[Column], slopes: np.ndarray) -> Column:
    return sum((F.lit(float(b)) * c for b, c in zip(slopes, x)), F.lit(0.0))


def _uniform(seed: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _draw(candidates: Column, bucket: Column, u: Column) -> Column:
    """A category drawn from candidates (value, n, odds per bucket)."""
    weight = lambda c: c["n"] * F.element_at(c["odds"], bucket + 1)
    total = F.aggregate(candidates, F.lit(0.0), lambda a, c: a + weight(c))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("string").alias("value"))

    def step(a: Column, c: Column) -> Column:
        cum = a["cum"] + weight(c)
        return F.struct(cum.alias("cum"), F.when(a["value"].isNull() & (cum > u * total), c["value"]).otherwise(a["value"]).alias("value"))

    return F.aggregate(candidates, start, step)["value"]


def _candidates(counted: DataFrame, donors: DataFrame, slots: Column, todo: DataFrame, cat: CategoryField) -> DataFrame:
    """``todo`` (row, seed and keys) with the candidates of the most specific evidence that other rows share, or else a donor's.

    ``counted`` holds (keys, category, odds, n). A list has at most one entry per category, and is sorted so that a draw
    doesn't depend on the order of arrival. ``donors`` has at most ``DONORS`` rows.
    """
    out = todo
    entry = F.struct(F.col("category").alias("value"), F.col("n").cast("double").alias("n"), "odds")
    for level, keys in enumerate(cat.evidence):
        source = counted.where(F.lit(True))
        for c in keys:
            source = source.where(F.col(c).isNotNull())
        own = source.groupBy(*keys, "category").agg(F.sum("n").alias("n"), F.first("odds").alias("odds"))
        own = own.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias(f"__c{level}"))
        out = out.join(own, keys, "left")
    last = donors.select(F.col("slot").alias("__slot"), F.array(entry).alias("__donor"))
    out = out.withColumn("__slot", F.pmod("__seed", slots)).join(F.broadcast(last), "__slot", "left")
    return out.select("__row", F.coalesce(*[f"__c{i}" for i in range(len(cat.evidence))], "__donor").alias("__candidates"))


def impute(df: DataFrame, numbers: list[NumericField], cat: CategoryField, rounds: int = 3) -> DataFrame:
    """``df`` with the fields filled and a boolean ``<field>_filled`` each."""
    names = [f.name for f in numbers] + [cat.name]
    marks = {n: f"{n}_filled" for n in names}
    clash = [m for m in marks.values() if m.lower() in {c.lower() for c in df.columns}]
    if set(cat.keys) & {"category", "bucket", "n", "odds"}:
        raise ValueError("evidence keys can't be named category, bucket, n or odds")
    if clash:
        raise ValueError(f"rename columns {clash} first")
    sizes = [len(f.features({g.name: F.col(f"`{g.name}`") for g in numbers})) for f in numbers]
    no = F.lit(False)
    good = {f.name: F.coalesce(f.usable, no) for f in numbers}
    complete = cat.value.isNotNull()
    for g in good.values():
        complete = complete & g
    raw = {f.name: F.col(f.name) for f in numbers}

    # Complete rows: three scans, whatever the number of rounds.
    count = len(numbers)
    rows = design(df.where(complete), numbers, raw, cat.value)
    first = written(gram(rows, sizes), "sums")
    fits = solve(first, sizes)
    # One row per category, which Spark broadcasts while that is small.
    levelled = rows.join(first.select("category", *[fits[k][2].alias(f"__a{k}") for k in range(count)]), "category")

    def off(k: int) -> Column:
        return F.col(f"y{k}") - _line([F.col(f"x{k}_{i}") for i in range(sizes[k])], fits[k][0]) - F.lit(fits[k][1])

    net = [off(k) + F.lit(fits[k][1]) - F.col(f"__a{k}") for k in range(count)]
    q = levelled.agg(*[F.percentile_approx(c, PERCENTS, 2000) for k in range(count) for c in (off(k), net[k])]).first()
    quantiles = [list(v) if v else [0.0] * len(PERCENTS) for v in q]
    discard(first)

    def spread_of(v: list[float]) -> float:
        return max(3 * (v[84] - v[16]) / 2, 5.0)

    middles, cuts = [v[50] for v in quantiles[::2]], [spread_of(v) for v in quantiles[::2]]
    # Residuals within a category, of the rows that the regressions keep, are what is drawn from.
    drawn_from = [[x - v[50] for x in v if abs(x - v[50]) <= spread_of(v)] for v in quantiles[1::2]]
    near = [F.abs(off(k) - F.lit(float(middles[k]))) <= cuts[k] for k in range(count)]
    fixed = written(gram(rows, sizes, near), "sums")

    # Rows with an unusable field: all columns once, the models' columns every round.
    wide = written(df.where(~complete).withColumn("__k", F.monotonically_increasing_id()), "incomplete")
    seed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    work = {f.name: F.col(f"__w_{f.name}") for f in numbers}
    inputs = sorted({c for f in numbers for c in (df.columns if f.inputs is None else f.inputs)})
    state = wide.select(
        "__k", seed.alias("__seed"), cat.value.alias("__known"), *[F.col(f"`{c}`") for c in inputs],
        *[F.when(good[f.name], F.col(f"`{f.name}`")).otherwise(f.start).cast("double").alias(f"__w_{f.name}") for f in numbers],
        *[good[f.name].alias(f"__good{k}") for k, f in enumerate(numbers)],
    )

    weigh = next(f for f in numbers if f.name == cat.weigh)
    size = len(cat.edges) + 1
    seen = df.where(cat.value.isNotNull()).select(
        cat.value.alias("category"), F.when(good[weigh.name], _bucket(F.col(f"`{weigh.name}`"), cat.edges)).alias("bucket"),
        *[c.alias(n) for n, c in cat.keys.items()],
    )
    counted = written(seen.groupBy("category", "bucket", *cat.keys).agg(F.count(F.lit(1)).alias("n")), "evidence")
    known = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0))
    share = [(F.sum(F.when(F.col("bucket") == i, F.col("n")).otherwise(0)) + 1.0) / (known + float(size)) for i in range(size)]
    odds = counted.groupBy("category").agg(F.array(*share).alias("odds"))
    with_odds = counted.join(odds, "category")
    # One usable row per slot, the one of least hash: every row has the same chance, a category that of its share. A table of
    # few rows has fewer slots; one that stays empty repeats its neighbour. At most DONORS rows reach the driver.
    usable = counted.agg(F.sum("n")).first()[0] or 0
    slots = F.lit(max(1, min(DONORS, usable // 2)))
    picked = df.where(cat.value.isNotNull()).select(seed.alias("h"), cat.value.alias("category")).groupBy(F.pmod("h", slots).alias("slot")).agg(
        F.min_by("category", F.xxhash64("h", F.lit(7))).alias("category"),
    )
    by_slot = sorted((r.slot, r.category) for r in picked.collect())
    full = [(i, by_slot[k - 1][1]) for i in range(max(1, min(DONORS, usable // 2))) if (k := bisect_right(by_slot, i, key=lambda r: r[0])) or by_slot]
    donors = df.sparkSession.createDataFrame(full, f"slot bigint, category {picked.schema['category'].dataType.simpleString()}").join(odds, "category").withColumn("n", F.lit(1))
    todo = wide.where(cat.value.isNull()).select(F.col("__k").alias("__row"), seed.alias("__seed"), *[c.alias(n) for n, c in cat.keys.items()])
    found = _candidates(with_odds, donors, slots, todo, cat)
    state = written(state.join(found, F.col("__k") == F.col("__row"), "left").drop("__row"), "state")
    discard(counted)
    for _ in range(rounds):
        drawn = _draw(F.col("__candidates"), _bucket(work[weigh.name], cat.edges), _uniform(F.col("__seed"), 1))
        before = state
        state = state.withColumn("__category", F.coalesce(F.col("__known"), drawn))
        rows = design(state, numbers, work, F.col("__category"), *[f"__good{k}" for k in range(count)])
        use = [F.col(f"__good{k}") & (F.abs(off(k) - F.lit(float(middles[k]))) <= cuts[k]) for k in range(count)]
        both = fixed.unionByName(gram(rows, sizes, use))
        both = written(both.groupBy("category").agg(*[F.sum(c).alias(c) for c in both.columns if c != "category"]), "sums")
        fits = solve(both, sizes)
        levels = both.select(F.col("category").alias("__cat"), *[fits[k][2].alias(f"__a{k}") for k in range(count)])
        new = {}
        for k, f in enumerate(numbers):
            values = drawn_from[k]
            at = F.floor(_uniform(F.col("__seed"), 2 + k) * len(values)).cast("int") + 1
            noise = F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)
            guess = F.coalesce(F.col(f"__a{k}"), F.lit(fits[k][1])) + _line([c.cast("double") for c in f.features(work)], fits[k][0]) + noise
            new[f"__w_{f.name}"] = F.when(F.col(f"__good{k}"), work[f.name]).otherwise(F.round(F.greatest(F.lit(f.low), F.least(F.lit(f.high), guess))))
        state = written(
            state.join(levels, F.col("__category") == F.col("__cat"), "left").drop("__cat").withColumns(new).drop(*[f"__a{k}" for k in range(count)]),
            "state",
        )
        discard(before, both)
    discard(fixed)

    kinds = {f.name: f.dataType for f in df.schema}
    filled, plain = {}, {}
    for f in numbers:
        fill = F.coalesce(f.fill, no) & ~good[f.name]
        filled[f.name] = F.when(fill, work[f.name].cast(kinds[f.name])).otherwise(F.col(f"`{f.name}`"))
        filled[marks[f.name]], plain[marks[f.name]] = fill, no
    fill = F.coalesce(cat.fill, no) & cat.value.isNull()
    filled[cat.name] = F.when(fill, F.col("__category")).otherwise(F.col(f"`{cat.name}`"))
    filled[marks[cat.name]], plain[marks[cat.name]] = fill, no
    order = [*[f"`{c}`" for c in df.columns], *marks.values()]
    # All marks are made from the original cells, in one projection; the fills are joined by row.
    done = wide.join(state.select("__k", "__category", *[f"__w_{f.name}" for f in numbers]), "__k")
    new = done.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], *[filled[m].alias(m) for m in marks.values()])
    return df.where(complete).withColumns(plain).select(*order).unionByName(new)

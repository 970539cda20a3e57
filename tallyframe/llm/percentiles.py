"""Percentiles per group over any number of values, from parts that can be put together later.

A *part* (of a load, a day) is a table of runs: group, column, value, count. Parts add up by summing counts, so results of
any union of parts are those of the whole. Runs are exact by default (error bound 0); with ``relative_error`` values are
rounded to logarithmic buckets first, which bounds the size of a part and the error of every percentile alike.

Selection is a distributed multi-select for every group. A group's runs lie in shards of about ``shard_runs`` runs by hash of
the value, so no task holds more than shards of a group, whatever its share of all rows; a shard is one row with its sorted
values and cumulated counts. In a round every shard proposes the weighted median of what is left of it for each rank, the
weighted median of the proposals becomes the pivot, values are counted three ways against it (by bisection of the shard),
the ranges ruled out are dropped, and so on for all groups and ranks at once until every rank is found. A round moves one
row per task, group and rank. A group of one shard takes the very same rounds within the task that holds the shard, its
own median being that of all proposals; groups of several shards exchange proposals. Groups that are done leave the rounds.

Defined results: null values are skipped, NaN too; a null group is a group; a group without values has no row; the
percentile at q is the smallest value that at least q of the group's values don't exceed, q being taken exactly as its
decimal text says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import discard, written


def percentile_parts(df: DataFrame, groups: list[str], values: list[str], part: str | None = None, relative_error: float | None = None) -> DataFrame:
    """Runs: [part,] groups, column_name, value (double), n."""
    cells = F.array(*[F.struct(F.lit(v).alias("column_name"), F.col(f"`{v}`").cast("double").alias("value")) for v in values])
    keys = [*([part] if part else []), *groups]
    long = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(cells).alias("x")).select(*[F.col(f"`{k}`") for k in keys], "x.*")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    if relative_error is not None:
        if not 0 < relative_error < 1:
            raise ValueError("the relative error lies between 0 and 1")
        gamma = (1 + relative_error) / (1 - relative_error)
        step = F.ceil(F.log(F.abs("value")) / math.log(gamma))
        long = long.withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.signum("value") * 2 * F.pow(F.lit(gamma), step) / (gamma + 1)))
    return long.groupBy(*keys, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_parts(parts: DataFrame, groups: list[str], *more: DataFrame) -> DataFrame:
    """One table of runs from several parts."""
    for m in more:
        parts = parts.unionByName(m, allowMissingColumns=True)
    return parts.groupBy(*groups, "column_name", "value").agg(F.sum("n").alias("n"))


def roll_up(runs: DataFrame, groups: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """Runs of several groupings at once: column ``grouping`` names the set, columns outside it are null."""
    kinds = {f.name: f.dataType for f in runs.schema}
    items = [F.struct(F.lit(name).alias("grouping"), *[(F.col(g) if g in cols else F.lit(None).cast(kinds[g])).alias(g) for g in groups]) for name, cols in sets.items()]
    long = runs.select(F.explode(F.array(*items)).alias("x"), "column_name", "value", "n")
    return long.groupBy("x.grouping", *[f"x.{g}" for g in groups], "column_name", "value").agg(F.sum("n").alias("n"))


def _ratio(percent: float) -> tuple[int, int]:
    """A percent as an exact fraction of 1."""
    f = Fraction(str(percent)) / 100
    if not 0 <= f <= 1:
        raise ValueError("percents lie in [0, 100]")
    if f.denominator > 10**8:
        raise ValueError("a percent has at most six decimals")
    return f.numerator, f.denominator


def rank_of(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The 1-based rank of a percentile: ceil(total * num / den), at least 1, without overflow."""
    whole, rest = np.divmod(total, den)
    return np.maximum(1, whole * num + -(-rest * num // den))


def shards_of(runs: DataFrame, keys: list[str], shard_runs: int) -> tuple[DataFrame, DataFrame]:
    """keys, total, shards (in the group), shard, value (sorted array), upto (cumulated counts): about ``shard_runs`` runs a row."""
    sizes = written(runs.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("runs")), "sizes")
    # Of groups larger than a shard there are at most runs / shard_runs; both sides are salted, so a hot group isn't gathered here either.
    salts = 64
    large = sizes.where(F.col("runs") > shard_runs).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("runs") / shard_runs).alias("__shards"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"),
    )
    h = F.xxhash64("value")
    same = F.pmod(h, F.lit(salts)) == F.col("__salt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    spread = runs.join(large, same, "left").select(*keys, F.coalesce("__shards", F.lit(1)).alias("shards"), "value", "n", h.alias("h"))
    spread = spread.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 8), F.col("shards")))
    packed = spread.groupBy(*keys, "shards", "shard").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("runs"), F.sum("n").alias("weight"))
    return packed, sizes


def _offsets(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)


def _halve(value: np.ndarray, upto: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the lower weighted median of the runs [lo, hi) each; ``upto`` is cumulated over all runs."""
    before = np.where(lo > 0, upto[lo - 1], 0)
    return np.searchsorted(upto, before + (upto[hi - 1] - before + 1) // 2)


def select_in_task(value: np.ndarray, count: np.ndarray, starts: np.ndarray, ratios: list[tuple[int, int]]) -> np.ndarray:
    """Rounds of multi-select for groups that lie in one task: value of each group (rows) and rank (columns).

    ``starts`` bound the groups' sorted runs. All groups and ranks take a round at once; found ones drop out.
    """
    upto = np.cumsum(count)
    first, end = starts[:-1], starts[1:]
    total = np.add.reduceat(count, first)
    k = np.stack([rank_of(total, *r) for r in ratios], 1).ravel()
    lo, hi = np.repeat(first, len(ratios)), np.repeat(end, len(ratios))
    found = np.empty(len(k), np.int64)
    live = np.arange(len(k))
    while len(live):
        at = _halve(value, upto, lo[live], hi[live])
        before = np.where(lo[live] > 0, upto[lo[live] - 1], 0)
        lt, eq = upto[at] - count[at] - before, count[at]
        down, up = k[live] <= lt, k[live] > lt + eq
        here = ~down & ~up
        found[live[here]] = at[here]
        hi[live[down]] = at[down]
        lo[live[up]] = at[up] + 1
        k[live[up]] -= (lt + eq)[up]
        live = live[~here]
    return value[found].reshape(-1, len(ratios))


def _weighted_medians(key: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per key: the lower weighted median of its values, and its weight."""
    order = np.lexsort((value, key))
    key, value, n = key[order], value[order], n[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    total = np.add.reduceat(n, starts) if len(starts) else np.zeros(0, n.dtype)
    cum = np.cumsum(n)
    base = np.append(0, cum)[starts]
    at = np.searchsorted(cum, base + (total + 1) // 2)
    return key[starts], value[at], total


def shard_round(value: np.ndarray, upto: np.ndarray, lo: np.ndarray, hi: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one shard, for every rank: counts below and at the pivot, and medians with weights of what is left on either side.

    ``lo``, ``hi`` are the exclusive bounds of what is left (NaN: none); a NaN pivot puts all that is left on the upper side.
    """
    full = np.append(0, upto)
    a = np.where(np.isnan(lo), 0, np.searchsorted(value, lo, "right"))
    b = np.where(np.isnan(hi), len(value), np.searchsorted(value, hi, "left"))
    b = np.maximum(a, b)
    p = np.where(np.isnan(pivot), a, np.clip(np.searchsorted(value, pivot, "left"), a, b))
    q = np.where(np.isnan(pivot), a, np.clip(np.searchsorted(value, pivot, "right"), a, b))
    med, weight = [], []
    for x, y in ((a, p), (q, b)):
        w = full[y] - full[x]
        at = np.searchsorted(upto, full[x] + (w + 1) // 2)
        med.append(np.where(w > 0, value[np.minimum(at, len(value) - 1)], np.nan))
        weight.append(w)
    return full[p] - full[a], full[q] - full[p], med[0], med[1], weight[0], weight[1]


PROPOSALS = "gid bigint, rank int, lt bigint, eq bigint, med_lt double, med_gt double, w_lt bigint, w_gt bigint"


def _merge(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Counts of one task's shards added up and their proposals merged, per group and rank."""
    gid, rank, lt, eq, med_lt, med_gt, w_lt, w_gt = (np.concatenate(x) for x in zip(*rows))
    keys, inv = np.unique(np.stack([gid, rank.astype(np.int64)]), axis=1, return_inverse=True)
    inv = inv.ravel()
    sums = [np.bincount(inv, x, keys.shape[1]).astype(np.int64) for x in (lt, eq)]
    best, weight = [], []
    for med, w in ((med_lt, w_lt), (med_gt, w_gt)):
        some = w > 0
        k, m, total = _weighted_medians(inv[some], med[some], w[some])
        v, n = np.full(keys.shape[1], np.nan), np.zeros(keys.shape[1], np.int64)
        v[k], n[k] = m, total
        best.append(v)
        weight.append(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[0]), pa.array(keys[1].astype(np.int32)), *map(pa.array, sums), *[pa.array(x, from_pandas=True) for x in best], *map(pa.array, weight)],
        ["gid", "rank", "lt", "eq", "med_lt", "med_gt", "w_lt", "w_gt"],
    )


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's part in a round; every shard comes with its group's state."""
    rows: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        (at, value), (_, upto), (so, rank) = (_offsets(b.column(i)) for i in (1, 2, 3))
        lo, hi, pivot = (_offsets(b.column(i))[1] for i in (4, 5, 6))
        for i, g in enumerate(b.column(0).to_pylist()):
            v, s = slice(at[i], at[i + 1]), slice(so[i], so[i + 1])
            rows.append((np.full(so[i + 1] - so[i], g), rank[s], *shard_round(value[v], upto[v], lo[s], hi[s], pivot[s])))
    if rows:
        yield _merge(rows)


def _propose_from(shared):
    """The same with the state, sorted by group, from a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, rank, _, lo, hi, pivot = shared.value
        rows: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            (at, value), (_, upto) = _offsets(b.column(1)), _offsets(b.column(2))
            own = b.column(0).to_numpy()
            for i, (x, y) in enumerate(zip(np.searchsorted(gid, own, "left"), np.searchsorted(gid, own, "right"))):
                if x < y:
                    v, s = slice(at[i], at[i + 1]), slice(x, y)
                    rows.append((gid[s], rank[s], *shard_round(value[v], upto[v], lo[s], hi[s], pivot[s])))
        if rows:
            yield _merge(rows)

    return run


# A state of up to this many groups and ranks (48 bytes each) is kept by the driver and broadcast to the shards; a larger one
# is a written table that is joined to them by group and salt.
MOST_BROADCAST = 500_000
STATE_SALTS = 32


def _with_state(shards: DataFrame, state: DataFrame) -> DataFrame:
    """Every shard with its group's state: one row per group, ranks in arrays."""
    nan = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    items = F.sort_array(F.collect_list(F.struct("rank", nan("lo").alias("lo"), nan("hi").alias("hi"), nan("pivot").alias("pivot"))))
    one = state.groupBy("gid").agg(items.alias("x")).select("gid", *[F.col(f"x.{c}").alias(c) for c in ("rank", "lo", "hi", "pivot")])
    salted = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STATE_SALTS - 1))))
    both = shards.withColumn("salt", F.pmod("shard", F.lit(STATE_SALTS))).join(salted, ["gid", "salt"])
    return both.select("gid", "value", "upto", "rank", "lo", "hi", "pivot")


def multi_select(runs: DataFrame, keys: list[str], percents: list[float], shard_runs: int = 512, most_rounds: int = 200) -> DataFrame:
    """keys, percent, n (values in the group), value. ``runs`` must be written or cheap: it is read twice."""
    ratios = [_ratio(p) for p in percents]
    if not ratios:
        raise ValueError("name at least one percent")
    packed, sizes = shards_of(runs, keys, shard_runs)
    packed = written(packed.withColumns({"value": F.col("runs.value"), "count": F.col("runs.n")}).drop("runs"), "shards")
    discard(sizes)
    names = [float(p) for p in percents]
    width = len(names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (at, value), (_, count) = _offsets(b.column(len(keys))), _offsets(b.column(len(keys) + 1))
            got = select_in_task(value, count.astype(np.int64), at, ratios)
            take = pa.array(np.repeat(np.arange(b.num_rows), width))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(take) for i in range(len(keys))], pa.array(np.tile(names, b.num_rows)), b.column(len(keys) + 2).take(take), pa.array(got.ravel())],
                [*keys, "percent", "n", "value"],
            )

    kinds = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)
    own = packed.where("shards = 1").select(*keys, "value", "count", "weight")
    out = own.mapInArrow(local, f"{kinds}, percent double, n bigint, value double")

    several = packed.where("shards > 1")
    large = written(several.groupBy(*keys).agg(F.sum("weight").alias("total")).withColumn("gid", F.monotonically_increasing_id()), "large")
    size = large.count() * width
    if not size:
        discard(large)
        return out
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    ids = large.drop("total")
    shards = several.alias("a").join((F.broadcast(ids) if size <= MOST_BROADCAST else ids).alias("b"), same)
    shards = shards.select("b.gid", "a.shard", "a.value", "a.count").mapInArrow(_cumulate, "gid bigint, shard bigint, value array<double>, upto array<bigint>")
    shards = written(shards, "rows")
    found = (_rounds_on_driver if size <= MOST_BROADCAST else _rounds_by_join)(shards, large, ratios, most_rounds)
    discard(shards)
    labels = F.array(*[F.lit(p) for p in names])
    spread = found.join(large, "gid").select(
        *keys, F.element_at(labels, F.col("rank") + 1).alias("percent"), F.col("total").alias("n"), F.col("found").alias("value"),
    )
    return out.unionByName(spread)


def _tally(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("gid", "rank").agg(
        F.sum("lt").alias("lt"), F.sum("eq").alias("eq"),
        *[F.percentile(f"med_{s}", 0.5, F.greatest(f"w_{s}", F.lit(0))).alias(f"med_{s}") for s in ("lt", "gt")],
    )


def _rounds_on_driver(shards: DataFrame, large: DataFrame, ratios: list[tuple[int, int]], most_rounds: int) -> DataFrame:
    """(gid, rank, found), the state being of checked size: a round is one job of one shuffle."""
    spark = shards.sparkSession
    groups = large.select("gid", "total").orderBy("gid").toArrow()
    g, total = groups.column("gid").to_numpy(), groups.column("total").to_numpy()
    width = len(ratios)
    gid, rank = np.repeat(g, width), np.tile(np.arange(width, dtype=np.int32), len(g))
    k = np.stack([rank_of(total, *r) for r in ratios], 1).ravel()
    lo, hi, pivot = (np.full(len(k), np.nan) for _ in range(3))
    done: list[tuple[np.ndarray, ...]] = []
    for _ in range(most_rounds):
        shared = spark.sparkContext.broadcast((gid, rank, k, lo, hi, pivot))
        t = _tally(shards.select("gid", "value", "upto").mapInArrow(_propose_from(shared), PROPOSALS)).toArrow()
        shared.unpersist()
        order = np.lexsort((t.column("rank").to_numpy(), t.column("gid").to_numpy()))  # one row for every group and rank of the state
        lt, eq, med_lt, med_gt = (t.column(c).to_numpy()[order] for c in ("lt", "eq", "med_lt", "med_gt"))
        first = np.isnan(pivot)
        down = ~first & (k <= lt)
        here = ~first & ~down & (k <= lt + eq)
        up = ~first & ~down & ~here
        done.append((gid[here], rank[here], pivot[here]))
        k = np.where(up, k - lt - eq, k)
        lo, hi = np.where(up, pivot, lo), np.where(down, pivot, hi)
        pivot = np.where(down, med_lt, med_gt)
        gid, rank, k, lo, hi, pivot = (x[~here] for x in (gid, rank, k, lo, hi, pivot))
        if not len(gid):
            break
    else:
        raise RuntimeError("the selection did not end")
    cols = [np.concatenate(x) for x in zip(*done)]
    return spark.createDataFrame(pa.table({"gid": pa.array(cols[0], pa.int64()), "rank": pa.array(cols[1], pa.int32()), "found": pa.array(cols[2], pa.float64())}))


def _rounds_by_join(shards: DataFrame, large: DataFrame, ratios: list[tuple[int, int]], most_rounds: int) -> DataFrame:
    """The same, the state being a table."""
    null = F.lit(None).cast("double")

    def at(num: int, den: int):
        return F.greatest(F.lit(1).cast("bigint"), F.expr(f"(total div {den}L) * {num}L + ((total % {den}L) * {num}L + {den - 1}L) div {den}L"))

    start = F.array(*[F.struct(F.lit(i).alias("rank"), at(*r).alias("k")) for i, r in enumerate(ratios)])
    state = large.select("gid", F.explode(start).alias("x")).select("gid", "x.rank", "x.k", null.alias("lo"), null.alias("hi"), null.alias("pivot"))
    done: list[DataFrame] = []
    for _ in range(most_rounds):
        tally = _tally(_with_state(shards, state).mapInArrow(_propose, PROPOSALS))
        first, low = F.col("pivot").isNull(), F.col("k") <= F.col("lt")
        down = ~first & low
        here = ~first & ~low & (F.col("k") <= F.col("lt") + F.col("eq"))
        up = ~first & ~down & ~here
        x = written(state.join(tally, ["gid", "rank"]).select(
            "gid", "rank",
            F.when(up, F.col("k") - F.col("lt") - F.col("eq")).otherwise(F.col("k")).alias("k"),
            F.when(up, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
            F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(down, F.col("med_lt")).otherwise(F.col("med_gt")).alias("pivot"),
            F.when(here, F.col("pivot")).alias("found"),
        ), "round")
        done.append(x.where("found is not null").select("gid", "rank", "found"))
        state = x.where("found is null").drop("found")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError("the selection did not end")


def _cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each shard to cumulated ones."""
    for b in batches:
        at, count = _offsets(b.column(3))
        upto = np.cumsum(count)
        base = np.append(0, upto)[at[:-1]]
        upto = upto - np.repeat(base, np.diff(at))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(upto, pa.int64()))], ["gid", "shard", "value", "upto"])


def percentiles(
    parts: DataFrame, groups: list[str], sets: dict[str, list[str]], percents: list[float],
    relative_error: float | None = None, shard_runs: int = 512,
) -> DataFrame:
    """grouping, groups, column_name, percent, n, value, error_bound from parts made with the same ``relative_error``."""
    runs = written(roll_up(parts, groups, sets), "runs")
    out = multi_select(runs, ["grouping", *groups, "column_name"], percents, shard_runs)
    discard(runs)
    return out.withColumn("error_bound", F.abs("value") * F.lit(relative_error or 0.0))

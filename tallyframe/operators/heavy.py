"""Keys that hold most records: found by a mergeable counter sketch, processed apart from the rest.

1. Each task runs a Misra-Gries sketch over dictionary-coded Arrow batches and emits its surviving counters; added up they
   undercount a key by at most rows / (capacity + 1), so every key at the threshold is among the candidates, and there
   are at most 1 / (threshold - 1 / (capacity + 1)) candidates, whatever the size of the data.
2. Rows of candidates are joined to the broadcast list of that proven size, which also gives each of them its number of
   salts (one per ``SALT_ROWS`` rows), and are processed per key and salt before a small final step per key.
3. All other rows go by an ordinary shuffle, and the two results are united.

``per_key`` does this for aggregates that merge by sum, min or max; ``distinct_per_key`` for distinct counts, salting by the
value counted; ``apply_per_key`` for user code of two steps. ``heavy_keys`` are the rows of the first at the threshold.

Null keys: a null is no heavy key; its rows go the ordinary way (spread by salts in ``apply_per_key``), their partial
aggregates being one row a task. Ties, repeated rows and empty tables need no special case (an empty table has no heavy key).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_ROWS = 1_000_000
LEAST_SALTS, MOST_SALTS = 16, 100_000
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


def shrink(counts: dict[str, int], capacity: int) -> dict[str, int]:
    """Misra-Gries: subtract the (capacity+1)-th largest count from all and keep what is positive."""
    if len(counts) <= capacity:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - capacity - 1)[len(values) - capacity - 1])
    return {k: v - cut for k, v in counts.items() if v > cut}


def sketch(df: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """(key_column, key_value, n): at most ``capacity`` counters per task and column, and per task the row count under a null key."""
    source = df.select(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict[str, int]] = [{} for _ in columns]
        rows = 0
        for b in batches:
            rows += b.num_rows
            for i, counts in enumerate(seen):
                vc = pc.value_counts(b.column(i))
                for k, n in zip(vc.field("values").to_pylist(), vc.field("counts").to_pylist()):
                    if k is not None:
                        counts[k] = counts.get(k, 0) + n
                seen[i] = shrink(counts, capacity)
        out = [(c, k, n) for c, counts in zip(columns, seen) for k, n in counts.items()] + [(None, None, rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())],
            ["key_column", "key_value", "n"],
        )

    return source.mapInArrow(run, "key_column string, key_value string, n bigint")


def candidates(df: DataFrame, columns: list[str], threshold: float, capacity: int | None = None) -> tuple[dict[tuple[str, str], int], int]:
    """All (column, key) that may hold ``threshold`` of the rows, with counts too low by at most rows / (capacity + 1); and the number of rows."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    capacity = capacity or int(np.ceil(4 / threshold))
    if threshold * (capacity + 1) <= 1:
        raise ValueError("the capacity is too small for the threshold")
    merged = sketch(df, columns, capacity).groupBy("key_column", "key_value").agg(F.sum("n").alias("n"))
    least = threshold - 1.0 / (capacity + 1)
    most = len(columns) * int(np.ceil(1 / least)) + 1  # no more keys can reach the least count, so the top holds them all
    tops = merged.orderBy(F.col("key_column").isNull().desc(), F.col("n").desc()).limit(most).collect()
    total = next((r.n for r in tops if r.key_column is None), 0)
    return {(r.key_column, r.key_value): r.n for r in sorted(tops, key=str) if r.key_column is not None and r.n >= total * least}, total


def split_rows(df: DataFrame, column: str, found: dict[tuple[str, str], int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of light keys, and those of heavy keys with ``__salts`` from the broadcast list; both with the key as text in ``__key``."""
    mine = {k: n for (c, k), n in found.items() if c == column}
    tagged = df.withColumn("__key", F.col(f"`{column}`").cast("string"))
    if not mine:
        return tagged, None
    rows = [(k, min(MOST_SALTS, max(LEAST_SALTS, -(-2 * n // SALT_ROWS)))) for k, n in mine.items()]
    hot = F.broadcast(df.sparkSession.createDataFrame(rows, "__hot string, __salts int"))  # at most 1/threshold rows or so
    heavy = tagged.join(hot, F.col("__key") == F.col("__hot")).drop("__hot")
    light = tagged.join(hot.select("__hot"), F.col("__key") == F.col("__hot"), "left_anti")
    return light, heavy


def per_key(
    df: DataFrame, column: str, parts: dict[str, tuple[Column, str]], finals: dict[str, Column], threshold: float = 0.05,
    found: dict[tuple[str, str], int] | None = None,
) -> DataFrame:
    """One row per value of ``column`` with ``finals`` computed from the mergeable ``parts``.

    ``parts``: name to an aggregate over rows and how partial results merge: ``"sum"`` (for counts too), ``"min"`` or
    ``"max"``. ``finals`` are expressions over the merged parts. Heavy keys: broadcast join, salted first aggregation, then
    one small final one. ``found``: candidates of an earlier sketch.
    """
    for name, part in parts.items():
        if not (isinstance(part, tuple) and len(part) == 2 and part[1] in MERGES):
            raise ValueError(f"part {name!r} is an aggregate and one of {sorted(MERGES)}")
    if found is None:
        found, _ = candidates(df, [column], threshold)
    light, heavy = split_rows(df, column, found)
    aggs = [e.alias(n) for n, (e, _) in parts.items()]
    out = light.groupBy(F.col("__key").alias("key_value")).agg(*aggs)
    if heavy is not None:
        salt = F.pmod(F.monotonically_increasing_id(), F.col("__salts"))
        first = heavy.groupBy(F.col("__key").alias("key_value"), salt.alias("__salt")).agg(*aggs)
        out = out.unionByName(first.groupBy("key_value").agg(*[MERGES[how](n).alias(n) for n, (_, how) in parts.items()]))
    return out.select(F.lit(column).alias("key_column"), "key_value", *[e.alias(n) for n, e in finals.items()])


def heavy_keys(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """(key_column, key_value, n, share): exactly the non-null keys that hold at least ``threshold`` of all rows."""
    found, total = candidates(df, columns, threshold)
    least = math.ceil(Fraction(str(threshold)) * total)  # exact where a share falls right on the threshold
    rows = {"n": (F.count(F.lit(1)), "sum")}
    out = None
    for c in columns:
        one = per_key(df.select(F.col(f"`{c}`")), c, rows, {"n": F.col("n")}, threshold, found)
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("key_value").isNotNull() & (F.col("n") >= least)).withColumn("share", F.col("n") / F.lit(total))


def distinct_per_key(df: DataFrame, column: str, values: list[str], threshold: float = 0.05) -> DataFrame:
    """(key_column, key_value, n_<value>...): exact distinct non-null values per key.

    Distinct counts don't merge, so heavy keys' rows are salted by the value itself: equal values of a key meet in one salt,
    are made one row there, and the salts' counts add up.
    """
    found, _ = candidates(df.select(F.col(f"`{column}`")), [column], threshold)
    light, heavy = split_rows(df.select(F.col(f"`{column}`"), *[F.col(f"`{v}`") for v in values]), column, found)
    names = [f"n_{v}" for v in values]
    out = light.groupBy(F.col("__key").alias("key_value")).agg(*[F.count_distinct(F.col(f"`{v}`")).alias(n) for v, n in zip(values, names)])
    if heavy is not None:
        cells = F.array(*[F.struct(F.lit(i).alias("no"), F.xxhash64(F.col(f"`{v}`")).alias("h"), F.col(f"`{v}`").cast("string").alias("v")) for i, v in enumerate(values)])
        long = heavy.select("__key", "__salts", F.explode(cells).alias("x")).select("__key", "x.no", "x.v", F.pmod("x.h", F.col("__salts")).alias("salt"))
        once = long.groupBy("__key", "no", "salt", "v").agg(F.lit(1).alias("one"))
        per_salt = once.groupBy("__key", "salt").agg(*[F.count(F.when(F.col("no") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])
        out = out.unionByName(per_salt.groupBy(F.col("__key").alias("key_value")).agg(*[F.sum(n).alias(n) for n in names]))
    return out.select(F.lit(column).alias("key_column"), "key_value", *names)


def apply_per_key(
    df: DataFrame, column: str, piece: Callable[[pa.Table], pa.Table], piece_schema: str,
    merge: Callable[[pa.Table], pa.Table], schema: str, threshold: float = 0.05,
) -> DataFrame:
    """(key_value, columns of ``schema``): user code per key, in two steps so that no task holds a heavy key's rows.

    ``piece`` turns some rows of one key into a smaller table (``piece_schema``); ``merge`` turns all pieces of a key into its
    result. Heavy keys: a piece per salt, about ``SALT_ROWS`` rows each, then one merge. Null keys go the same way with
    salts of their own. Light keys: one shuffle by key, one piece, merged at once.
    """
    found, total = candidates(df.select(F.col(f"`{column}`")), [column], threshold)
    light, heavy = split_rows(df, column, found)
    null_salts = min(MOST_SALTS, max(LEAST_SALTS, total // SALT_ROWS))
    nulls = light.where("__key is null").withColumn("__salts", F.lit(null_salts).cast("int"))
    spread = nulls if heavy is None else heavy.unionByName(nulls)
    spread = spread.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.col("__salts"))).drop("__salts")

    def keyed(t: pa.Table, key: str | None) -> pa.Table:
        return t.add_column(0, "key_value", pa.array([key] * t.num_rows, pa.string()))

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return keyed(piece(t.drop_columns(["__key", "__salt"])), key[0].as_py())

    def last(key: tuple, t: pa.Table) -> pa.Table:
        return keyed(merge(t.drop_columns(["key_value"])), key[0].as_py())

    def both(key: tuple, t: pa.Table) -> pa.Table:
        return keyed(merge(piece(t.drop_columns(["__key"]))), key[0].as_py())

    pieces = spread.groupBy("__key", "__salt").applyInArrow(first, f"key_value string, {piece_schema}")
    out = pieces.groupBy("key_value").applyInArrow(last, f"key_value string, {schema}")
    return out.unionByName(light.where("__key is not null").groupBy("__key").applyInArrow(both, f"key_value string, {schema}"))

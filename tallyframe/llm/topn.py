"""Top N items of every group by secondary sort.

Each input task first sorts its own rows by group, score and identifiers and streams out N rows per group, so no more than
N rows per group and input task are shuffled, however hot a group is. Those are hash-partitioned by group, sorted within
partitions and streamed again: Arrow batches pass through with one carried key and one counter, and no group is buffered.

Defined results: scores and identifiers that are null sort last; a null group is a group; equal rows each take a rank of
their own; empty tables give no rows; groups of fewer than N rows are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_positions(batch: pa.RecordBatch, width: int, carried: tuple | None, count: int) -> tuple[np.ndarray, tuple, int]:
    """1-based position of each row in its run of equal keys (the first ``width`` columns), the last key and its position."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    for i in range(width):
        codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    head = tuple(batch.column(i)[0].as_py() for i in range(width))
    same = carried is not None and head == carried
    change[0] = True
    starts = np.flatnonzero(change)
    pos = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
    if same:
        first = starts[1] if len(starts) > 1 else n
        pos[:first] += count
    last = tuple(batch.column(i)[n - 1].as_py() for i in range(width))
    return pos, last, int(pos[-1])


def first_rows(df: DataFrame, width: int, n: int, rank: str | None) -> DataFrame:
    """Stream sorted partitions and keep the first ``n`` rows of every run of keys."""
    fields = list(df.schema.fields) + ([T.StructField(rank, T.IntegerType())] if rank else [])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            pos, carried, count = run_positions(b, width, carried, count)
            keep = pos <= n
            if not keep.any():
                continue
            out = b.filter(pa.array(keep))
            cols = out.columns + ([pa.array(pos[keep].astype(np.int32))] if rank else [])
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, T.StructType(fields))


def top_n(df: DataFrame, groups: list[str], score: str, ids: list[str], n: int, keep: list[str] | None = None, rank: str = "rank_no") -> DataFrame:
    """Groups, score, identifiers, ``keep`` columns and ``rank`` of the ``n`` rows with the highest score in each group.

    Ties in score fall to ``ids`` ascending, in order; make them unique for a result that never varies.
    """
    if n < 1 or not groups:
        raise ValueError("top_n needs groups and n of at least 1")
    cols = list(dict.fromkeys([*groups, score, *ids, *(keep or [])]))
    if rank in cols:
        raise ValueError(f"{rank!r} names a column already")
    order = [*[F.col(f"`{g}`") for g in groups], F.col(f"`{score}`").desc_nulls_last(), *[F.col(f"`{i}`").asc_nulls_last() for i in ids]]
    rows = df.select(*[F.col(f"`{c}`") for c in cols])
    local = first_rows(rows.sortWithinPartitions(*order), len(groups), n, None)
    there = local.repartition(*[F.col(f"`{g}`") for g in groups]).sortWithinPartitions(*order)
    return first_rows(there, len(groups), n, rank)

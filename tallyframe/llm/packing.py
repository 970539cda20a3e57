"""Items packed into containers of fixed capacity, costs balanced.

An item costs ``linear * n + quadratic * n^2`` (attention within the item). Items longer than the capacity are cut into
full pieces and a rest; no other item is cut. Items fall by hash into pools of about ``pool_containers`` containers' size,
whose number follows the total, so a pool always fits one task; pools are packed in parallel. Within a pool as many
containers are open as its tokens need at least; pieces in descending length go to the container with the lowest cost so
far that has room, and a new one is opened only where none has. A pool leaves about one container partly filled. Balancing packs badly
where most pieces are about half the capacity: for such items the caller may ask for ``tight`` packing, by least room.

Defined results: an item of no tokens (null or empty text) takes a place but no room; items with null identifiers are
packed as any other; an empty table gives no rows. Ties in length go by identifier, ties in cost by container number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import written

POOL_BITS = 24


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096, tight: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Container number and offset of pieces in the order given, and how many containers it took.

    A piece goes to the container of lowest cost that has room; with ``tight`` to the one with the least room that will do.
    """
    count = max(1, -(-int(lengths.sum()) // capacity))
    room = np.full(count, capacity, np.int64)
    cost = np.zeros(count)
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = room >= n
        k = int(np.where(fits, room if tight else cost, np.inf).argmin())
        if not fits[k]:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        where[i], at[i] = k, capacity - room[k]
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    return where, at, len(room)


def pack_items(
    items: DataFrame, ident: str, size: str, capacity: int = 2048, pool_containers: int = 512, linear: float = 1.0,
    quadratic: float = 1.0 / 4096, tight: bool = False,
) -> DataFrame:
    """(ident, piece_no, first_token, n_tokens, container_id, start): one row per piece; every item has at least one."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    kind = items.schema[ident].dataType.simpleString()
    sized = items.select(F.col(f"`{ident}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    sized = written(sized.withColumn("mix", F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.monotonically_increasing_id())), "items")
    got = sized.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("items")).first()
    pools = max(1, -(-((got.tokens or 0) + got["items"]) // (pool_containers * capacity)))
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("n") / capacity) - 1)
    pieces = sized.select("id", "n", F.pmod(F.xxhash64("mix"), F.lit(pools)).alias("pool"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    first = F.col("piece") * capacity
    pieces = pieces.select(
        "pool", "id", F.col("piece").cast("int").alias("piece_no"), first.alias("first_token"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - first).alias("n_tokens"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece_no", "ascending")])
        where, at, _ = assign(group.column("n_tokens").to_numpy(), capacity, linear, quadratic, tight)
        pool = group.column("pool")[0].as_py()
        cols = [group.column(c) for c in ("id", "piece_no", "first_token", "n_tokens")]
        return pa.Table.from_arrays(
            [*cols, pa.array(where + (pool << POOL_BITS)), pa.array(at)],
            ["id", "piece_no", "first_token", "n_tokens", "container_id", "start"],
        )

    out = pieces.groupBy("pool").applyInArrow(run, f"id {kind}, piece_no int, first_token bigint, n_tokens bigint, container_id bigint, start bigint")
    return out.withColumnRenamed("id", ident)


def fill_report(packed: DataFrame, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> DataFrame:
    """One row: containers, pieces, tokens, share of room used, and the spread of container costs."""
    n = F.col("n_tokens").cast("double")
    per = packed.groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"),
        F.sum(linear * n + quadratic * n * n).alias("cost"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("used"), F.max("tokens").alias("fullest"),
        F.avg("cost").alias("mean_cost"), F.stddev_samp("cost").alias("stdev_cost"),
    )

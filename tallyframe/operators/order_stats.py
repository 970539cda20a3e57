"""Exact quantiles without a column's values in one buffer: counted, sorted by range, found by two-level prefix sums.

Values are counted per column (partial counts before the shuffle), range-partitioned and sorted; the partitions' totals, one
row each, tell in which partition a rank lies, and only there are counts cumulated. So no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import discard, written


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> list[list[float | None]]:
    """Per column the values at ``probs``, interpolated between the two nearest ranks; null for a column without values.

    Nulls are skipped; NaN counts as larger than any number. Only columns x probs x 2 rows reach the driver.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("no"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.explode(cells).alias("x")).select("x.no", "x.v").where("v is not null")
    counted = long.groupBy("no", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("no", "v").sortWithinPartitions("no", "v")
    runs = written(counted.withColumn("part", F.spark_partition_id()), "ordered")
    parts = runs.groupBy("no", "part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy("no")))
    # 0-based ranks below and above each quantile; those whose partition it is.
    at = F.array(*[F.lit(float(p)) for p in probs]) if probs else F.array().cast("array<double>")
    place = lambda p: p * (F.col("total") - 1)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda p: F.floor(place(p))), F.transform(at, lambda p: F.ceil(place(p)))))
    own = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))
    wanted = parts.withColumn("ranks", own).where(F.size("ranks") > 0).select("no", "part", "before", "total", "ranks")
    upto = F.sum("n").over(Window.partitionBy("no", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    held = runs.join(wanted, ["no", "part"]).withColumn("upto", upto)
    hit = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    got = held.select("no", "v", "total", F.explode(hit).alias("rank")).collect()
    discard(runs)
    value = {(r.no, r["rank"]): r.v for r in got}
    total = {r.no: r.total for r in got}
    out: list[list[float | None]] = []
    for i in range(len(columns)):
        one: list[float | None] = []
        for p in probs:
            if i not in total:
                one.append(None)
                continue
            x = p * (total[i] - 1)
            lo = int(x // 1)
            a = value[i, lo]
            b = value[i, lo + (x > lo)]
            one.append(a if a == b else a + (b - a) * (x - lo))
        out.append(one)
    return out

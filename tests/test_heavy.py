import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import heavy


def rows_of(n, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 33 + ["warm"] * 8 + [None] * 9
    return [(rng.choice(keys + [f"k{rng.randint(0, 300)}" for _ in range(50)]), rng.choice(["x", "y", None]), rng.choice([None, *range(-5, 50)])) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_heavy_keys_exact(spark, threshold):
    rows = rows_of(4000)
    df = spark.createDataFrame(rows, "a string, b string, v int").repartition(9)
    got = {(r.key_column, r.key_value): r.n for r in heavy.heavy_keys(df, ["a", "b"], threshold).collect()}
    want = {}
    for i, c in enumerate("ab"):
        want |= {(c, k): n for k, n in Counter(r[i] for r in rows).items() if k is not None and n >= threshold * len(rows)}
    assert got == want


def test_per_key_matches_plain_group(spark):
    rows = rows_of(3000, 2)
    df = spark.createDataFrame(rows, "a string, b string, v int").repartition(5)
    # Names say nothing about how parts merge.
    parts = {
        "rows": (F.count(F.lit(1)), "sum"), "minutes": (F.sum("v"), "sum"), "maximum_sum": (F.sum("v"), "sum"),
        "low": (F.min("v"), "min"), "sum_high": (F.max("v"), "max"),
    }
    got = heavy.per_key(df, "a", parts, {n: F.col(n) for n in parts}, 0.05)
    want = df.groupBy("a").agg(*[e.alias(n) for n, (e, _) in parts.items()])
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    for bad in (F.count(F.lit(1)), (F.count(F.lit(1)), "avg")):
        with pytest.raises(ValueError):
            heavy.per_key(df, "a", {"rows": bad}, {})


def test_distinct_and_user_code_per_key(spark):
    rows = rows_of(3000, 4)
    df = spark.createDataFrame(rows, "a string, b string, v int").repartition(5)
    got = {r.key_value: (r.n_v, r.n_b) for r in heavy.distinct_per_key(df, "a", ["v", "b"], 0.05).collect()}
    keys = {r[0] for r in rows}
    assert got == {k: tuple(len({r[i] for r in rows if r[0] == k and r[i] is not None}) for i in (2, 1)) for k in keys}
    piece = lambda t: pa.table({"s": [pc.sum(t.column("v")).as_py() or 0], "n": [t.num_rows]})
    merge = lambda t: pa.table({"total": [pc.sum(t.column("s")).as_py()], "rows": [pc.sum(t.column("n")).as_py()]})
    out = heavy.apply_per_key(df, "a", piece, "s bigint, n bigint", merge, "total bigint, rows bigint", 0.05).collect()
    want = {k: (sum(r[2] or 0 for r in rows if r[0] == k), sum(r[0] == k for r in rows)) for k in keys}
    assert {r.key_value: (r.total, r.rows) for r in out} == want and len(out) == len(keys)


def test_shrink_keeps_heavy():
    counts = {f"k{i}": 1 for i in range(50)} | {"hot": 60}
    assert heavy.shrink(counts, 4) == {"hot": 59}


def test_empty_and_errors(spark):
    df = spark.createDataFrame([], "a string")
    assert heavy.heavy_keys(df, ["a"], 0.05).count() == 0
    assert heavy.per_key(df, "a", {"rows": (F.count(F.lit(1)), "sum")}, {"rows": F.col("rows")}).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "a string")
    assert heavy.heavy_keys(nulls, ["a"], 0.05).count() == 0
    with pytest.raises(ValueError):
        heavy.heavy_keys(df, ["a"], 0)

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import percentiles as P


def exact(values, percent):
    values = sorted(values)
    return values[max(1, math.ceil(Fraction(str(percent)) * len(values) / 100)) - 1]


@pytest.mark.parametrize("shard_runs", [1, 50, 10_000])
def test_any_sharding_agrees_with_brute_force(spark, shard_runs):
    rng = random.Random(3)
    rows = []
    for g in ["a", None, "hot", "one"]:
        size = {"a": 300, None: 40, "hot": 4000, "one": 1}[g]
        rows += [(i % 3, g, float(rng.choice([rng.gauss(0, 50), round(rng.gauss(0, 5)), 99999.0]))) for i in range(size)]
    rows += [(0, "a", None), (0, "empty", None)]
    df = spark.createDataFrame(rows, "day int, g string, v double").repartition(6)
    parts = P.percentile_parts(df, ["g"], ["v"], part="day")
    merged = P.merge_parts(parts.where("day < 2"), ["g"], parts.where("day = 2"))
    got = P.percentiles(merged, ["g"], {"g": ["g"], "all": []}, [0, 1, 50, 90, 100], shard_runs=shard_runs).collect()
    want = {}
    for g in {r[1] for r in rows}:
        vs = [r[2] for r in rows if r[1] == g and r[2] is not None]
        for p in (0, 1, 50, 90, 100):
            if vs:
                want[("g", g, p)] = (exact(vs, p), len(vs))
    everything = [r[2] for r in rows if r[2] is not None]
    want |= {("all", None, p): (exact(everything, p), len(everything)) for p in (0, 1, 50, 90, 100)}
    assert {(r.grouping, r.g, int(r.percent)): (r.value, r.n) for r in got} == want


def test_bounded_error(spark):
    rng = random.Random(5)
    vs = [rng.lognormvariate(3, 2) * rng.choice([-1, 1]) for _ in range(2000)] + [0.0] * 20
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    parts = P.percentile_parts(df, [], ["v"], relative_error=0.02)
    got = P.percentiles(parts, [], {"all": []}, [5, 50, 95], relative_error=0.02).collect()
    for r in got:
        true = exact(vs, r.percent)
        assert abs(r.value - true) <= 0.02 * abs(true) + 1e-9
    assert parts.count() < 700


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert P.percentiles(P.percentile_parts(df, ["g"], ["v"]), ["g"], {"g": ["g"]}, [50]).count() == 0


def test_ranks_are_exact(spark):
    df = spark.range(1, 100_000).select(F.col("id").cast("double").alias("v"))
    runs = P.percentile_parts(df, [], ["v"])
    for shard_runs in (10_000, 10**6):
        got = {r.percent: r.value for r in P.percentiles(runs, [], {"all": []}, [99.996, 0.001, 33.3333, 12.5], shard_runs=shard_runs).collect()}
        assert got == {99.996: 99996.0, 0.001: 1.0, 33.3333: 33333.0, 12.5: 12500.0}
    assert P.rank_of(np.array([10**12 + 7]), 99_999_999, 10**8)[0] == -(-(10**12 + 7) * 99_999_999 // 10**8)
    for bad in ([101], [-1], [1e-9], []):
        with pytest.raises(ValueError):
            P.multi_select(runs, ["column_name"], bad)


def test_large_states_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    got = P.percentiles(P.percentile_parts(df, ["g"], ["v"]), ["g"], {"g": ["g"]}, [50, 99], shard_runs=20).collect()
    for r in got:
        assert r.value == exact([i * 37 % 1009 for i in range(3000) if i % 7 == r.g], r.percent)
    assert len(got) == 14

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing

TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("gone", 0.1, 2)]


def docs(spark, scale=1):
    rng = random.Random(1)
    rows = [(i, s, rng.randint(0, 60)) for i, s in enumerate(["big"] * 3000 * scale + ["mid"] * 900 * scale + ["tiny"] * 150 * scale + [None] * 20 + ["other"] * 20)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(6), rows


@pytest.mark.parametrize("bucket_rows", [50, 20_000])
def test_shares_and_repeats(spark, bucket_rows):
    df, rows = docs(spark)
    plan = mixing.plan_mix(df, TARGETS, shapes={"tiny": [0.5, 1, 1.5], "big": [1.5, 1, 0.5]}, knots=[0, 0.5, 1])
    out = mixing.mix(df, plan, bucket_rows=bucket_rows).cache()
    report = {r.source: r for r in mixing.share_report(df, out, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")).collect()}
    assert set(report) == {"big", "mid", "tiny", "gone", "other", None}
    for s, p, m in TARGETS[:3]:
        assert abs(report[s].actual_share - p) < 0.004
        assert report[s].most_uses <= m
    assert report["gone"].actual_share == report["other"].actual_share == report[None].actual_share == 0
    assert report["tiny"].most_uses == 4 and report["tiny"].used_tokens == 4 * report["tiny"].tokens
    copies = out.groupBy("doc_id", "copy_no").count()
    assert copies.where("count > 1").count() == 0
    sizes = dict((r[0], r[2]) for r in rows)
    assert all(sizes[r.doc_id] == r.n_tokens for r in out.collect())


def test_positions_follow_the_schedule(spark):
    df, _ = docs(spark, 3)
    plan = mixing.plan_mix(df, TARGETS[:3], shapes={"tiny": [0.2, 1.8], "big": [1.4, 0.6]}, knots=[0, 1])
    out = mixing.mix(df, plan)
    pos = [r.position for r in out.collect()]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    weights = {p["source"]: p["w"] for p in plan}
    tenth = out.groupBy(F.floor(F.col("position") * 10).alias("t"), "source").agg(F.sum("n_tokens").alias("n")).collect()
    for t in range(10):
        total = sum(r.n for r in tenth if r.t == t)
        for s, (a, b) in weights.items():
            got = sum(r.n for r in tenth if r.t == t and r.source == s) / total
            assert abs(got - (a + (b - a) * (t + 0.5) / 10)) < 0.03


def test_fit_schedule():
    w = mixing.fit_schedule({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": [2, 1, 0.5], "c": [0, 1, 3]}, [0, 0.25, 1])
    m = np.array(list(w.values()))
    assert np.allclose(m.sum(0), 1) and np.allclose(m @ np.array([0.125, 0.5, 0.375]), [0.6, 0.3, 0.1])
    with pytest.raises(ValueError):
        mixing.fit_schedule({"a": 1.0}, {}, [0, 0.5])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    assert mixing.mix(df, mixing.plan_mix(df, TARGETS)).count() == 0
    one = spark.createDataFrame([(1, "big", 0), (2, "big", 5)], "doc_id long, source string, n_tokens long")
    assert mixing.mix(one, mixing.plan_mix(one, [("big", 1.0, 1)])).count() == 2


def test_a_long_document_at_the_end_is_passed_over(spark):
    rng = random.Random(4)
    rows = [(i, "a", 9000 if i % 40 == 3 else rng.randint(1, 200)) for i in range(400)] + [(1000 + i, "b", 50) for i in range(300)] + [(None, "a", 10)] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = [("a", 0.5, 1), ("b", 0.5, 1)]
    out = mixing.mix(df, mixing.plan_mix(df, targets))
    got = {r.source: r.t for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert got["b"] == 15_000 and 14_999 <= got["a"] <= 15_000


def test_first_fit():
    rng = random.Random(2)
    for _ in range(200):
        sizes, room = np.array([rng.choice([0, 1, 3, 7, 50]) for _ in range(30)]), rng.randint(0, 120)
        left, want = room, []
        for n in sizes:
            want.append(n <= left)
            left -= n * want[-1]
        got = mixing.first_fit(sizes, room)
        assert sizes[want].sum() <= sizes[got].sum() <= room
        if left < 1 or all(want):
            assert got.tolist() == want
    assert mixing.first_fit(np.array([], int), 5).tolist() == []
    assert mixing.first_fit(np.array([60, 90, 30]), 100).tolist() == [False, True, False] or mixing.first_fit(np.array([60, 90, 30]), 100).tolist() == [True, False, True]
    assert mixing.first_fit(np.array([60, 95]), 100).tolist() == [False, True]

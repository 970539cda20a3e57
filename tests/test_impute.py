import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import impute as M


def build(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, g string, hint int, k string, __extra string")


def fields():
    near = lambda other: lambda w: [F.coalesce(F.col("hint"), F.lit(0)), F.when(F.col("hint").isNull(), 1).otherwise(0), w[other]]
    x = M.NumericField("x", F.col("x").between(-1000, 1000), F.col("hint").isNotNull(), near("y"), F.coalesce(F.col("hint"), F.lit(0)), -1000, 1000)
    y = M.NumericField("y", F.col("y").between(-1000, 1000), F.lit(True), near("x"), F.lit(0.0), -1000, 1000)
    g = M.CategoryField(
        "g", F.when(F.col("g").isin("a", "b", "c"), F.col("g")), F.lit(True), {"k": F.col("k"), "hint": F.col("hint")},
        [["k", "hint"], ["k"]], "x", [0.0],
    )
    return [x, y], g


def sample(n=1500, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        hint = rng.randint(-40, 40)
        g = "a" if rng.random() < 0.4 else rng.choice("bc")
        x = hint + {"a": 0, "b": 5, "c": -5}[g] + rng.choice([0, 0, 0, 1, -1])
        y = 2 * x + rng.choice([0, 1])
        truth[i] = (float(x), float(y), g)
        hide = rng.random()
        rows.append(
            (
                i, None if hide < 0.05 else 99999.0 if hide < 0.08 else float(x),
                None if 0.06 < hide < 0.1 else float(y), rng.choice([None, "?"]) if 0.1 < hide < 0.15 else g,
                None if 0.2 < hide < 0.22 else hint, "k" + g, "e",
            )
        )
    return rows, truth


def test_marks_and_values(spark):
    rows, truth = sample()
    df = build(spark, rows).repartition(4)
    out = {r.id: r for r in M.impute(df, *fields()).collect()}
    assert len(out) == len(rows)
    errors = []
    for i, x, y, g, hint, _, _ in rows:
        r = out[i]
        bad_x, bad_y, bad_g = x is None or abs(x) > 1000, y is None, g not in ("a", "b", "c")
        assert (r.x_filled, r.y_filled, r.g_filled) == (bad_x and hint is not None, bad_y, bad_g)
        if not r.x_filled:
            assert r.x == x
        else:
            errors.append(abs(r.x - truth[i][0]))
        if not bad_y:
            assert r.y == y
        assert r.g == (truth[i][2] if bad_g else g)
    assert sorted(errors)[len(errors) // 2] <= 2 and len(errors) > 50


def test_same_rows_same_fills_and_residual_variation(spark):
    rows, _ = sample(800, 3)
    twice = M.impute(build(spark, rows + rows).repartition(5), *fields()).groupBy("id").agg(F.count_distinct("x").alias("n"), F.count(F.lit(1)).alias("m"))
    assert twice.where("n > 1 or m <> 2").count() == 0


def test_fields_with_different_numbers_of_predictors(spark):
    (x, y), g = fields()
    rows, truth = sample(900, 5)
    for first in (True, False):
        # The second predictor of x is what matters; y has one predictor only.
        y1 = M.NumericField("y", y.usable, y.fill, lambda w: [w["x"]], y.start, -1000, 1000, [])
        x2 = M.NumericField("x", x.usable, x.fill, lambda w: [F.lit(0), F.coalesce(F.col("hint"), F.lit(0))], x.start, -1000, 1000, ["hint"])
        out = {r.id: r for r in M.impute(build(spark, rows).repartition(3), [y1, x2] if first else [x2, y1], g).collect()}
        errors = sorted(abs(out[i].x - truth[i][0]) for i in out if out[i].x_filled)
        assert errors[len(errors) // 2] <= 3 and len(errors) > 30


def test_rows_without_evidence_take_a_donor(spark):
    rows, _ = sample(600, 6)
    blank = [(10_000 + i, 1.0 + i, 2.0, None, None, None, "e") for i in range(300)]
    out = [r.g for r in M.impute(build(spark, rows + blank), *fields()).where("id >= 10000").collect()]
    assert set(out) == {"a", "b", "c"} and out.count("a") >= max(out.count("b"), out.count("c"))


def test_edges(spark):
    empty = build(spark, [])
    assert M.impute(empty, *fields()).count() == 0
    none = build(spark, [(1, None, None, None, 3, None, "e"), (2, None, 1.0, None, None, "q", "e")])
    got = {r.id: r for r in M.impute(none, *fields(), rounds=1).collect()}
    assert got[1].x_filled and got[1].y_filled and got[1].g is None and got[1].g_filled and not got[2].x_filled and got[2].x is None
    clash = build(spark, []).withColumn("X_filled", F.lit(1))
    with pytest.raises(ValueError):
        M.impute(clash, *fields())

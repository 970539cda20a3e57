import random

from tallyframe.llm.topn import top_n


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, 1.0, 2.0, 3.5]), rng.choice([None, 1, 2]), i, "x") for i in range(3000)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "g string, score double, f int, id long, extra string").repartition(7)
    got = {}
    for r in top_n(df, ["g"], "score", ["f", "id"], 4, ["extra"]).collect():
        got.setdefault(r.g, []).append((r.rank_no, r.score, r.f, r.id))
    last = lambda v, up: (v is None, 0 if v is None else v if up else -v)
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (last(r[1], False), last(r[2], True), r[3]))[:4]
        assert sorted(got[g]) == [(i + 1, r[1], r[2], r[3]) for i, r in enumerate(best)]


def test_empty_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 5)], "g string, s double, id long")
    assert [tuple(r) for r in top_n(df, ["g"], "s", ["id"], 5).collect()] == [("a", 1.0, 5, 1)]
    assert top_n(df.where("false"), ["g"], "s", ["id"], 5).count() == 0

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import FrameManager
from tallyframe.operators import aggregate as A
from tallyframe.operators import binning as B
from tallyframe.operators import ml, sampling, stats, transform
from tallyframe.operators import missing as N
from tallyframe.operators import relational as R
from tallyframe.plans import sqlfront
from tallyframe.schema import factor_counts, factors, set_as_factor, string_columns_as_factors
from tallyframe.sources import infer


@pytest.fixture()
def m(spark, tmp_path):
    return FrameManager(spark, warehouse=f"file://{tmp_path}/frames")


@pytest.fixture()
def flights(spark):
    rows = [(1, 2008, "WN", 10.0), (2, 2008, "WN", None), (3, 2009, "AA", 5.0), (4, None, None, 7.0), (5, 2010, "AA", -3.0)]
    return spark.createDataFrame(rows, "id int, Year int, Carrier string, Delay double")


@pytest.fixture()
def years(spark):
    return spark.createDataFrame([(2008, "Rat"), (2008, "Mouse"), (2011, "Rabbit"), (None, "None")], "Year_num int, Name string")


def test_joins(flights, years):
    count = lambda how: R.join(flights, years, how, by_left=["Year"], by_right=["Year_num"]).count()
    assert [count(h) for h in (None, "left", "right", "full", "left semi")] == [4, 7, 6, 9, 2]
    same = R.join(flights, flights, "inner", ["id"])
    assert same.columns == ["id", "Year", "Carrier", "Delay", "id_right", "Year_right", "Carrier_right", "Delay_right"]
    with pytest.raises(ValueError):
        R.join(flights, years, "cross", ["Year"])
    with pytest.raises(ValueError):
        R.merge(flights, years)
    assert R.merge(flights, flights).count() == 10


def test_sql_dialect(m, flights, years):
    f, _ = m.new_frame(flights, "flights"), m.new_frame(years, "years")
    assert m.sql2frame("select * from flights join years on (Year = Year_num)").column_names == flights.columns
    assert m.sql("SELECT id FROM flights WHERE Year = 2008 OR Carrier = 'AA' AND Delay < 0 ORDER BY id") == ["1", "2", "5"]
    assert m.sql("select Carrier, count(*) as n, sum(Delay) as s from flights where Carrier.isNotNull group by Carrier order by n desc, Carrier limit 1") == ["AA\t2\t2.0"]
    assert f.sql("select max(Delay) as hi from @this").df.first().hi == 10.0
    assert m.sql("select id from flights limit 0") == []
    assert len(m.sql("select id from flights", max_rows=2)) == 2
    got = m.sql2frame(
        "select id, Name from flights join years on (flights.Year = years.Year_num && Year === Year_num) where Name == 'Rat' order by id",
        names=["a", "b"],
    )
    assert [tuple(r) for r in got.df.collect()] == [(1, "Rat"), (2, "Rat")]
    for bad in (
        "select a from b, c",
        "select * from flights order by id",
        "select id from flights order by Year",
        "select id from flights group by Year",
        "selec id from flights",
        "select id from",
        "select id from flights where",
        "select id from flights limit x",
    ):
        with pytest.raises(ValueError):
            m.sql2frame(bad)
    with pytest.raises(KeyError):
        m.sql2frame("select a from nowhere")


def test_sql_statements_parse():
    s = sqlfront.parse("SELECT sum(a) as suma, b FROM e GROUP BY suma, b")
    assert s.groups == ["suma", "b"] and s.items[0] == ("sum(a)", "suma")
    load = sqlfront.parse("LOAD 'file:///x/persons' delimited by ';' WITH NULL 'NA' WITH EMPTY '-' NO DEFAULTS into person")
    assert load == sqlfront.Load("file:///x/persons", "person", ";", "NA", "-", False)
    assert sqlfront.parse("create table person (a VARCHAR, b INT)") == sqlfront.Create("person", "a VARCHAR, b INT")
    assert sqlfront.expression("a && 'x && y' || b.isNull") == "a  AND  'x && y'  OR  (b IS NULL)"


def test_create_and_load(m, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('2008,1.5,"a, b",NA\r\nNA,x,,true\n20.9,-.5,q,FALSE\n')
    assert m.sql("create table t (y int, d double, s string, b boolean)") == ["0"]
    assert m.get("t").num_rows == 0
    m.sql(f"load '{p}' into t")
    rows = m.get("t").df.collect()
    assert [r.y for r in rows] == [2008, 0, 20] and [r.d for r in rows] == [1.5, 0.0, -0.5] and [r.b for r in rows] == [False, True, False]
    m.sql(f"load '{p}' no defaults into t")
    rows = m.get("t").df.collect()
    assert [r.y for r in rows] == [2008, None, 20] and [r.d for r in rows] == [1.5, None, -0.5] and rows[0].s == "a, b"


def test_load_file_infers(m, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("1,1.5,true,NA,x\n-2,NA,F,,7\n3,2,t,,y\n")
    f = m.load_file(str(p))
    assert f.column_names == ["V1", "V2", "V3", "V4", "V5"]
    assert [t for _, t in f.df.dtypes] == ["int", "double", "boolean", "string", "string"]
    assert [r.V1 for r in f.df.collect()] == [1, -2, 3]


def test_determine_type():
    d = infer.determine_type
    assert d(["1", "-2", None, " ", "NAN"]) == T.IntegerType()
    assert d(["1.5", "2"]) == T.DoubleType() and d(["1.5"], prefer_double=False) == T.FloatType()
    assert d(["T", "false"]) == T.BooleanType() and d(["NA", ""]) == T.StringType() and d(["1", "x"]) == T.StringType()
    assert d(["1,234"]) == T.IntegerType()


def test_aggregates(flights):
    rows = A.group_by(flights, ["Carrier"], ["m=avg(Delay)", "count(id)"]).collect()
    assert {r.Carrier: (r.m, r.COUNT_id) for r in rows} == {"WN": (10.0, 1.0), "AA": (1.0, 2.0)}
    assert A.aggregate_map(flights, "Year, Carrier, sum(Delay)") == {"2008,WN": [10.0], "2009,AA": [5.0], "2010,AA": [-3.0]}
    assert A.aggregate_on_column(flights, "max", "Delay").first()[0] == 10.0
    for bad in (
        lambda: A.Grouped(flights, None).agg(["sum(id)"]), lambda: A.group_by(flights, ["Year"], ["median(id)"]),
        lambda: A.group_by(flights, [], ["sum(id)"]),
    ):
        with pytest.raises(ValueError):
            bad()


def test_statistics(spark, flights):
    s = {r.column_name: r for r in stats.summary(flights).collect()}
    assert s["Delay"].n == 4 and s["Delay"].n_null == 1 and math.isclose(s["Delay"].mean, 4.75)
    empty = flights.where("false")
    assert stats.summary(empty).first().n == 0
    assert stats.histogram(empty, "Delay", 3).count() == 0
    v = spark.createDataFrame([(float(x),) for x in [-24, -10, 0, 3, 18, 20, 40, 80]] + [(None,)], "v double")
    h = [(round(r.x, 6), r.y) for r in stats.histogram(v, "v", 5).orderBy("x").collect()]
    assert h == [(-24.0, 2), (-3.2, 2), (17.6, 2), (38.4, 1), (80.0, 1)]
    even = [(round(r.x, 6), r.y) for r in stats.histogram(v, "v", 5, even=True).orderBy("x").collect()]
    assert even == [(-24.0, 2), (-3.2, 2), (17.6, 2), (38.4, 1), (59.2, 1)]
    assert [r.value for r in stats.quantiles(flights, "Year", [0.0, 0.5, 1.0]).orderBy("prob").collect()] == [2008.0, 2008.0, 2010.0]
    with pytest.raises(ValueError):
        stats.mean(flights, "Carrier")
    assert stats.variance(flights, "Carrier").first().variance is None
    with pytest.raises(ValueError):
        stats.histogram(spark.createDataFrame([(float("inf"),)], "v double"), "v", 2)


def test_binning(spark):
    df = spark.createDataFrame([(i,) for i in [1, 1, 2, 6, 6, 7, 11]], "m int")
    count = lambda **kw: {r.m: r["count"] for r in B.binning(df, "m", "EQUALINTERVAL", 2, **kw).groupBy("m").count().collect()}
    assert count() == {"[1,6]": 5, "(6,11]": 2}
    assert count(right=False) == {"[1,6)": 3, "[6,11)": 3}
    assert count(include_lowest=False) == {"(1,6]": 3, "(6,11]": 2}
    assert count(include_lowest=False, right=False) == {"(1,6)": 1, "(6,11)": 1}
    out = B.binning(df, "m", "CUSTOM", breaks=[2, 4, 6, 8])
    assert factors(out) == ["m"] and out.count() == 4
    assert B.binning(df.where("m = 6"), "m", "EQUALFREQ", 3).first().m == "[6,6]"
    assert B.binning(df.where("false"), "m", "EQUALINTERVAL", 3).count() == 0
    for bad in ({"kind": "CUSTOM", "breaks": [3, 1]}, {"kind": "CUSTOM"}, {"kind": "EQUALFREQ", "bins": 1}, {"kind": "X", "bins": 3}):
        with pytest.raises(ValueError):
            B.binning(df, "m", **bad)
    assert B.bound_text(2.005) in ("2", "2.0", "2.01") and B.bound_text(6.5) == "6.5" and B.bound_text(-0.001) == "0"


def test_missing(flights):
    assert N.drop_na(flights).count() == 3
    assert N.drop_na(flights, how="all", columns=["Year", "Carrier"]).count() == 4
    assert N.drop_na(flights, thresh=3).count() == 4
    assert N.drop_na(flights, "column").columns == ["id"]
    assert N.drop_na(flights, "column", thresh=4).columns == flights.columns
    assert N.fill_na(flights, "0").where("Delay = 0 or Year = 0 or Carrier = '0'").count() == 2
    assert N.fill_na(flights, values={"Carrier": "?"}).where("Carrier = '?'").count() == 1
    assert N.fill_na(flights, fn="mean", columns=["Delay", "Carrier"]).where("id = 2").first().Delay == 4.75
    for bad in (lambda: N.fill_na(flights), lambda: N.drop_na(flights, thresh=9), lambda: N.drop_na(flights, how="some"), lambda: N.fill_na(flights, fn="median")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        N.fill_na(flights, method="ffill")


def test_factors(m, flights):
    f = m.new_frame(flights).set_as_factor("Carrier").set_as_factor(1)
    assert f.factor_counts() == {"Year": {"2008": 2, "2009": 1, "2010": 1}, "Carrier": {"WN": 2, "AA": 2}}
    assert f.level_map("Carrier") == {"AA": 1, "WN": 2}
    assert factors(f.project("Carrier", "id").df) == ["Carrier"] and factors(f.copy().df) == ["Year", "Carrier"]
    assert factors(string_columns_as_factors(flights)) == ["Carrier"]
    with pytest.raises(ValueError):
        factor_counts(flights)
    s = stats.simple_summary(set_as_factor(flights, "Carrier")).collect()
    assert {r.level for r in s if r.column_name == "Carrier"} == {"WN", "AA"}


def test_sampling_and_folds(spark, flights):
    assert sampling.sample_rows(flights, 3, seed=1).count() == 3
    assert sampling.sample_rows(flights, 12, replace=True, seed=1).count() == 12
    with pytest.raises(ValueError):
        sampling.sample_fraction(flights, 1.5)
    big = spark.range(1000).toDF("id")
    folds = sampling.cv_kfold(big, 4, 1)
    assert sum(t.count() for _, t in folds) == 1000 and all(a.count() + b.count() == 1000 for a, b in folds)
    for a, b in sampling.cv_random(big, 2, 0.8, 3):
        assert a.count() + b.count() == 1000 and 730 < a.count() < 870


def test_transforms(flights):
    t = transform.transform_expr(flights, "twice = Delay * 2")
    assert t.columns[-1] == "twice" and t.where("id = 1").first().twice == 20.0
    rows = flights.where("Carrier is not null").select("Carrier", "id")
    mapped = lambda b: b.rename(columns={"Carrier": "key", "id": "val"})
    for reduce in ("sum", lambda key, vals: int(vals.sum())):
        got = transform.map_reduce(rows, mapped, reduce, "bigint")
        assert got.dtypes == [("key", "string"), ("val", "bigint")]
        assert {r.key: r.val for r in got.collect()} == {"WN": 3, "AA": 8}
    s = transform.scale_minmax(flights.select("id", "Delay"))
    assert s.agg(F.min("Delay"), F.max("id")).first() == (0.0, 1.0)
    z = transform.scale_standard(flights.select("Delay"))
    assert abs(z.agg(F.avg("Delay")).first()[0]) < 1e-12


def test_models(spark):
    line = spark.createDataFrame([(2.0 * x + 1, float(x), None if x == 3 else 1.0 * x * x) for x in range(20)], "y double, a double, b double")
    model = ml.train(line, "mlr")
    out = model.transform(line, has_labels=True, include_features=False)
    assert out.columns == ["y", "yPredict"] and out.where("abs(y - yPredict) > 0.1").count() == 0
    svm = ml.train(spark.createDataFrame([(1 if x > 5 else -1, float(x)) for x in range(12)], "label int, x double"), "svm")
    got = svm.transform(spark.createDataFrame([(1, 11.0), (-1, 0.0)], "label int, x double"))
    assert [r.yPredict for r in got.collect()] == [1.0, -1.0]
    km = ml.train(spark.createDataFrame([(0.0,), (0.1,), (9.0,), (9.1,)], "x double"), "kmeans", clusters=2)
    assert len({r.yPredict for r in km.transform(spark.createDataFrame([(0.0,), (9.0,)], "x double")).collect()}) == 2
    given = ml.train(spark.createDataFrame([(0.0,), (0.2,), (9.0,), (9.2,), (None,)], "x double"), "kmeans", clusters=3, centroids=[[1.0], [8.0], [50.0]])
    assert [[round(v, 6) for v in c] for c in given.raw.centres] == [[0.1], [9.1], [50.0]]
    curve = ml.roc(spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.85)], "t int, s double"), "t", "s", 10).collect()
    assert (curve[0].tpr, curve[0].fpr) == (1.0, 1.0) and curve[-1].tpr == 0.5 and curve[-1].fpr == 0.0
    with pytest.raises(ValueError):
        ml.train(line, "forest")
    c = ml.confusion(spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 1.0), (0, 0.0), (None, 1.0)], "t int, p double"), "t", "p").first()
    assert tuple(c) == (1, 1, 1, 1)


def test_manager(m, flights):
    f = m.new_frame(flights, "first")
    assert m.get("first") is f and "first" in m.list_frames()
    m.rename(f, "second")
    assert m.list_frames() == ["second"] and m.get("second").num_columns == 4
    m.persist(f, "ns")
    assert m.list_namespaces() == ["ns"] and m.list_items("ns") == ["second"]
    assert m.load_persisted("second", "ns").num_rows == 5
    assert m.unpersist("second", "ns") and m.list_items("ns") == []
    with pytest.raises(NotImplementedError):
        m.copy_from("x")
    with pytest.raises(KeyError):
        m.get("third")
    f.set_mutable(True)
    f.drop_na()
    assert f.num_rows == 3
    g = m.new_frame(flights)
    assert g.drop_na() is not g and g.num_rows == 5
    assert g.top(1, "Delay")[0].id == 1 and g.remove_column("Delay").num_columns == 3
    with pytest.raises(NotImplementedError):
        g.subset(["id"], "grep('x', Carrier)")


def test_command_line(spark, tmp_path, capsys):
    from tallyframe.__main__ import main

    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert main(["-p", f"nums={tmp_path}/t", "select count(*) as n from nums"]) == 0
    assert capsys.readouterr().out.strip() == "3"
    assert main(["select x from"]) == 1


def test_entry_has_every_problem_of_the_core():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"p2_found", "p3_found", "p5_found", "p6_found", "p7_found"} <= names
    assert set(entry.oracle_sql()) <= names


def test_load_file_quotes_thousands_and_header(m, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('name,n,share\n"a,b","1,234",0.5\nname,n,share\n"c ""d""",-12,1.25\n')
    rows = [tuple(r) for r in m.load_file(str(p), has_header=True).df.collect()]
    assert rows[0] == ("a,b", "1,234", "0.5") and rows[1] == ("name", "n", "share")  # a data row like the header stays
    p.write_text('"a,b","1,234",0.5\nx,"2,345,678",1.25\n')
    assert [tuple(r) for r in m.load_file(str(p)).df.collect()] == [("a,b", 1234, 0.5), ("x", 2345678, 1.25)]
    p.write_text("1,234;x\n7;y\n")
    assert [tuple(r) for r in m.load_file(str(p), sep=";").df.collect()] == [(1234, "x"), (7, "y")]


def test_no_row_is_cut_off_silently(m, spark):
    m.new_frame(spark.range(2500).toDF("id"), "many")
    assert len(m.sql("select id from many")) == len(m.sql_typed("select id from many")) == 2500
    assert len(m.sql_typed("select id from many", 3)) == 3


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 as k")
    for draw in (
        lambda d: sampling.sample_rows(d, 50, seed=3), lambda d: sampling.sample_rows(d, 5000, True, 3), lambda d: sampling.sample_rows(d, 40, True, 3),
        lambda d: sampling.sample_fraction(d, 0.1, seed=3), lambda d: sampling.sample_fraction(d, 0.5, True, 3),
    ):
        a, b = (sorted(map(tuple, draw(df.repartition(n)).collect())) for n in (1, 7))
        assert a == b
    assert sampling.sample_rows(df, 5000, True, 3).count() == 5000
    assert 200 < sampling.sample_fraction(df, 0.1, seed=3).count() < 400
    assert 1300 < sampling.sample_fraction(df, 0.5, True, 3).count() < 1700


def test_exact_quantiles_by_ranges(spark):
    from tallyframe.operators.order_stats import exact_quantiles

    df = spark.range(1001).selectExpr("cast(id * id % 997 as int) as a", "case when id % 3 = 0 then id / 7 end as b", "cast(null as int) as c").repartition(5)
    probs = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    want = df.selectExpr(*[f"percentile({c}, array({', '.join(map(str, probs))})) as {c}" for c in "abc"]).first()
    assert got[0] == pytest.approx(want.a) and got[1] == pytest.approx(want.b) and got[2] == [None] * 6
    assert exact_quantiles(df.where("false"), ["a"], [0.5]) == [[None]]


def test_qualified_columns(m, flights, years):
    m.new_frame(flights.select("id", "Year"), "f1")
    m.new_frame(flights.select("id", "Year"), "f2")
    got = m.sql_typed("select f1.id, f2.Year as y from f1 join f2 on (f1.id = f2.id) where f2.Year > 0 && f1.id >= 0")
    plain = m.sql_typed("select id, Year as y from f1 where Year > 0 and id >= 0")
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and got


def test_plus_plus(spark):
    df = spark.createDataFrame([(float(i % 3) * 100 + i % 2, float(i % 3)) for i in range(90)], "x double, y double")
    from tallyframe.operators import ml

    centres = ml.plus_plus(df, 3, seed=5)
    assert sorted(round(c[0] / 100) for c in centres) == [0, 1, 2]
    assert len(ml.plus_plus(df.limit(1), 3)) == 1
    assert len({r.yPredict for r in ml.k_means(df, 3, init="k-means++").transform(df).collect()}) == 3

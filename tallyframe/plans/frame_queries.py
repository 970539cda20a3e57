"""Registered queries of loading, catalog, persistence, samples, folds and models, each with the SQL that its result must equal.

Where an operator's rows are random or need no table, the query reports what the operator promises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.manager import FrameManager
from tallyframe.operators import ml, relational, sampling, transform
from tallyframe.session import shared_dir
from tallyframe.sources import infer

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(names: str, values: list[tuple]) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values) + f") t({names})"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- loading ---------------------------------------------------------------------------------------------------------


def _as_file(spark: SparkSession, df: DataFrame, **options) -> str:
    path = scratch(spark, "csv")
    df.write.options(**{"escape": '"', "emptyValue": "", **options}).csv(path)
    return path


@query("src_load_file", "SELECT s_suppkey AS V1, s_name AS V2, s_nationkey AS V3, s_acctbal AS V4 FROM supplier")
def src_load_file(spark, d):
    """A table written as text and loaded with inferred types."""
    path = _as_file(spark, table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
    out = FrameManager(spark).load_file(path).df
    return out.select(*[F.col(c).cast("bigint") if c in ("V1", "V3") else F.col(c) for c in out.columns])


@query("src_load_header", "SELECT n_nationkey, n_name FROM nation")
def src_load_header(spark, d):
    path = _as_file(spark, table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), header=True)
    return FrameManager(spark).load_file(path, has_header=True).df


@query("src_load_into", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def src_load_into(spark, d):
    """CREATE TABLE, then LOAD ... INTO the declared schema."""
    path = _as_file(spark, table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), sep="|")
    m = FrameManager(spark)
    m.sql("CREATE TABLE loaded (o_orderkey bigint, o_orderstatus string, o_totalprice double)")
    m.sql(f"LOAD '{path}' DELIMITED BY '|' INTO loaded")
    return m.get("loaded").df


_CREATED = [(0, "Year", "int"), (1, "Name", "string"), (2, "Share", "double"), (3, "Known", "boolean"), (4, "At", "timestamp"), (5, "Big", "bigint")]


@query("sql_create_table", values_sql("no, name, type", _CREATED))
def sql_create_table(spark, d):
    m = FrameManager(spark)
    m.sql("CREATE TABLE made (Year int, Name varchar, Share double, Known bool, At date, Big long)")
    return rows(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(m.get("made").df.schema)], "no int, name string, type string")


_INFERRED = [("1", "2", "int"), ("1", "2.5", "double"), ("1,234", "-5", "int"), ("true", "F", "boolean"), ("a", "1", "string"), ("NA", "7", "int"), ("NA", "", "string")]


@query("src_determine_type", values_sql("a, b, type", _INFERRED))
def src_determine_type(spark, d):
    return rows(spark, [(a, b, infer.determine_type([a, b]).simpleString()) for a, b, _ in _INFERRED], "a string, b string, type string")


@query("src_column_info", values_sql("no, name, type", [(0, "V1", "int"), (1, "V2", "string"), (2, "V3", "double")]))
def src_column_info(spark, d):
    got = infer.column_info([["1", "a", "2.0"], ["3", "b"]])
    return rows(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(got)], "no int, name string, type string")


@query("src_typed_cells", "SELECT row_id, CAST(ArrDelay AS BIGINT) AS whole, CASE WHEN ArrDelay IS NULL THEN 0 ELSE CAST(ArrDelay AS INTEGER) END AS defaulted, Cancelled = 1 AS flag FROM airline")
def src_typed_cells(spark, d):
    t = table(spark, d, "airline").select("row_id", F.col("ArrDelay").cast("string").alias("a"), F.when(F.col("Cancelled").isNotNull(), F.when(F.col("Cancelled") == 1, "TRUE").otherwise("false")).alias("c"))
    kinds = S.parse_columns("a bigint, b int, c bool")
    return t.select(
        "row_id", infer.cell(F.col("a"), kinds["a"].dataType, False).alias("whole"), infer.cell(F.col("a"), kinds["b"].dataType, True).alias("defaulted"),
        infer.cell(F.col("c"), kinds["c"].dataType, False).alias("flag"),
    )


# --- catalog, persistence, SQL entry points --------------------------------------------------------------------------


@query("cat_names", values_sql("step, names", [(1, "a,b"), (2, "b,c"), (3, "b,c")]))
def cat_names(spark, d):
    """Frames registered, one renamed, one copied without a name of its own; copying from elsewhere is refused."""
    m = FrameManager(spark)
    nation = table(spark, d, "nation")
    a, _ = m.new_frame(nation, "a"), m.new_frame(nation, "b")
    steps = [(1, ",".join(m.list_frames()))]
    m.rename(a, "c")
    steps.append((2, ",".join(m.list_frames())))
    m.get("c").copy()
    try:
        m.copy_from(None)
    except NotImplementedError:
        steps.append((3, ",".join(m.list_frames())))
    return rows(spark, steps, "step int, names string")


@query("cat_persist", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def cat_persist(spark, d):
    m = FrameManager(spark, scratch(spark, "frames"))
    m.persist(m.new_frame(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "kept"), "space")
    return m.load_persisted("kept", "space").df


@query("cat_listings", values_sql("step, spaces, items", [(1, "s1,s2", "a,b"), (2, "s1,s2", "b")]))
def cat_listings(spark, d):
    m = FrameManager(spark, scratch(spark, "frames"))
    f = m.new_frame(table(spark, d, "region"), "a")
    for space, name in (("s1", "a"), ("s1", "b"), ("s2", "x")):
        m.persist(f, space, name)
    out = [(1, ",".join(m.list_namespaces()), ",".join(m.list_items("s1")))]
    m.unpersist("a", "s1")
    out.append((2, ",".join(m.list_namespaces()), ",".join(m.list_items("s1"))))
    return rows(spark, out, "step int, spaces string, items string")


@query("cat_schema", values_sql("name, place, type, columns, n", [("n_name", 1, "string", 4, 25)]))
def cat_schema(spark, d):
    f = FrameManager(spark).new_frame(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("").alias("note")))
    return rows(spark, [("n_name", f.column_index("n_name"), f.column("n_name").dataType.simpleString(), f.num_columns, f.num_rows)], "name string, place int, type string, columns int, n int")


@query("sql_named", "SELECT r_regionkey AS k, r_name AS label FROM region")
def sql_named(spark, d):
    m = FrameManager(spark)
    m.read_parquet(f"{d}/region.parquet", "region")
    return m.sql2frame("SELECT r_regionkey, r_name FROM region", names=["k", "label"]).df


@query("sql_max_rows", "SELECT CAST(r_regionkey AS VARCHAR) || chr(9) || r_name AS line FROM region ORDER BY r_regionkey LIMIT 3")
def sql_max_rows(spark, d):
    m = FrameManager(spark)
    m.read_parquet(f"{d}/region.parquet", "region")
    return rows(spark, [(x,) for x in m.sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey", 3)], "line string")


@query("sql_typed", "SELECT r_regionkey AS k, r_name AS name FROM region")
def sql_typed(spark, d):
    m = FrameManager(spark)
    m.read_parquet(f"{d}/region.parquet", "region")
    return spark.createDataFrame(m.sql_typed("SELECT r_regionkey AS k, r_name AS name FROM region"))


@query("sql_refused", values_sql("no, refused", [(0, True), (1, True), (2, True), (3, True), (4, True)]))
def sql_refused(spark, d):
    """A comma in FROM, fills and filters that aren't supported, and bad statements are errors, not wrong results."""
    m = FrameManager(spark)
    f = m.read_parquet(f"{d}/region.parquet", "region")
    out = []
    for i, act in enumerate([
        lambda: m.sql("SELECT r_name FROM region, nation"), lambda: f.fill_na(method="ffill"), lambda: m.sql("SELECT r_name FROM region ORDER BY r_regionkey"),
        lambda: f.subset(["r_name"], "grep('A', r_name)"), lambda: m.sql("SELECT FROM region"),
    ]):
        try:
            act()
            out.append((i, False))
        except (ValueError, NotImplementedError):
            out.append((i, True))
    return rows(spark, out, "no int, refused boolean")


@query("sql_qualified", "SELECT o.o_orderkey, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 AND o.o_totalprice > 1000")
def sql_qualified(spark, d):
    m = FrameManager(spark)
    for t in ("orders", "customer"):
        m.read_parquet(f"{d}/{t}.parquet", t)
    return m.sql2frame("SELECT orders.o_orderkey, customer.c_name AS name FROM orders JOIN customer ON (orders.o_custkey = customer.c_custkey) WHERE customer.c_acctbal > 0 AND orders.o_totalprice > 1000").df


@query("view_mutable", values_sql("in_place, n_columns, known", [(False, 2, False), (True, 1, True)]))
def view_mutable(spark, d):
    out = []
    for on in (False, True):
        f = FrameManager(spark).new_frame(table(spark, d, "nation").select("n_nationkey", "n_name")).set_mutable(on)
        g = f.remove_columns("n_name")
        out.append((on, f.num_columns, g is f))
    return rows(spark, out, "in_place boolean, n_columns int, known boolean")


# --- factors ---------------------------------------------------------------------------------------------------------


@query("factor_levels", "SELECT event_type AS level, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS no FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")
def factor_levels(spark, d):
    f = FrameManager(spark).read_parquet(f"{d}/events.parquet").set_as_factor("event_type")
    return rows(spark, list(f.level_map("event_type").items()), "level string, no int")


@query("factor_marks", values_sql("step, names", [("all texts", "n_name"), ("after a view", "n_name"), ("none", "")]))
def factor_marks(spark, d):
    """Text columns become factors, and stay so in frames made from theirs."""
    f = FrameManager(spark).new_frame(table(spark, d, "nation").select("n_nationkey", "n_name"))
    none = ",".join(S.factors(f.df))
    f.string_columns_as_factors()
    view = f.subset(["n_name", "n_nationkey"], "n_nationkey > 3")
    return rows(spark, [("all texts", ",".join(S.factors(f.df))), ("after a view", ",".join(S.factors(view.df))), ("none", none)], "step string, names string")


# --- transforms ------------------------------------------------------------------------------------------------------


@query("transform_batches", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders")
def transform_batches(spark, d):
    f = FrameManager(spark).new_frame(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    out = f.transform_batches(lambda b: b.assign(twice=b["o_totalprice"] * 2)[["o_orderkey", "twice"]], "o_orderkey bigint, twice double").df
    return out.withColumn("twice", F.round("twice", 4))


@query("transform_reduce_code", "SELECT CAST(Month AS VARCHAR) AS key, CAST(max(DayofMonth) - 0 AS BIGINT) AS val FROM airline WHERE Month IS NOT NULL AND DayofMonth IS NOT NULL GROUP BY Month")
def transform_reduce_code(spark, d):
    """Map/reduce with a Python function, applied before and after the shuffle."""
    t = table(spark, d, "airline").select("Month", "DayofMonth").dropna()
    return transform.map_reduce(t, lambda b: b.rename(columns={"Month": "key", "DayofMonth": "val"}), lambda k, v: v.max(), "bigint")


# --- samples and folds -----------------------------------------------------------------------------------------------


@query("sample_exact", "SELECT 100 AS n, 100 AS n_distinct, true AS all_known, true AS same_again, true AS repeats")
def sample_exact(spark, d):
    """Exactly n rows of the table, the same ones however it is partitioned; with replacement some come more than once."""
    events = table(spark, d, "events").select("event_id")
    a, b = sampling.sample_rows(events, 100, seed=7), sampling.sample_rows(events.repartition(7), 100, seed=7)
    again = sampling.sample_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("event_id")), 100, True, 7)  # more draws than rows
    n = a.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("event_id").cast("int").alias("n_distinct")).first()
    more = again.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("k")).first()
    known = a.join(events, "event_id", "left_semi").count() == n.n
    return rows(spark, [(n.n, n.n_distinct, known, relational.merge(a.exceptAll(b), b.exceptAll(a)).isEmpty(), more.n == 100 and more.k < 100)], "n int, n_distinct int, all_known boolean, same_again boolean, repeats boolean")


@query("sample_shares", "SELECT share, true AS near, true AS all_known FROM (VALUES (0.1), (0.5)) t(share)")
def sample_shares(spark, d):
    """Draws without (Bernoulli) replacement hold about their share; none invents rows."""
    e = table(spark, d, "events").select("event_id")
    total, out = e.count(), []
    for share in (0.1, 0.5):
        parts = [sampling.sample_fraction(e, share, replace, 7) for replace in (False, True)]
        near = all(abs(p.count() - share * total) <= 6 * (share * total) ** 0.5 for p in parts)
        out.append((share, near, parts[0].count() == parts[0].join(e, "event_id", "left_semi").count()))
    return rows(spark, out, "share double, near boolean, all_known boolean")


@query("cv_kfold_whole", "SELECT CAST(i AS INTEGER) AS fold, (SELECT count(*) FROM orders) AS n, true AS disjoint, true AS even FROM range(5) t(i)")
def cv_kfold_whole(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    total, out = o.count(), []
    for i, (train, test) in enumerate(sampling.cv_kfold(o, 5, 3)):
        k = test.count()
        out.append((i, train.count() + k, train.join(test, "o_orderkey").isEmpty(), abs(k - total / 5) < 6 * (total / 5) ** 0.5))
    return rows(spark, out, "fold int, n bigint, disjoint boolean, even boolean")


@query("cv_random_whole", "SELECT CAST(i AS INTEGER) AS split, (SELECT count(*) FROM orders) AS n, true AS disjoint, true AS as_asked FROM range(3) t(i)")
def cv_random_whole(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    total, out = o.count(), []
    for i, (train, test) in enumerate(sampling.cv_random(o, 3, 0.8, 5)):
        k = train.count()
        out.append((i, k + test.count(), train.join(test, "o_orderkey").isEmpty(), abs(k - 0.8 * total) < 6 * (0.2 * total) ** 0.5))
    return rows(spark, out, "split int, n bigint, disjoint boolean, as_asked boolean")


# --- models ----------------------------------------------------------------------------------------------------------


@query("ml_mlr_line", "SELECT l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) OVER () + l_quantity * regr_slope(l_extendedprice, l_quantity) OVER (), 2) AS y FROM lineitem")
def ml_mlr_line(spark, d):
    """Linear regression of price on quantity over all line items, which the normal equations solve as well."""
    t = table(spark, d, "lineitem")
    model = ml.train(t.select("l_extendedprice", "l_quantity"), "mlr")
    return model.transform(t.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).select("l_orderkey", "l_linenumber", F.round("yPredict", 2).alias("y"))


def _lloyd_sql(rounds: int, centres: list[tuple[float, float]]) -> str:
    near = lambda t: f"CASE WHEN pow(a - {t}.ax, 2) + pow(b - {t}.bx, 2) <= pow(a - {t}.ay, 2) + pow(b - {t}.by_, 2) THEN 0 ELSE 1 END"
    (ax, bx), (ay, by) = centres
    out = f"WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) / 1000 AS b FROM lineitem), c0 AS (SELECT {ax}::DOUBLE AS ax, {bx}::DOUBLE AS bx, {ay}::DOUBLE AS ay, {by}::DOUBLE AS by_)"
    for i in range(rounds):
        k = near(f"c{i}")
        out += f", c{i + 1} AS (SELECT avg(a) FILTER (WHERE k = 0) AS ax, avg(b) FILTER (WHERE k = 0) AS bx, avg(a) FILTER (WHERE k = 1) AS ay, avg(b) FILTER (WHERE k = 1) AS by_ FROM (SELECT a, b, {k} AS k FROM p, c{i}))"
    return out + f" SELECT k AS cluster, count(*) AS n FROM (SELECT {near(f'c{rounds}')} AS k FROM p, c{rounds}) GROUP BY k"


@query("ml_kmeans_lloyd", _lloyd_sql(4, [(10.0, 10.0), (40.0, 60.0)]))
def ml_kmeans_lloyd(spark, d):
    """k-means over all line items from given centres, four rounds."""
    t = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"))
    out = ml.train(t, "kmeans", clusters=2, iterations=4, centroids=[[10.0, 10.0], [40.0, 60.0]]).transform(t)
    return out.groupBy(F.col("yPredict").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("ml_kmeans_inits", "SELECT init, 3 AS clusters, true AS better_than_one FROM (VALUES ('random'), ('k-means||'), ('k-means++')) t(init)")
def ml_kmeans_inits(spark, d):
    """All three ways to start: as many clusters as asked, and less spread within them than in all rows together."""
    t = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice").cast("double") / 1000).alias("b"))
    whole = t.agg(F.var_pop("a") + F.var_pop("b")).first()[0]
    out = []
    for init in ("random", "k-means||", "k-means++"):
        done = ml.train(t, "kmeans", clusters=3, iterations=3, init=init).transform(t)
        per = done.groupBy("yPredict").agg(F.count(F.lit(1)).alias("n"), (F.var_pop("a") + F.var_pop("b")).alias("v"))
        r = per.agg(F.count(F.lit(1)).cast("int").alias("k"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).first()
        out.append((init, r.k, r.v < 0.5 * whole))
    return rows(spark, out, "init string, clusters int, better_than_one boolean")


@query("ml_svm_late", "SELECT 2 AS classes, true AS accurate")
def ml_svm_late(spark, d):
    """A linear SVM over all usable flights, late or not by departure delay: at least 85 % right."""
    t = table(spark, d, "airline").where("ArrDelay between -180 and 2880 and DepDelay between -180 and 2880")
    t = t.select(F.when(F.col("ArrDelay") > 15, 1.0).otherwise(-1.0).alias("label"), (F.col("DepDelay") / 60).alias("dep"), (F.col("Distance") / 1000.0).alias("far"))
    out = ml.train(t, "svm", iterations=15).transform(t, has_labels=True)
    r = out.agg(F.count_distinct("yPredict").cast("int").alias("k"), F.avg((F.col("label") == F.col("yPredict")).cast("int")).alias("right")).first()
    return rows(spark, [(r.k, r.right >= 0.85)], "classes int, accurate boolean")


@query("ml_als_fit", "SELECT true AS every_pair, true AS close")
def ml_als_fit(spark, d):
    """ALS over all usable ratings: a prediction for each, closer than the mean rating is."""
    t = table(spark, d, "ratings").where("rating between 0.5 and 5").dropna().select("user_id", "item_id", "rating")
    out = ml.train(t, "als", factors=5, iterations=5, blocks=4).transform(t)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("rating") - F.col("yPredict"), 2)).alias("e"), F.var_pop("rating").alias("v")).first()
    return rows(spark, [(r.n == t.count(), r.e < r.v)], "every_pair boolean, close boolean")


@query(
    "ml_roc_curve",
    "WITH r AS (SELECT ArrDelay > 15 AS late, DepDelay AS s FROM airline WHERE ArrDelay BETWEEN -180 AND 2880 AND DepDelay BETWEEN -180 AND 2880),"
    " m AS (SELECT min(s) AS lo, (max(s) - min(s)) / 20.0 AS w, count(*) FILTER (WHERE late) AS p, count(*) FILTER (WHERE NOT late) AS q FROM r)"
    " SELECT round(lo + i * w, 6) AS threshold, round((SELECT count(*) FILTER (WHERE late) FROM r WHERE least(20, floor((s - lo) / w)) >= i) / p, 6) AS tpr,"
    " round((SELECT count(*) FILTER (WHERE NOT late) FROM r WHERE least(20, floor((s - lo) / w)) >= i) / q, 6) AS fpr FROM m, range(21) t(i)",
)
def ml_roc_curve(spark, d):
    t = table(spark, d, "airline").where("ArrDelay between -180 and 2880 and DepDelay between -180 and 2880").select((F.col("ArrDelay") > 15).cast("int").alias("late"), "DepDelay")
    return ml.roc(t, "late", "DepDelay", 20).select(*[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])

"""Registered queries of the engine's own operators and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.manager import FrameManager
from tallyframe.operators import aggregate as A
from tallyframe.operators import binning as B
from tallyframe.operators import missing as N
from tallyframe.operators import relational as R
from tallyframe.operators import sampling, stats, transform
from tallyframe.schema import factor_counts, set_as_factor

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


def run_sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    m = FrameManager(spark)
    for t in tables:
        m.read_parquet(f"{d}/{t}.parquet", t)
    return m.sql2frame(text).df


def rounded(df: DataFrame, places: int = 4, *columns: str) -> DataFrame:
    cols = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in cols})


def holed(spark: SparkSession, d: str) -> DataFrame:
    """events with nulls made by rule in two columns."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
    )


HOLED = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events"

# --- SQL front end ---------------------------------------------------------------------------------------------------

SQL_TEXTS = {
    "sql_select_star": (
        "SELECT * FROM supplier JOIN nation ON (s_nationkey = n_nationkey)", ["supplier", "nation"],
        "SELECT s.* FROM supplier s JOIN nation ON s_nationkey = n_nationkey",
    ),
    "sql_project": (
        "SELECT c_custkey, c_name AS name, c_nationkey + 1 AS nk FROM customer", ["customer"],
        "SELECT c_custkey, c_name AS name, c_nationkey + 1 AS nk FROM customer",
    ),
    "sql_where": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 && (l_returnflag === 'A' || l_returnflag = 'R')",
        ["lineitem"],
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND (l_returnflag = 'A' OR l_returnflag = 'R')",
    ),
    "sql_where_null": (
        "SELECT row_id, Origin FROM airline WHERE ArrDelay.isNull AND DepDelay.isNotNull", ["airline"],
        "SELECT row_id, Origin FROM airline WHERE ArrDelay IS NULL AND DepDelay IS NOT NULL",
    ),
    "sql_group": (
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(l_tax) AS nt FROM lineitem GROUP BY l_returnflag",
        ["lineitem"],
        "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_tax) AS nt FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_global_agg": (
        "SELECT SUM(l_linenumber) AS s, COUNT(*) AS n, MAX(l_quantity) AS hi FROM lineitem", ["lineitem"],
        "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, max(l_quantity) AS hi FROM lineitem",
    ),
    "sql_order": (
        "SELECT r_name, r_regionkey FROM region ORDER BY r_regionkey DESC", ["region"],
        "SELECT r_name, r_regionkey FROM region ORDER BY r_regionkey DESC",
    ),
    "sql_topk": (
        "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20",
        ["orders"],
        "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "sql_join_where": (
        "SELECT row_id, Name FROM airline LEFT JOIN year_names ON (Year = Year_num) WHERE Year_num > 2008 OR Month = 1 AND Cancelled = 1",
        ["airline", "year_names"],
        "SELECT row_id, Name FROM airline LEFT JOIN year_names ON Year = Year_num WHERE Year_num > 2008 OR (Month = 1 AND Cancelled = 1)",
    ),
    "fn_substr": (
        "SELECT p_partkey, SUBSTRING(p_name, 1, 5) AS head, SUBSTR(p_name, 3) AS rest FROM part", ["part"],
        "SELECT p_partkey, substring(p_name, 1, 5) AS head, substring(p_name, 3) AS rest FROM part",
    ),
    "fn_abs": ("SELECT c_custkey, ABS(c_acctbal) AS bal FROM customer", ["customer"], "SELECT c_custkey, abs(c_acctbal) AS bal FROM customer"),
    "fn_cast": (
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS int) AS q FROM lineitem", ["lineitem"],
        "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem",
    ),
    "fn_arith": (
        "SELECT o_orderkey, o_totalprice * 2 - 1 AS a, o_orderkey % 7 AS b FROM orders WHERE o_orderkey !== 5",
        ["orders"],
        "SELECT o_orderkey, o_totalprice * 2 - 1 AS a, o_orderkey % 7 AS b FROM orders WHERE o_orderkey <> 5",
    ),
    "join_chain": (
        "SELECT o_orderkey, n_name FROM orders JOIN customer ON (o_custkey = c_custkey) JOIN nation ON (c_nationkey = n_nationkey)",
        ["orders", "customer", "nation"],
        "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
}
for _name, (_text, _tables, _sql) in SQL_TEXTS.items():
    query(_name, _sql)(lambda spark, d, _t=_text, _ts=_tables: run_sql(spark, d, _t, *_ts))


@query("sql_this", "SELECT event_type, count(*) AS n FROM events WHERE value > 1 GROUP BY event_type")
def sql_this(spark, d):
    return FrameManager(spark).read_parquet(f"{d}/events.parquet").sql("SELECT event_type, COUNT(*) AS n FROM @this WHERE value > 1 GROUP BY event_type").df


@query("sql_rows_text", "SELECT concat_ws(chr(9), CAST(row_id AS VARCHAR), coalesce(Origin, ''), coalesce(CAST(ArrDelay AS VARCHAR), '')) AS row_text FROM airline")
def sql_rows_text(spark, d):
    return R.rows_text(table(spark, d, "airline").select("row_id", "Origin", "ArrDelay"))


# --- views -----------------------------------------------------------------------------------------------------------


@query("view_project", "SELECT event_id, event_type FROM events")
def view_project(spark, d):
    return R.project(table(spark, d, "events"), "event_id", "event_type")


@query("view_drop", "SELECT event_id, ts, user_id, event_type, value FROM events")
def view_drop(spark, d):
    return R.remove_columns(table(spark, d, "events"), "props")


@query("view_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def view_head(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("view_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def view_top(spark, d):
    return R.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, "o_totalprice", "desc", ["o_orderkey"])


@query("view_subset", "SELECT p_partkey, p_name FROM part WHERE p_size > 20 AND p_retailprice < 1500")
def view_subset(spark, d):
    return R.subset(table(spark, d, "part"), ["p_partkey", "p_name"], "p_size > 20 AND p_retailprice < 1500")


@query("copy", "SELECT * FROM part")
def copy(spark, d):
    return FrameManager(spark).read_parquet(f"{d}/part.parquet").copy().df


@query("num_rows", "SELECT count(*) AS n FROM events")
def num_rows(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


# --- joins and unions ------------------------------------------------------------------------------------------------


def _flights_years(spark, d):
    return table(spark, d, "airline").select("row_id", "Year"), table(spark, d, "year_names")


def _join_query(name: str, how: str, sql: str):
    @query(name, sql)
    def run(spark, d):
        a, y = _flights_years(spark, d)
        return R.join(a, y, how, by_left=["Year"], by_right=["Year_num"])


_join_query("join_inner", "inner", "SELECT row_id, Year, Year_num, Name FROM airline JOIN year_names ON Year = Year_num")
_join_query("join_left", "left", "SELECT row_id, Year, Year_num, Name FROM airline LEFT JOIN year_names ON Year = Year_num")
_join_query("join_right", "right", "SELECT row_id, Year, Year_num, Name FROM airline RIGHT JOIN year_names ON Year = Year_num")
_join_query("join_full", "full", "SELECT row_id, Year, Year_num, Name FROM airline FULL JOIN year_names ON Year = Year_num")
_join_query("join_semi", "left semi", "SELECT row_id, Year FROM airline WHERE Year IN (SELECT Year_num FROM year_names WHERE Year_num IS NOT NULL)")


@query(
    "join_multikey",
    "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_orderkey AS l_orderkey_right, b.l_linenumber AS l_linenumber_right, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
def join_multikey(spark, d):
    t = table(spark, d, "lineitem")
    return R.join(t.select("l_orderkey", "l_linenumber", "l_quantity"), t.select("l_orderkey", "l_linenumber", "l_tax"), "inner", ["l_orderkey", "l_linenumber"])


@query(
    "merge_union_all",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
)
def merge_union_all(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.merge(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'P'"))


# --- aggregation -----------------------------------------------------------------------------------------------------

GROUPED = "SELECT round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, CAST(count(l_orderkey) AS DOUBLE) AS n, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus"
CALLS = ["sum_qty=sum(l_quantity)", "avg_price=avg(l_extendedprice)", "n=count(l_orderkey)"]


@query("agg_groupby", GROUPED)
def agg_groupby(spark, d):
    return rounded(A.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], CALLS))


@query("agg_two_step", GROUPED)
def agg_two_step(spark, d):
    return rounded(A.Grouped(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).agg(CALLS))


MULTI = "SELECT UniqueCarrier, Cancelled, round(avg(ArrDelay), 4) AS AVG_ArrDelay, CAST(max(DepDelay) AS DOUBLE) AS MAX_DepDelay FROM airline WHERE UniqueCarrier IS NOT NULL AND Cancelled IS NOT NULL AND ArrDelay IS NOT NULL AND DepDelay IS NOT NULL GROUP BY UniqueCarrier, Cancelled"


@query("agg_multi", MULTI)
def agg_multi(spark, d):
    return rounded(A.aggregate(table(spark, d, "airline"), "UniqueCarrier, Cancelled, avg(ArrDelay), max(DepDelay)"))


@query(
    "agg_xtabs",
    "SELECT Month, DayOfWeek, CAST(count(row_id) AS DOUBLE) AS COUNT_row_id FROM airline WHERE Month IS NOT NULL AND DayOfWeek IS NOT NULL GROUP BY Month, DayOfWeek",
)
def agg_xtabs(spark, d):
    return A.aggregate(table(spark, d, "airline"), "Month, DayOfWeek, count(row_id)")


@query(
    "agg_functions",
    "SELECT event_type, round(avg(value), 4) AS m, round(avg(value), 4) AS a, max(value) AS hi, min(value) AS lo, round(sum(value), 2) AS s, CAST(count(value) AS DOUBLE) AS n FROM events GROUP BY event_type",
)
def agg_functions(spark, d):
    out = A.group_by(
        table(spark, d, "events"), ["event_type"],
        ["m=mean(value)", "a=avg(value)", "hi=max(value)", "lo=min(value)", "s=sum(value)", "n=count(value)"],
    )
    return rounded(rounded(out, 4, "m", "a"), 2, "s")


@query("agg_on_column", "SELECT round(sum(l_quantity), 2) AS SUM_l_quantity FROM lineitem")
def agg_on_column(spark, d):
    return rounded(A.aggregate_on_column(table(spark, d, "lineitem"), "sum", "l_quantity"), 2)


@query("agg_dropnull", f"SELECT round(avg(value), 4) AS v, event_type FROM ({HOLED}) WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type")
def agg_dropnull(spark, d):
    return rounded(A.group_by(holed(spark, d), ["event_type"], ["v=avg(value)"]))


@query("agg_whole_average", "SELECT floor(avg(ArrDelay)) AS m, DayofMonth FROM airline WHERE ArrDelay IS NOT NULL AND DayofMonth IS NOT NULL GROUP BY DayofMonth")
def agg_whole_average(spark, d):
    return A.group_by(table(spark, d, "airline"), ["DayofMonth"], ["m=avg(ArrDelay)"], whole_averages=True)


@query("stat_corr", "SELECT round(corr(ArrDelay, DepDelay), 6) AS correlation FROM airline WHERE ArrDelay IS NOT NULL AND DepDelay IS NOT NULL")
def stat_corr(spark, d):
    return rounded(A.correlation(table(spark, d, "airline"), "ArrDelay", "DepDelay"), 6)


# --- statistics ------------------------------------------------------------------------------------------------------


def _each(items: str, source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS column_no, '{c}' AS column_name, {items.format(c=c)} FROM {source}" for i, c in enumerate(columns))


BALANCES = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "stat_summary",
    _each(
        "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stdev, round(var_samp({c}), 1) AS variance, count({c}) AS n, count(*) - count({c}) AS n_null, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max",
        "customer",
        BALANCES,
    ),
)
def stat_summary(spark, d):
    return rounded(rounded(stats.summary(table(spark, d, "customer"), BALANCES), 4, "mean", "stdev"), 1, "variance")


@query(
    "stat_simple_summary",
    "SELECT 'event_type' AS column_name, event_type AS level, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM events WHERE event_type IS NOT NULL GROUP BY event_type"
    " UNION ALL SELECT 'value', NULL, min(value), max(value) FROM events UNION ALL SELECT 'user_id', NULL, CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events",
)
def stat_simple_summary(spark, d):
    return stats.simple_summary(set_as_factor(table(spark, d, "events").select("event_type", "value", "user_id"), "event_type"))


@query("stat_distinct_levels", "SELECT DISTINCT UniqueCarrier FROM airline WHERE UniqueCarrier IS NOT NULL")
def stat_distinct_levels(spark, d):
    return R.distinct_levels(table(spark, d, "airline"), "UniqueCarrier")


@query(
    "stat_five_num",
    _each(
        "CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3",
        "lineitem", ["l_quantity", "l_extendedprice", "l_discount"],
    ),
)
def stat_five_num(spark, d):
    return rounded(stats.five_num(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4, "q1", "median", "q3")


@query(
    "stat_quantiles",
    " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, CAST(floor(quantile_cont(ArrDelay, {p})) AS DOUBLE) AS value FROM airline" for p in (0.3, 0.5, 0.7)),
)
def stat_quantiles(spark, d):
    return stats.quantiles(table(spark, d, "airline"), "ArrDelay", [0.3, 0.5, 0.7])


@query("stat_mean", "SELECT round(avg(l_extendedprice), 4) AS mean FROM lineitem")
def stat_mean(spark, d):
    return rounded(stats.mean(table(spark, d, "lineitem"), "l_extendedprice"))


@query("stat_variance", "SELECT round(var_samp(FlightNum), 2) AS variance, round(stddev_samp(FlightNum), 4) AS stdev FROM airline")
def stat_variance(spark, d):
    return rounded(rounded(stats.variance(table(spark, d, "airline"), "FlightNum"), 2, "variance"), 4, "stdev")


@query("stat_covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def stat_covariance(spark, d):
    return rounded(stats.covariance(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 2)


def _hist_sql(even: bool) -> str:
    edge = "lo + i * ((hi - lo) / 10)" if even else "CASE WHEN i = 9 THEN hi ELSE lo + i * ((hi - lo) / 10) END"
    return (
        f"WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), e AS (SELECT i, {edge} AS x FROM m, range(10) t(i)),"
        " b AS (SELECT i, x, lead(x, 1, 1e308) OVER (ORDER BY i) AS nx FROM e)"
        " SELECT x, (SELECT count(*) FROM events WHERE value >= x AND value < nx) AS y FROM b"
    )


@query("stat_histogram", _hist_sql(False))
def stat_histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 10)


@query("stat_histogram_even", _hist_sql(True))
def stat_histogram_even(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 10, even=True)


# --- binning ---------------------------------------------------------------------------------------------------------


def _bin(spark, d, *args, **kw):
    out = B.binning(table(spark, d, "airline").select("row_id", "Month"), "Month", *args, **kw)
    return out.groupBy("Month").agg(F.count(F.lit(1)).alias("n"))


def _bin_sql(cases: list[tuple[str, str]]) -> str:
    case = " ".join(f"WHEN {c} THEN '{n}'" for c, n in cases)
    return f"SELECT b AS Month, count(*) AS n FROM (SELECT CASE {case} END AS b FROM airline) WHERE b IS NOT NULL GROUP BY b"


@query("bin_custom", _bin_sql([("Month >= 2 AND Month <= 4", "[2,4]"), ("Month > 4 AND Month <= 6", "(4,6]"), ("Month > 6 AND Month <= 8", "(6,8]")]))
def bin_custom(spark, d):
    return _bin(spark, d, "CUSTOM", breaks=[2, 4, 6, 8])


@query("bin_equal_interval", _bin_sql([("Month >= 1 AND Month <= 6.5", "[1,6.5]"), ("Month > 6.5 AND Month <= 12", "(6.5,12]")]))
def bin_equal_interval(spark, d):
    return _bin(spark, d, "EQUALINTERVAL", bins=2)


@query(
    "bin_equal_freq",
    "WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem)"
    " SELECT i AS bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= a THEN 1 WHEN l_quantity <= b THEN 2 WHEN l_quantity <= c THEN 3 ELSE 4 END AS i FROM lineitem, q) GROUP BY i",
)
def bin_equal_freq(spark, d):
    out = B.binning(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", "EQUALFREQ", bins=4)
    names = out.schema["l_quantity"].metadata["levels"]
    return out.groupBy(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("l_quantity")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


for _low, _right in ((True, False), (False, True), (False, False)):
    _names = B.labels([1, 6, 12], _low, _right)
    _conds = [
        "Month > 1 AND Month <= 6", "Month > 6 AND Month <= 12",
    ] if _right else ["Month >= 1 AND Month < 6", "Month >= 6 AND Month < 12"] if _low else ["Month > 1 AND Month < 6", "Month > 6 AND Month < 12"]
    query(f"bin_bounds_{'low' if _low else 'nolow'}_{'right' if _right else 'noright'}", _bin_sql(list(zip(_conds, _names))))(
        lambda spark, d, _l=_low, _r=_right: _bin(spark, d, "CUSTOM", breaks=[1, 6, 12], include_lowest=_l, right=_r)
    )

# --- factors and missing data ----------------------------------------------------------------------------------------


@query(
    "factor_counts",
    "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS level, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority",
)
def factor_counts_query(spark, d):
    return factor_counts(set_as_factor(set_as_factor(table(spark, d, "orders"), "o_orderstatus"), "o_orderpriority"))


@query("na_drop_rows", f"SELECT * FROM ({HOLED}) WHERE value IS NOT NULL AND event_type IS NOT NULL")
def na_drop_rows(spark, d):
    return N.drop_na(holed(spark, d))


@query("na_drop_rows_thresh", f"SELECT * FROM ({HOLED}) WHERE (value IS NOT NULL)::INT + (event_type IS NOT NULL)::INT >= 1")
def na_drop_rows_thresh(spark, d):
    return N.drop_na(holed(spark, d), thresh=1, columns=["value", "event_type"])


@query("na_drop_cols", f"SELECT event_id FROM ({HOLED})")
def na_drop_cols(spark, d):
    return N.drop_na(holed(spark, d), "column")


@query("na_fill_value", f"SELECT event_id, coalesce(value, 0) AS value, coalesce(event_type, '0') AS event_type FROM ({HOLED})")
def na_fill_value(spark, d):
    return N.fill_na(holed(spark, d), "0")


@query("na_fill_dict", f"SELECT event_id, coalesce(value, -1) AS value, coalesce(event_type, 'none') AS event_type FROM ({HOLED})")
def na_fill_dict(spark, d):
    return N.fill_na(holed(spark, d), values={"value": "-1", "event_type": "none"})


@query("na_fill_agg", f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 4) AS value, event_type FROM ({HOLED})")
def na_fill_agg(spark, d):
    return rounded(N.fill_na(holed(spark, d), fn="mean", columns=["value"]))


# --- transforms ------------------------------------------------------------------------------------------------------


@query("transform_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def transform_expr(spark, d):
    return rounded(transform.transform_expr(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"),
        "net = l_extendedprice * (1 - l_discount)",
    ).select("l_orderkey", "l_linenumber", "net"))


@query("transform_mapreduce", "SELECT CAST(Month AS VARCHAR) AS key, CAST(sum(DayOfWeek) AS BIGINT) AS val FROM airline WHERE Month IS NOT NULL GROUP BY Month")
def transform_mapreduce(spark, d):
    rows = table(spark, d, "airline").select("Month", "DayOfWeek").where("Month is not null")
    return transform.map_reduce(rows, lambda b: b.rename(columns={"Month": "key", "DayOfWeek": "val"}), "sum", "bigint")


@query(
    "scale_minmax",
    "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer",
)
def scale_minmax(spark, d):
    return rounded(transform.scale_minmax(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6)


@query(
    "scale_standard",
    "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer",
)
def scale_standard(spark, d):
    return rounded(transform.scale_standard(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6)


# --- samples, folds, models ------------------------------------------------------------------------------------------


@query("sample_rows")
def sample_rows(spark, d):
    return sampling.sample_rows(table(spark, d, "mtcars"), 10, seed=7)


@query("sample_fraction")
def sample_fraction(spark, d):
    return sampling.sample_fraction(table(spark, d, "orders"), 0.1, seed=7)


@query("cv_kfold")
def cv_kfold(spark, d):
    return sampling.fold_ids(table(spark, d, "orders"), 5, seed=3).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("cv_random")
def cv_random(spark, d):
    pairs = sampling.cv_random(table(spark, d, "orders").select("o_orderkey"), 3, 0.8, seed=5)
    parts = [t.agg(F.lit(i).alias("split"), F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for i, p in enumerate(pairs) for n, t in zip(("train", "test"), p)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "ml_confusion",
    "SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM (SELECT ArrDelay > 15 AS t, DepDelay > 15 AS p FROM airline)",
)
def ml_confusion(spark, d):
    from tallyframe.operators import ml

    return ml.confusion(table(spark, d, "airline"), "ArrDelay", "DepDelay", 15)


@query("ml_mlr")
def ml_mlr(spark, d):
    from tallyframe.operators import ml

    cars = table(spark, d, "mtcars").select("mpg", "hp", "wt").dropna()
    return ml.mlr(cars).transform(cars, has_labels=True)


@query("ml_svm")
def ml_svm(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "mtcars").select((F.col("am") * 2 - 1).alias("label"), "mpg", "wt", "hp").dropna()
    return ml.svm(rows).transform(rows, has_labels=True)


@query("ml_kmeans")
def ml_kmeans(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "mtcars").select("mpg", "hp", "wt").dropna()
    return ml.k_means(rows, 3, 5).transform(rows)


@query("ml_als")
def ml_als(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "ratings").where("rating between 0.5 and 5").dropna()
    return ml.als(rows, factors=5, iterations=5, blocks=4).transform(rows)


@query("ml_kmeans_given")
def ml_kmeans_given(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "mtcars").select("mpg", "hp", "wt").dropna()
    return ml.k_means(rows, 2, 5, centroids=[[30.0, 80.0, 2.0], [15.0, 200.0, 4.0]]).transform(rows)


@query(
    "ml_regression_metrics",
    "SELECT round(1 - sum(e * e) / (var_pop(ArrDelay) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean_residual FROM (SELECT ArrDelay, CAST(ArrDelay - DepDelay AS DOUBLE) AS e FROM airline) WHERE e IS NOT NULL",
)
def ml_regression_metrics(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "airline").select(F.col("ArrDelay").cast("double").alias("ArrDelay"), F.col("DepDelay").cast("double").alias("DepDelay"))
    return rounded(ml.regression_metrics(rows, "ArrDelay", "DepDelay"), 6)


@query("ml_roc")
def ml_roc(spark, d):
    from tallyframe.operators import ml

    rows = table(spark, d, "airline").where("ArrDelay between -180 and 2880 and DepDelay between -180 and 2880").select((F.col("ArrDelay") > 15).cast("int").alias("late"), "DepDelay")
    return ml.roc(rows, "late", "DepDelay")

"""Plans are what they are meant to be: filters and columns reach the scan, shuffles are where they must be."""

import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_pushdown_and_pruning(spark):
    p = plan(entry.queries()["view_subset"](spark, D))
    assert all(f in p.split("PushedFilters")[1] for f in ("GreaterThan(p_size,20)", "LessThan(p_retailprice,1500.0)"))
    assert "p_brand" not in p and "Exchange" not in p


def test_top_is_not_a_sort(spark):
    for name in ("sql_topk", "view_top"):
        p = plan(entry.queries()[name](spark, D))
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_partial_aggregation(spark):
    p = plan(entry.queries()["agg_groupby"](spark, D))
    assert p.count("Arguments: hashpartitioning") == 1 and "partial_sum" in p and "l_shipdate" not in p


def test_record_parsing_never_shuffles(spark):
    from tallyframe.plans.pipeline_queries import CHECKS, table
    from tallyframe.plans import airline
    from tallyframe.sources import records

    p = plan(records.parse_records(table(spark, D, "airline_raw"), "line", airline.SCHEMA, CHECKS, ["rec_id"], False))
    assert "MapInArrow" in p and "Exchange" not in p


def test_every_table_is_whole(spark):
    """Results account for every row of the tables they are made of."""
    q = entry.queries()
    size = {t: spark.read.parquet(f"{D}/{t}.parquet").count() for t in ("airline", "airline_raw", "flight_times")}
    assert q["p2_found"](spark, D).count() + q["p2_loaded"](spark, D).count() == size["airline_raw"]
    assert q["p6_times"](spark, D).count() == 3 * size["flight_times"]
    for column in ("Origin", "UniqueCarrier"):
        assert sum(r.n_rows for r in q["p3_per_key"](spark, D).where(f"key_column = '{column}'").collect()) == size["airline"]
    per_column = {r.column_name: r["n"] for r in q["p7_counts"](spark, D).groupBy("column_name").agg({"n_rows": "sum"}).withColumnRenamed("sum(n_rows)", "n").collect()}
    assert len(per_column) == 29 and set(per_column.values()) == {size["airline"]}

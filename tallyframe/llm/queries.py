"""Registered queries of this subpackage (p1, p4, p8, p9, p10)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import percentiles as P
from tallyframe.llm import mixing, packing, topn, toxicity
from tallyframe.llm.tokens import token_counts
from tallyframe.plans import airline
from tallyframe.session import spread, written

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


# --- p1: percentiles -------------------------------------------------------------------------------------------------

GROUPS = ["Origin", "UniqueCarrier"]
SETS = {"origin": ["Origin"], "carrier": ["UniqueCarrier"], "both": GROUPS}
DELAYS = ["ArrDelay", "DepDelay"]
PERCENTS = [10, 25, 50, 75, 90, 99]


BOUND = 0.01


def _p1_sql(value: str = "CAST(v AS DOUBLE)", bound: str = "CAST(0 AS DOUBLE)", sets: dict[str, list[str]] = SETS, delays: list[str] = DELAYS) -> str:
    picks = ", ".join(f"({p})" for p in PERCENTS)
    parts = []
    for name, cols in sets.items():
        for c in delays:
            keys = ", ".join(cols)
            show = ", ".join(g if g in cols else f"CAST(NULL AS VARCHAR) AS {g}" for g in GROUPS)
            parts.append(
                f"SELECT '{name}' AS grouping, {show}, '{c}' AS column_name, CAST(p AS DOUBLE) AS percent, n, {value} AS value, {bound} AS error_bound"
                f" FROM (SELECT {keys}, {c} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {c}) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM airline WHERE {c} IS NOT NULL),"
                f" (VALUES {picks}) t(p) WHERE i = greatest(1, (p * n + 99) // 100)"
            )
    return " UNION ALL ".join(parts)


# The middle of the exact value's logarithmic bucket, which is what compact parts keep of it.
_GAMMA = (1 + BOUND) / (1 - BOUND)
_NEAR = f"CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * 2 * pow({_GAMMA!r}::DOUBLE, ceil(ln(abs(v)::DOUBLE) / {math.log(_GAMMA)!r}::DOUBLE)) / {_GAMMA + 1!r}::DOUBLE END"


@query("p1_percentiles", _p1_sql())
def p1_percentiles(spark, d):
    """Exact percentiles over all loads, put together from one part per load."""
    parts = P.percentile_parts(table(spark, d, "airline"), GROUPS, DELAYS, part="load_id")
    return P.percentiles(P.merge_parts(parts, GROUPS), GROUPS, SETS, PERCENTS)


@query("p1_bounded", _p1_sql(f"round({_NEAR}, 6)", f"round({BOUND} * abs({_NEAR}), 6)"))
def p1_bounded(spark, d):
    """The same from compact parts, with values within 1 % of the exact ones."""
    parts = P.percentile_parts(table(spark, d, "airline"), GROUPS, DELAYS, part="load_id", relative_error=BOUND)
    out = P.percentiles(P.merge_parts(parts, GROUPS), GROUPS, SETS, PERCENTS, relative_error=BOUND)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "error_bound")})


@query("p1_spread", _p1_sql(sets={"carrier": ["UniqueCarrier"]}, delays=["ArrDelay"]))
def p1_spread(spark, d):
    """Carriers alone, in shards of eight runs, so that nearly every carrier is selected by proposals of many shards."""
    parts = P.percentile_parts(table(spark, d, "airline"), GROUPS, ["ArrDelay"], part="load_id")
    return P.percentiles(P.merge_parts(parts, GROUPS), GROUPS, {"carrier": ["UniqueCarrier"]}, PERCENTS, shard_runs=8)


# --- p4: top N within every group ------------------------------------------------------------------------------------

TOP = 5


@query(
    "p4_found",
    "SELECT Origin, Year, Month, CAST(r AS INTEGER) AS rank_no, row_id FROM (SELECT Origin, Year, Month, row_id, row_number() OVER (PARTITION BY Origin, Year, Month ORDER BY ArrDelay DESC, FlightNum NULLS LAST, row_id) AS r"
    f" FROM airline WHERE Origin IN (SELECT iata FROM airports WHERE iata IS NOT NULL) AND Year IS NOT NULL AND ArrDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH}) WHERE r <= {TOP}",
)
def p4_found(spark, d):
    flights = table(spark, d, "airline").where(F.col("Year").isNotNull() & F.col("ArrDelay").between(airline.DELAY_LOW, airline.DELAY_HIGH))
    known = flights.join(table(spark, d, "airports").select(F.col("iata").alias("Origin")), "Origin", "left_semi")
    return topn.top_n(known, ["Origin", "Year", "Month"], "ArrDelay", ["FlightNum", "row_id"], TOP).select("Origin", "Year", "Month", "rank_no", "row_id")


# --- p8: containers of fixed capacity --------------------------------------------------------------------------------

CAPACITY = 2048


@query("p8_packing")
def p8_packing(spark, d):
    sizes = token_counts(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ["doc_id"])
    return packing.pack_items(sizes, "doc_id", "n_tokens", CAPACITY)


@query("p8_kept", "SELECT count(*) AS n_docs, true AS all_placed, 0 AS overfull, 0 AS split_short, true AS little_space_left FROM documents")
def p8_kept(spark, d):
    """What packing promises: every document placed, no container overfull, none split but those longer than a container."""
    packed = written(p8_packing(spark, d), "packed")
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(
        F.count(F.when(F.col("t") > CAPACITY, 1)).cast("int").alias("overfull"), (F.sum("t") / (F.count(F.lit(1)) * CAPACITY) > 0.97).alias("little_space_left"),
    ).withColumn("one", F.lit(1))
    per_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("t")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when((F.col("pieces") > 1) & (F.col("t") <= CAPACITY), 1)).cast("int").alias("split_short"),
    ).withColumn("one", F.lit(1))
    docs = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    both = per_doc.join(full, "one").join(docs, "one")  # one row each
    return both.select("n_docs", (F.col("n_docs") == F.col("n")).alias("all_placed"), "overfull", "split_short", "little_space_left")


@query("p8_report")
def p8_report(spark, d):
    return packing.fill_report(p8_packing(spark, d), CAPACITY)


# --- p9: mixing sources ----------------------------------------------------------------------------------------------


def _mix(spark, d):
    docs = written(token_counts(spread(table(spark, d, "documents").select("doc_id", "source", "text")), "text", ["doc_id", "source"]), "sized")
    rows = table(spark, d, "source_targets").where("source is not null").limit(mixing.MOST_SOURCES + 1).collect()
    targets = [(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in rows]
    # Sources that may be repeated come later, when the others have been seen once.
    shapes = {s: [0.5, 1.0, 1.5] if m > 1 else [1.5, 1.0, 0.5] for s, _, m in targets}
    return docs, mixing.mix(docs, mixing.plan_mix(docs, targets, shapes=shapes, knots=[0.0, 0.5, 1.0]))


@query("p9_mix")
def p9_mix(spark, d):
    return _mix(spark, d)[1]


@query("p9_shares")
def p9_shares(spark, d):
    docs, mixed = _mix(spark, d)
    return mixing.share_report(docs, mixed, table(spark, d, "source_targets"))


@query(
    "p9_on_target",
    "SELECT source, docs, coalesce(target_share, 0) AS target_share, coalesce(max_repeats, 0) AS max_repeats, true AS on_target, true AS repeats_kept"
    " FROM (SELECT source, count(*) AS docs FROM documents GROUP BY source) d FULL JOIN source_targets t USING (source)",
)
def p9_on_target(spark, d):
    """Whether every source's actual share is within 1 % of its target, and no document used more often than allowed."""
    r = p9_shares(spark, d)
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01 * F.col("target_share")
    return r.select("source", "docs", "target_share", "max_repeats", near.alias("on_target"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


# --- p10: abusive, hateful or sexual content -------------------------------------------------------------------------


def _scored(spark, d):
    docs = toxicity.tokenised(table(spark, d, "documents"), "doc_id", "text", ["source"])
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, d, "doc_labels")), keep=["source"])


@query("p10_found")
def p10_found(spark, d):
    return _scored(spark, d).where("flagged").select("doc_id")


@query("p10_scores")
def p10_scores(spark, d):
    return _scored(spark, d)


@query("p10_rates")
def p10_rates(spark, d):
    return toxicity.source_rates(_scored(spark, d))

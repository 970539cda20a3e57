"""Registered queries of the data-preparation operators (p2, p3, p5, p6, p7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import heavy, impute, instants, profile
from tallyframe.plans import airline
from tallyframe.session import spread
from tallyframe.sources import records

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


# --- p2: rows that fail to parse -------------------------------------------------------------------------------------

CHECKS = {**{c: records.hhmm for c in airline.TIMES}, "TailNum": records.matches(airline.TAIL_NUMBER)}


def parsed_lines(spark: SparkSession, d: str, values: bool) -> DataFrame:
    return records.parse_records(spread(table(spark, d, "airline_raw").select("rec_id", "line")), "line", airline.SCHEMA, CHECKS, ["rec_id"], values)


def _p2_sql() -> str:
    field = r'"(?:[^"]|"")*"|[^",]*'
    ints = [i + 1 for i, c in enumerate(airline.COLUMNS) if c not in airline.TEXT]
    times = [airline.COLUMNS.index(c) + 1 for c in airline.TIMES]
    tail = airline.COLUMNS.index("TailNum") + 1
    int_bad = " OR ".join(f"(v[{i}] IS NOT NULL AND (NOT regexp_full_match(v[{i}], '[+-]?[0-9]+') OR TRY_CAST(v[{i}] AS INTEGER) IS NULL))" for i in ints)
    time_bad = " OR ".join(f"coalesce(TRY_CAST(v[{i}] AS INTEGER) NOT BETWEEN 0 AND 2400 OR TRY_CAST(v[{i}] AS INTEGER) % 100 >= 60, false)" for i in times)
    return f"""
    WITH s AS (SELECT rec_id, regexp_replace(coalesce(line, ''), '\\r$', '') AS s FROM airline_raw),
    q AS (SELECT rec_id, s, regexp_full_match(s, '(?:{field})(?:,(?:{field}))*') AS ok FROM s),
    f AS (SELECT rec_id, ok, CASE WHEN ok THEN regexp_extract_all(',' || s, ',({field})', 1) END AS f FROM q),
    u AS (SELECT rec_id, ok, len(f) AS n, list_transform(f, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(9) || ' ')) AS t FROM f),
    v AS (SELECT rec_id, ok, n, list_transform(t, lambda x: CASE WHEN x IN ('', 'NA') THEN NULL ELSE x END) AS v FROM u),
    r AS (SELECT rec_id, v, CASE WHEN NOT ok THEN 'quoting' WHEN n <> {len(airline.COLUMNS)} THEN 'columns'
        WHEN {int_bad} OR {time_bad} OR (v[{tail}] IS NOT NULL AND NOT regexp_full_match(v[{tail}], 'N[A-Z0-9]{{2,5}}')) THEN 'value' END AS reason FROM v)
    """


@query("p2_found", _p2_sql() + "SELECT rec_id, reason FROM r WHERE reason IS NOT NULL")
def p2_found(spark, d):
    return parsed_lines(spark, d, False).where("reason is not null").select("rec_id", "reason")


@query(
    "p2_loaded",
    _p2_sql() + "SELECT rec_id, " + ", ".join(f"v[{i + 1}] AS {c}" if c in airline.TEXT else f"CAST(v[{i + 1}] AS INTEGER) AS {c}" for i, c in enumerate(airline.COLUMNS)) + " FROM r WHERE reason IS NULL",
)
def p2_loaded(spark, d):
    return records.split(parsed_lines(spark, d, True))[0]


# --- p3: a few keys holding most records -----------------------------------------------------------------------------

HEAVY_SHARE = 0.05
KEYS = ["Origin", "UniqueCarrier"]


@query(
    "p3_found",
    " UNION ALL ".join(f"SELECT '{c}' AS key_column, {c} AS key_value FROM airline WHERE {c} IS NOT NULL GROUP BY {c} HAVING 100 * count(*) >= {round(100 * HEAVY_SHARE)} * (SELECT count(*) FROM airline)" for c in KEYS),
)
def p3_found(spark, d):
    return heavy.heavy_keys(table(spark, d, "airline").select(*KEYS), KEYS, HEAVY_SHARE).select("key_column", "key_value")


def _p3_figures() -> tuple[dict, dict]:
    parts: dict = {"rows": (F.count(F.lit(1)), "sum")}
    finals: dict = {"n_rows": F.col("rows")}
    for c in ("ArrDelay", "DepDelay"):
        v = F.when(F.col(c).between(airline.DELAY_LOW, airline.DELAY_HIGH), F.col(c).cast("bigint"))
        parts |= {
            f"known_{c}": (F.count(v), "sum"), f"minutes_{c}": (F.sum(v), "sum"), f"least_{c}": (F.min(v), "min"),
            f"most_{c}": (F.max(v), "max"), f"late_{c}": (F.count(F.when(v >= 15, 1)), "sum"),
        }
        finals |= {
            f"n_{c}": F.col(f"known_{c}"), f"mean_{c}": F.round(F.col(f"minutes_{c}") / F.col(f"known_{c}"), 6),
            f"min_{c}": F.col(f"least_{c}").cast("int"), f"max_{c}": F.col(f"most_{c}").cast("int"),
            f"late_{c}": F.col(f"late_{c}"),
        }
    return parts, finals


def _p3_sql() -> str:
    def figures(c: str) -> str:
        v = f"CASE WHEN {c} BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH} THEN {c} END"
        return f"count({v}) AS n_{c}, round(sum({v}) / count({v}), 6) AS mean_{c}, min({v}) AS min_{c}, max({v}) AS max_{c}, count(CASE WHEN {v} >= 15 THEN 1 END) AS late_{c}"

    return " UNION ALL ".join(f"SELECT '{k}' AS key_column, {k} AS key_value, count(*) AS n_rows, {figures('ArrDelay')}, {figures('DepDelay')} FROM airline GROUP BY {k}" for k in KEYS)


@query("p3_per_key", _p3_sql())
def p3_per_key(spark, d):
    rows = table(spark, d, "airline").select(*KEYS, "ArrDelay", "DepDelay")
    parts, finals = _p3_figures()
    found, _ = heavy.candidates(rows.select(*KEYS), KEYS, HEAVY_SHARE)
    a, b = (heavy.per_key(rows, k, parts, finals, HEAVY_SHARE, found) for k in KEYS)
    return a.unionByName(b)


@query(
    "p3_distinct",
    " UNION ALL ".join(f"SELECT '{k}' AS key_column, {k} AS key_value, count(DISTINCT FlightNum) AS n_FlightNum, count(DISTINCT Dest) AS n_Dest, count(DISTINCT TailNum) AS n_TailNum FROM airline GROUP BY {k}" for k in KEYS),
)
def p3_distinct(spark, d):
    """Aggregates that don't merge: distinct flights, destinations and aircraft per key."""
    rows = table(spark, d, "airline").select(*KEYS, "FlightNum", "Dest", "TailNum")
    a, b = (heavy.distinct_per_key(rows, k, ["FlightNum", "Dest", "TailNum"], HEAVY_SHARE) for k in KEYS)
    return a.unionByName(b)


def _delay_counts(t: pa.Table) -> pa.Table:
    """Rows of one key to counts of its usable delays."""
    c = t.column("ArrDelay").drop_null()
    c = c.filter(pc.and_(pc.greater_equal(c, airline.DELAY_LOW), pc.less_equal(c, airline.DELAY_HIGH)))
    v, n = np.unique(c.to_numpy(), return_counts=True)
    return pa.table({"delay": pa.array(v, pa.int32()), "n": pa.array(n, pa.int64())})


def _delay_middle(t: pa.Table) -> pa.Table:
    """Counts of one key's delays to its median and its commonest delay, the least one on ties."""
    t = t.group_by("delay").aggregate([("n", "sum")]).sort_by("delay")
    v, n = t.column("delay").to_numpy(), t.column("n_sum").to_numpy()
    if not len(v):
        return pa.table({"median": pa.array([None], pa.int32()), "mode": pa.array([None], pa.int32())})
    cum = np.cumsum(n)
    return pa.table({"median": pa.array([v[np.searchsorted(cum, (cum[-1] + 1) // 2)]], pa.int32()), "mode": pa.array([v[n.argmax()]], pa.int32())})


@query(
    "p3_middle",
    " UNION ALL ".join(
        f"SELECT '{k}' AS key_column, k.{k} AS key_value, quantile_disc(ArrDelay, 0.5) AS median, (SELECT d FROM (SELECT a.ArrDelay AS d, count(*) AS n FROM airline a WHERE a.{k} IS NOT DISTINCT FROM k.{k} AND a.ArrDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH} GROUP BY a.ArrDelay) ORDER BY n DESC, d LIMIT 1) AS mode"
        f" FROM (SELECT {k}, CASE WHEN ArrDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH} THEN ArrDelay END AS ArrDelay FROM airline) k GROUP BY k.{k}" for k in KEYS[1:]
    ),
)
def p3_middle(spark, d):
    """User code per key in two steps: median and commonest delay of every carrier."""
    rows = table(spark, d, "airline").select("UniqueCarrier", "ArrDelay")
    out = heavy.apply_per_key(rows, "UniqueCarrier", _delay_counts, "delay int, n bigint", _delay_middle, "median int, mode int", HEAVY_SHARE)
    return out.select(F.lit("UniqueCarrier").alias("key_column"), "key_value", "median", "mode")


# --- p7: data quality per column and load ----------------------------------------------------------------------------

NULL_PERCENT, BAD_PERCENT, DRIFT = 20, 5, 0.30
WATCHED = ["ArrDelay", "DepTime", "Cancelled", "UniqueCarrier"]
DELAY_STEPS, TIME_STEPS = (0, 15, 60), (600, 1200, 1800)


def _literal(df: DataFrame, column: str, most: int = 10_000) -> list:
    """A reference table's values as a literal list; more than ``most`` are refused."""
    got = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"too many values of {column} for a literal list")
    return got


def quality_rules(spark: SparkSession, d: str) -> dict[str, profile.Rule]:
    """Allowed values of the watched columns, and of the others whose validity is known."""
    delay = profile.Rule(lambda v: v.between(airline.DELAY_LOW, airline.DELAY_HIGH), profile.steps(*DELAY_STEPS))
    time = profile.Rule(lambda v: v.between(0, 2400) & (v % 100 < 60), profile.steps(*TIME_STEPS))
    port = profile.one_of(_literal(table(spark, d, "airports"), "iata"))
    return {
        "ArrDelay": delay, "DepTime": time, "Cancelled": profile.one_of([0, 1]),
        "UniqueCarrier": profile.one_of(_literal(table(spark, d, "carriers"), "code")),
        "DepDelay": delay, "CRSDepTime": time, "ArrTime": time, "CRSArrTime": time, "Origin": port, "Dest": port,
        "Month": profile.one_of(list(range(1, 13))), "DayofMonth": profile.one_of(list(range(1, 32))),
        "DayOfWeek": profile.one_of(list(range(1, 8))), "TailNum": profile.Rule(lambda v: v.rlike(airline.TAIL_NUMBER)),
    }


def _p7_sql() -> str:
    allowed = {
        "ArrDelay": f"ArrDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH}",
        "DepTime": "DepTime BETWEEN 0 AND 2400 AND DepTime % 100 < 60",
        "Cancelled": "Cancelled IN (0, 1)",
        "UniqueCarrier": "UniqueCarrier IN (SELECT code FROM carriers WHERE code IS NOT NULL)",
    }
    bucket = {
        "ArrDelay": "CASE WHEN ArrDelay < 0 THEN 'a' WHEN ArrDelay < 15 THEN 'b' WHEN ArrDelay < 60 THEN 'c' ELSE 'd' END",
        "DepTime": "CASE WHEN DepTime < 600 THEN 'a' WHEN DepTime < 1200 THEN 'b' WHEN DepTime < 1800 THEN 'c' ELSE 'd' END",
        "Cancelled": "CAST(Cancelled AS VARCHAR)",
        "UniqueCarrier": "UniqueCarrier",
    }
    cells = " UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {c} IS NULL AS nul, coalesce({allowed[c]}, false) AS ok, CASE WHEN {allowed[c]} THEN {bucket[c]} END AS b FROM airline" for c in WATCHED)
    return f"""WITH c AS ({cells}),
    t AS (SELECT load_id, column_name, count(*) AS n, count(*) FILTER (WHERE nul) AS nn, count(*) FILTER (WHERE ok) AS nok FROM c GROUP BY load_id, column_name),
    a AS (SELECT column_name, b, count(*) / sum(count(*)) OVER (PARTITION BY column_name) AS p FROM c WHERE ok GROUP BY column_name, b),
    l AS (SELECT load_id, column_name, b, count(*) AS k FROM c WHERE ok GROUP BY load_id, column_name, b),
    d AS (SELECT t.load_id, t.column_name, sum(abs(coalesce(l.k, 0) / t.nok - a.p)) / 2 AS drift FROM t JOIN a ON a.column_name = t.column_name
        LEFT JOIN l ON l.load_id = t.load_id AND l.column_name = t.column_name AND l.b = a.b WHERE t.nok > 0 GROUP BY t.load_id, t.column_name)
    SELECT t.load_id, t.column_name FROM t LEFT JOIN d ON d.load_id = t.load_id AND d.column_name = t.column_name
    WHERE 100 * nn > {NULL_PERCENT} * n OR 100 * (n - nn - nok) > {BAD_PERCENT} * (n - nn) OR coalesce(drift > {DRIFT}, false)"""


@query("p7_found", _p7_sql())
def p7_found(spark, d):
    rules = quality_rules(spark, d)
    out = profile.profile(spark, f"{d}/airline.parquet", "load_id", {c: rules[c] for c in WATCHED}, WATCHED, distinct=False)
    known = F.col("n_rows") - F.col("n_null")
    bad = (F.col("n_null") * 100 > F.col("n_rows") * NULL_PERCENT) | (F.col("n_disallowed") * 100 > known * BAD_PERCENT) | F.coalesce(F.col("drift") > DRIFT, F.lit(False))
    return out.where(bad).select("load_id", "column_name")


def _p7_counts_sql() -> str:
    hhmm = "{c} BETWEEN 0 AND 2400 AND {c} % 100 < 60"
    delay = f"{{c}} BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH}"
    port = "{c} IN (SELECT iata FROM airports WHERE iata IS NOT NULL)"
    allowed = {
        "ArrDelay": delay, "DepDelay": delay, **{c: hhmm for c in airline.TIMES}, "Cancelled": "{c} IN (0, 1)",
        "UniqueCarrier": "{c} IN (SELECT code FROM carriers WHERE code IS NOT NULL)", "Origin": port, "Dest": port,
        "Month": "{c} BETWEEN 1 AND 12", "DayofMonth": "{c} BETWEEN 1 AND 31", "DayOfWeek": "{c} BETWEEN 1 AND 7",
        "TailNum": "regexp_matches({c}, '^N[A-Z0-9]{{2,5}}$')",
    }
    parts = []
    for c in airline.COLUMNS:
        bad = f"count(*) FILTER (WHERE NOT ({allowed[c].format(c=c)}))" if c in allowed else "CAST(NULL AS BIGINT)"
        num = "CAST(NULL AS DOUBLE)" if c in airline.TEXT else None
        text = None if c in airline.TEXT else "CAST(NULL AS VARCHAR)"
        exact = f"count(DISTINCT {c})" if c in airline.TEXT or c in allowed else "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT load_id, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, {exact} AS n_distinct, {num or f'CAST(min({c}) AS DOUBLE)'} AS min_num, {num or f'CAST(max({c}) AS DOUBLE)'} AS max_num,"
            f" {text or f'min({c})'} AS min_text, {text or f'max({c})'} AS max_text, {bad} AS n_disallowed FROM airline GROUP BY load_id"
        )
    return " UNION ALL ".join(parts)


@query("p7_counts", _p7_counts_sql())
def p7_counts(spark, d):
    """What of the full profile SQL can say: rows, nulls, exact distinct values, ranges and disallowed values of all 29 columns."""
    rules = quality_rules(spark, d)
    out = profile.profile(spark, f"{d}/airline.parquet", "load_id", rules, airline.COLUMNS)
    exact = F.col("column_name").isin([*airline.TEXT, *rules])  # the same columns at any size
    return out.select("load_id", "column_name", "n_rows", "n_null", F.when(exact, F.col("n_distinct")).alias("n_distinct"), "min_num", "max_num", "min_text", "max_text", "n_disallowed")


@query("p7_chunks")
def p7_chunks(spark, d):
    """Per column how many chunks there are and how many of them the profile settles by their footers."""
    return profile.chunk_report(spark, f"{d}/airline.parquet", "load_id")


@query("p7_profile")
def p7_profile(spark, d):
    return profile.profile(spark, f"{d}/airline.parquet", "load_id", quality_rules(spark, d))


@query(
    "p7_footers",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM airline"
        for c in [*airline.COLUMNS, "row_id", "load_id", "loaded_at"]
    ),
)
def p7_footers(spark, d):
    return profile.footer_profile(spark, f"{d}/airline.parquet", "load_id")


# --- p6: mixed timestamp formats and zones ---------------------------------------------------------------------------

TIME_FIELDS = [
    instants.TimeField("CRSDepTime", "__origin_tz"),
    instants.TimeField("DepTime", "__origin_tz", "nearest", "CRSDepTime"),
    instants.TimeField("ArrTime", "__dest_tz", "after", "DepTime"),
]


def flight_instants(spark: SparkSession, d: str) -> DataFrame:
    times, ports = table(spark, d, "flight_times"), table(spark, d, "airports")
    for col, name in (("Origin", "__origin_tz"), ("Dest", "__dest_tz")):
        times = times.join(
            ports.select(F.col("iata").alias(f"{name}_iata"), F.col("tz").alias(name)),
            F.col(col) == F.col(f"{name}_iata"), "left",
        ).drop(f"{name}_iata")
    return instants.normalise_times(times, "time_id", "feed", "zone", ("Year", "Month", "DayofMonth"), TIME_FIELDS)


@query("p6_found")
def p6_found(spark, d):
    return flight_instants(spark, d).where("status = 'ok'").select("time_id", "column_name", "utc_us")


@query("p6_times")
def p6_times(spark, d):
    """Every time field with its text, the format chosen, the instant or the reason there is none."""
    return flight_instants(spark, d)


# --- p5: filling missing values --------------------------------------------------------------------------------------


def _minutes(c: str) -> Column:
    return F.when(F.col(c).between(0, 2400) & (F.col(c) % 100 < 60), F.floor(F.col(c) / 100) * 60 + F.col(c) % 100)


def _wrapped(v: Column) -> Column:
    """Minutes within half a day either way."""
    return F.pmod(v + 720, F.lit(1440)) - 720


def _delay_field(name: str, time: str, planned: str, other: str) -> impute.NumericField:
    shift = _minutes(time) - _minutes(planned)
    span = F.col("ActualElapsedTime") - F.col("CRSElapsedTime")
    longer = F.when(F.abs(span) <= 600, span)

    def features(work: dict[str, Column]) -> list[Column]:
        near = work[other] + _wrapped(shift - work[other])
        return [
            F.coalesce(near, work[other]), F.when(near.isNull(), 1).otherwise(0), work[other],
            F.coalesce(longer, F.lit(0)), F.when(longer.isNull(), 1).otherwise(0),
        ]

    usable = F.col(name).between(airline.DELAY_LOW, airline.DELAY_HIGH)
    return impute.NumericField(name, usable, F.col(time).isNotNull(), features, F.coalesce(_wrapped(shift), F.lit(0)), airline.DELAY_LOW, airline.DELAY_HIGH, [time, planned, "ActualElapsedTime", "CRSElapsedTime"])


def filled_flights(spark: SparkSession, d: str, flights: DataFrame | None = None) -> DataFrame:
    flights = table(spark, d, "airline") if flights is None else flights
    codes = table(spark, d, "airports").select(F.col("iata").alias("__iata")).where("__iata is not null").distinct()
    known = flights.join(codes, F.upper(F.trim("Origin")) == F.col("__iata"), "left")
    origin = impute.CategoryField(
        "Origin",
        F.col("__iata"),
        F.lit(True),
        {"carrier": F.upper(F.trim("UniqueCarrier")), "flight": F.col("FlightNum"), "dest": F.col("Dest"), "distance": F.col("Distance")},
        [["carrier", "flight", "dest"], ["dest", "distance"], ["carrier", "flight"], ["dest"]],
        "ArrDelay",
        [0, 15, 60],
    )
    numbers = [_delay_field("DepDelay", "DepTime", "CRSDepTime", "ArrDelay"), _delay_field("ArrDelay", "ArrTime", "CRSArrTime", "DepDelay")]
    return impute.impute(known, numbers, origin).drop("__iata")


@query(
    "p5_found",
    f"SELECT row_id, 'ArrDelay' AS column_name FROM airline WHERE ArrTime IS NOT NULL AND (ArrDelay IS NULL OR ArrDelay NOT BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH})"
    f" UNION ALL SELECT row_id, 'DepDelay' FROM airline WHERE DepTime IS NOT NULL AND (DepDelay IS NULL OR DepDelay NOT BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH})"
    " UNION ALL SELECT row_id, 'Origin' FROM airline WHERE Origin IS NULL OR upper(trim(Origin)) NOT IN (SELECT iata FROM airports WHERE iata IS NOT NULL)",
)
def p5_found(spark, d):
    names = ["ArrDelay", "DepDelay", "Origin"]
    marked = F.array_compact(F.array(*[F.when(F.col(f"{n}_filled"), F.lit(n)) for n in names]))
    some = F.col("ArrDelay_filled") | F.col("DepDelay_filled") | F.col("Origin_filled")
    return filled_flights(spark, d).where(some).select("row_id", F.explode(marked).alias("column_name"))


@query("p5_filled")
def p5_filled(spark, d):
    return filled_flights(spark, d)


HIDDEN = 53


@query(
    "p5_heldout",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_hidden, true AS mostly_right FROM airline WHERE row_id % {HIDDEN} = {k} AND {ok}"
        for k, (c, ok) in enumerate({
            "ArrDelay": f"ArrTime IS NOT NULL AND ArrDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH}",
            "DepDelay": f"DepTime IS NOT NULL AND DepDelay BETWEEN {airline.DELAY_LOW} AND {airline.DELAY_HIGH}",
            "Origin": "Origin IN (SELECT iata FROM airports WHERE iata IS NOT NULL)",
        }.items())
    ),
)
def p5_heldout(spark, d):
    """Known cells hidden from some rows and filled: whether 85 % of the delays are within two minutes and of the origins right."""
    r = heldout(spark, d)
    return r.select("column_name", "n_hidden", (F.col("right_share") >= 0.85).alias("mostly_right"))


def heldout(spark: SparkSession, d: str) -> DataFrame:
    """(column_name, n_hidden, right_share)."""
    flights = table(spark, d, "airline")
    ports = table(spark, d, "airports").select(F.col("iata").alias("__port")).where("__port is not null").distinct()
    usable = lambda c: F.coalesce(F.col(c).between(airline.DELAY_LOW, airline.DELAY_HIGH), F.lit(False))
    tagged = flights.join(ports, F.col("Origin") == F.col("__port"), "left")
    hide = {
        "ArrDelay": (F.col("row_id") % HIDDEN == 0) & usable("ArrDelay") & F.col("ArrTime").isNotNull(),
        "DepDelay": (F.col("row_id") % HIDDEN == 1) & usable("DepDelay") & F.col("DepTime").isNotNull(),
        "Origin": (F.col("row_id") % HIDDEN == 2) & F.col("__port").isNotNull(),
    }
    hidden = tagged.select(
        *[F.when(~hide[c], F.col(c)).alias(c) if c in hide else F.col(c) for c in flights.columns], *[F.when(x, F.col(c)).alias(f"true_{c}") for c, x in hide.items()],
    )
    out = filled_flights(spark, d, hidden)
    right = {c: F.abs(F.col(c) - F.col(f"true_{c}")) <= 2 for c in ("ArrDelay", "DepDelay")} | {"Origin": F.col("Origin") == F.col("true_Origin")}
    cells = F.array(*[F.when(F.col(f"true_{c}").isNotNull(), F.struct(F.lit(c).alias("column_name"), F.coalesce(r, F.lit(False)).alias("right"))) for c, r in right.items()])
    long = out.select(F.explode(cells).alias("x")).where("x is not null")
    return long.groupBy("x.column_name").agg(F.count(F.lit(1)).alias("n_hidden"), F.avg(F.col("x.right").cast("int")).alias("right_share"))

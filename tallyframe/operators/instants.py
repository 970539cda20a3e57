"""Mixed time texts to UTC instants.

Every text yields an array of all its valid readings. Over each source's record order a Viterbi pass picks one per field:
the emission cost is the distance of the reading's date to the row's date, which always outweighs the transition costs;
those (a format switch, a step back in time) decide among readings equally near. Then zones and clock rules make instants.

A source may hold most of all rows, so all records are range-partitioned and sorted by source and identifier, and every
``run_length`` consecutive records of a source within a partition are a run, decoded by one call. The choice doesn't depend on
the cuts: a run reports its first and last readings with the cheapest cost between each pair of them, those of a source are
chained by the same Viterbi pass (one row per run and field), and runs whose ends are ambiguous are decoded again with the ends
so chosen; at an end with one reading a chain can be cut anyway.

Status of a field: ``ok``, ``no_time`` (no valid reading), ``no_zone``, ``no_anchor`` (the field it follows has no time),
``skipped`` or ``repeated`` (by a clock change). Nulls and empty texts are ``no_time``; a null source is a source; repeated
rows each get a result; rows without an identifier come first in their source, in the order of their texts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.timetext import CLOCK, DAY, EPOCH, FORMATS, INSTANT, offsets_at_wall, readings, wall_at, zone_named
from tallyframe.session import written

NEAR, SWITCH, BACK = 1000.0, 1.0, 0.5


@dataclass(frozen=True)
class TimeField:
    """A text column; the column with its place's zone; and where a text without a date falls: ``on_date``, or ``nearest`` or ``after`` another field."""

    column: str
    zone: str
    rule: str = "on_date"
    anchor: str | None = None


def step_cost(p: tuple, o: tuple) -> float:
    """From one reading to the next one of a source."""
    return SWITCH * (p[0] != o[0]) + BACK * (p[1] != CLOCK and o[1] != CLOCK and o[2] < p[2])


def _forward(options: list[list[tuple]], days: list[int | None], kept: list[int], start: int | None) -> tuple[list[list[int]], list[float]]:
    """Of the values that have readings: for each reading the best one before it, and the costs at the last value."""
    paths: list[list[int]] = []
    before: list[tuple] = []
    cost: list[float] = []
    for i in kept:
        opts, day = options[i], days[i]
        now, back = [], []
        for n, o in enumerate(opts):
            c = abs(o[2] // DAY - day) * NEAR if o[1] != CLOCK and day is not None and len(opts) > 1 else 0.0
            if not paths and start is not None and n != start:
                c = math.inf
            best, at = 0.0, -1
            for k, (p, pc) in enumerate(zip(before, cost)):
                step = pc + step_cost(p, o)
                if at < 0 or step < best:
                    best, at = step, k
            now.append(c + best)
            back.append(at)
        paths.append(back)
        before, cost = opts, now
        if len(opts) == 1 and start is None:
            cost = [0.0]  # whatever follows, all paths lead through here
    return paths, cost


def viterbi(options: list[list[tuple]], days: list[int | None], start: int | None = None, end: int | None = None) -> list[tuple | None]:
    """The cheapest choice of one reading per value; values without a reading are passed over. ``start`` and ``end`` name the
    readings of the first and the last value, if they are settled already."""
    kept = [i for i, o in enumerate(options) if o]
    chosen: list[tuple | None] = [None] * len(options)
    if kept:
        paths, cost = _forward(options, days, kept, start)
        k = cost.index(min(cost)) if end is None else end
        for step in range(len(kept) - 1, -1, -1):
            chosen[kept[step]] = options[kept[step]][k]
            k = paths[step][k]
    return chosen


def ends(options: list[list[tuple]], days: list[int | None]) -> tuple[list[tuple], list[tuple], list[list[float]]] | None:
    """First and last readings of a run and the cheapest cost from each of the first to each of the last; null without readings."""
    kept = [i for i, o in enumerate(options) if o]
    if not kept:
        return None
    first, last = options[kept[0]], options[kept[-1]]
    if len(first) == len(last) == 1:
        return first, last, [[0.0]]
    return first, last, [_forward(options, days, kept, i)[1] for i in range(len(first))]


def chain(runs: list[tuple[list[tuple], list[tuple], list[list[float]]]]) -> list[tuple[int, int]]:
    """The readings at both ends of each run of a source, in order, on the cheapest path through all of them."""
    cost: list[float] = []
    back: list[list[tuple[int, int]]] = []
    for n, (first, last, within) in enumerate(runs):
        enter = [(0.0, -1)] * len(first)
        if n:
            before = runs[n - 1][1]
            enter = [min((cost[k] + step_cost(p, o), k) for k, p in enumerate(before)) for o in first]
        ways = [min((enter[i][0] + within[i][j], i) for i in range(len(first))) for j in range(len(last))]
        back.append([(i, enter[i][1]) for _, i in ways])
        low = min(c for c, _ in ways)
        cost = [c - low for c, _ in ways]
    out: list[tuple[int, int]] = []
    j = cost.index(min(cost)) if cost else 0
    for ways in reversed(back):
        i, k = ways[j]
        out.append((i, j))
        j = k
    return out[::-1]


def at_wall(zone, wall: int) -> tuple[str, list[int]]:
    """Status and the instants that a wall time may mean."""
    a, b = offsets_at_wall(zone, wall)
    if a == b:
        return "ok", [wall - a]
    return ("repeated" if a > b else "skipped"), [wall - a, wall - b]


def place(zone, clock: int, anchor: int, rule: str) -> tuple[str, list[int]]:
    """The occurrence of a clock time nearest to, or first after, an instant."""
    day = wall_at(zone, anchor) // DAY
    best = None
    for d in (-2, -1, 0, 1, 2):
        wall = (day + d) * DAY + clock
        at = wall - offsets_at_wall(zone, wall)[0]
        if rule == "after":
            if at > anchor:
                best = wall
                break
        elif best is None or abs(at - anchor) < best[0]:
            best = (abs(at - anchor), wall)
    return at_wall(zone, best if rule == "after" else best[1])


def resolve(reading: tuple | None, zone_text: str | None, day: int | None, rule: str, anchors: list[int] | None) -> tuple[str, list[int]]:
    """Status and possible instants of one field; exactly one instant if the status is ok."""
    if reading is None:
        return "no_time", []
    _, kind, us, region = reading
    if kind == INSTANT:
        return "ok", [us]
    name = region or zone_text
    zone = zone_named(name) if name else None
    if zone is None:
        return "no_zone", []
    if kind != CLOCK:
        return at_wall(zone, us)
    if rule == "on_date":
        return ("no_anchor", []) if day is None else at_wall(zone, day * DAY + us)
    if not anchors:
        return "no_anchor", []
    results = [place(zone, us, a, rule) for a in anchors]
    if all(r == results[0] for r in results):
        return results[0]
    return "repeated", sorted({x for _, xs in results for x in xs})


def day_number(y, m, d) -> int | None:
    try:
        return date(y, m, d).toordinal() - EPOCH
    except (TypeError, ValueError):
        return None


def normalise_times(
    df: DataFrame, id_column: str, source: str, zone: str, date_columns: tuple[str, str, str], fields: list[TimeField],
    run_length: int = 65_536,
) -> DataFrame:
    """(id, column_name, text, format, status, utc_us): one row per record and field.

    A text without an offset is local time in ``zone`` (a zone name or an offset) or else in the zone its field names. An
    anchored field whose anchor a clock change makes uncertain still resolves where both readings give the same instant.
    """
    names = [f.column for f in fields]
    cols = [id_column, zone, *date_columns, *names, *[f.zone for f in fields]]
    width = len(fields)
    order = ["__source", "c0", *[f"c{5 + i}" for i in range(width)], "c1"]
    rows = df.select(F.col(f"`{source}`").cast("string").alias("__source"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition and place in it, so numbers rise along the order; a run is so many places of a partition.
    place = F.monotonically_increasing_id()
    bits = F.shiftright(place, 33)
    run_no = bits * (1 << 33) + F.floor((place - bits * (1 << 33)) / run_length)
    rows = written(rows.withColumns({"__place": place, "__run": run_no.cast("bigint")}), "ordered")
    kind = df.schema[id_column].dataType.simpleString()
    shape = ["id", "column_name", "text", "format", "status", "utc_us", "run", "open", "edge", "source"]

    def decode(group: pa.Table, settled: list[tuple[int, int] | None] | None) -> pa.Table:
        group = group.sort_by("__place")
        col = [group.column(f"c{i}").to_pylist() for i in range(5 + 2 * width)]
        days = [day_number(*x) for x in zip(*col[2:5])]
        options = [[readings(t) for t in col[5 + j]] for j in range(width)]
        edges = [None if settled else ends(o, days) for o in options]
        is_open = any(e is not None and (len(e[0]) > 1 or len(e[1]) > 1) for e in edges)
        picked = [viterbi(o, days, *((settled[j] if settled else None) or (None, None))) for j, o in enumerate(options)]
        out: list[list] = [[] for _ in range(6)]
        for i, ident in enumerate(col[0]):
            known: dict[str, list[int]] = {}
            for j, f in enumerate(fields):
                r = picked[j][i]
                zone_text = col[1][i] if col[1][i] and col[1][i].strip() else col[5 + width + j][i]
                status, instants = resolve(r, zone_text, days[i], f.rule, known.get(f.anchor) if f.anchor else None)
                known[f.column] = instants
                for k, v in enumerate((ident, f.column, col[5 + j][i], FORMATS[r[0]] if r else None, status, instants[0] if status == "ok" else None)):
                    out[k].append(v)
        n = len(out[0])
        notes = [] if settled else [(f.column, json.dumps(e)) for f, e in zip(fields, edges) if e is not None]
        for name, note in notes:
            for k, v in enumerate((None, name, None, None, None, None)):
                out[k].append(v)
        src, number = group.column("__source")[0].as_py(), group.column("__run")[0].as_py()
        total = n + len(notes)
        return pa.Table.from_arrays(
            [
                pa.array(out[0], group.schema.field("c0").type), *[pa.array(x, pa.string()) for x in out[1:5]], pa.array(out[5], pa.int64()),
                pa.array([number] * total, pa.int64()), pa.array([is_open] * total), pa.array([None] * n + [e for _, e in notes], pa.string()),
                pa.array([src] * total, pa.string()),
            ],
            shape,
        )

    schema = f"id {kind}, column_name string, text string, format string, status string, utc_us bigint, run bigint, open boolean, edge string, source string"
    done = written(rows.groupBy("__source", "__run").applyInArrow(lambda t: decode(t, None), schema), "decoded")
    result = [c for c in shape if c not in ("run", "open", "edge", "source")]
    sure = done.where("edge is null and not open").select(*result)

    def chained(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")
        runs = [json.loads(e) for e in group.column("edge").to_pylist()]
        both = chain(runs)
        t = group.select(["source", "run", "column_name"])
        t = t.append_column("first", pa.array([i for i, _ in both], pa.int32())).append_column("last", pa.array([j for _, j in both], pa.int32()))
        return t.filter(group.column("open"))

    edges = done.where("edge is not null").select("source", "run", "column_name", "open", "edge")
    ended = edges.groupBy("source", "column_name").applyInArrow(chained, "source string, run bigint, column_name string, first int, last int")
    pair = [F.max(F.when(F.col("column_name") == n, F.struct("first", "last"))).alias(f"e{j}") for j, n in enumerate(names)]
    ended = ended.groupBy(F.col("source").alias("__s"), F.col("run").alias("__r")).agg(*pair)
    again = rows.join(ended, (F.col("__run") == F.col("__r")) & F.col("__source").eqNullSafe(F.col("__s"))).drop("__s", "__r")

    def redecode(group: pa.Table) -> pa.Table:
        found = [group.column(f"e{j}")[0].as_py() for j in range(width)]
        return decode(group, [None if e is None else (e["first"], e["last"]) for e in found])

    mended = again.groupBy("__source", "__run").applyInArrow(redecode, schema).select(*result)
    return sure.unionByName(mended).withColumnRenamed("id", id_column)

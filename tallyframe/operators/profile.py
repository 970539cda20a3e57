"""Data-quality profile of every column per load: nulls, distinct values, range, disallowed values, drift between loads.

Stage 1 reads footers and dictionary pages only: exact nulls and extrema of every column chunk, and its distinct candidates. A
numeric column with at most ``NARROW`` candidates in all chunks is counted value by value, so its distinct count is exact.

Stage 2 goes through the row groups and reads of each only the chunks whose statistics aren't enough. A chunk that is all
null, or constant and without nulls, follows from the footer and the rows per load; where the row group belongs to one load
(by the load's own statistics), that number too is in the footer, and a constant chunk may then hold nulls; such chunks
aren't read. The others are read as dictionary codes (texts straight from the pages' dictionaries) and counted by code and load,
so a value is looked at once per chunk and load, not once per row, and rules are applied to the counted values.

Texts, columns with a rule and narrow numbers are counted by value. Other numbers have per load their range, counts in
logarithmic buckets and, for distinct values, ``REGISTERS`` maxima (standard error 1.04 / sqrt(REGISTERS)), merged within a
task and again per load.

Every column has a drift. Columns with a rule are compared by its buckets, texts by value, other numbers by fixed buckets: a
sign and an eighth of an octave, dates and timestamps by day. Fixed buckets need no pass and no sample to find, are the same
in every load and at every size, and let profiles of different days be compared.

Defined results: a null load is a load of its own; a load without allowed values has no drift (null); a column without a
rule has null disallowed values; an empty table gives no rows; repeated rows count each time; NaN is a value of its own
and in no range; columns of nested types are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import discard, numeric, written
from tallyframe.sources.footers import ChunkStatistics, chunk_statistics, files_of, statistics_of

NARROW = 512
REGISTERS = 4096
OCTAVE_PARTS = 8
FLUSH = 20_000
DAY_US = 86_400_000_000


@dataclass
class Rule:
    """``allowed`` says which known values may occur; ``bucket`` the share a value counts to (default: itself), a number for
    numeric columns and a text for others."""

    allowed: Callable[[Column], Column]
    bucket: Callable[[Column], Column] | None = None


def one_of(values: list) -> Rule:
    return Rule(lambda v: v.isin(values))


def steps(*edges: int) -> Callable[[Column], Column]:
    """Bucket by lower edges: the number of edges at or below the value."""
    return lambda v: sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _number(kind: T.DataType, value: Column) -> Column | None:
    """The value as a double, or none for a column that is treated as text."""
    if numeric(kind.simpleString()):
        return value.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    return None


# --- counting within a task ------------------------------------------------------------------------------------------


def numbers_of(values: pa.Array) -> np.ndarray:
    """Known values as numbers: dates as days, timestamps as microseconds."""
    if pa.types.is_timestamp(values.type):
        return values.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
    if pa.types.is_date(values.type):
        return values.cast(pa.date32()).cast(pa.int32()).to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(values.type):
        values = values.cast(pa.float64())
    return values.to_numpy(zero_copy_only=False)


def buckets_of(values: pa.Array) -> np.ndarray:
    """The fixed bucket of each value: 0 for zero, else a signed eighth of an octave; days for dates and timestamps."""
    x = numbers_of(values)
    if pa.types.is_timestamp(values.type):
        return x // DAY_US
    if pa.types.is_date(values.type):
        return x.astype(np.int64)
    size = np.abs(x.astype(np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.floor(np.log2(size) * OCTAVE_PARTS)
    part = np.where(np.isfinite(part), part, 8191 * OCTAVE_PARTS) + 2048 * OCTAVE_PARTS  # infinity and NaN beyond all others
    return np.where(size == 0, 0, np.where(np.isnan(size), 1 << 40, np.sign(np.nan_to_num(x)) * part)).astype(np.int64)


def registers_of(values: pa.Array, load: np.ndarray, loads: int) -> np.ndarray:
    """Per load the maxima of a distinct sketch of the values."""
    x = numbers_of(values)
    x = (x.astype(np.float64) + 0.0).view(np.uint64) if x.dtype.kind == "f" else x.astype(np.int64).view(np.uint64)
    h = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    place = (h % np.uint64(REGISTERS)).astype(np.int64)
    rank = (53 - np.floor(np.log2(((h >> np.uint64(12)) + np.uint64(1)).astype(np.float64)))).astype(np.uint8)
    out = np.zeros(loads * REGISTERS, np.uint8)
    np.maximum.at(out, load * REGISTERS + place, rank)
    return out.reshape(loads, REGISTERS)


def estimate(registers: np.ndarray) -> int:
    """Distinct values from the maxima."""
    m = float(REGISTERS)
    empty = int((registers == 0).sum())
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.power(2.0, -registers.astype(float)).sum()
    return round(m * np.log(m / empty) if raw <= 2.5 * m and empty else raw)


def tally(a: np.ndarray, b: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their counts, ``b`` being below ``kinds``."""
    key = a.astype(np.int64) * kinds + b
    size = (int(a.max()) + 1) * kinds if len(a) else 0
    if size <= 4 * len(a) + 4096:
        n = np.bincount(key, minlength=size)
        k = np.flatnonzero(n)
        n = n[k]
    else:
        k, n = np.unique(key, return_counts=True)
    return k // kinds, k % kinds, n


COUNTS = "load string, column_no int, is_null boolean, value string, bucket bigint, n bigint, lo double, hi double, sketch binary"
_TYPES = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
_NAMES = [w.split()[0] for w in COUNTS.split(", ")]


def as_text(values: pa.Array) -> pa.Array:
    if pa.types.is_timestamp(values.type):
        values = values.cast(pa.timestamp("us"))
    return values.cast(pa.string())


class _Scan:
    """The row groups of one task: rows of ``COUNTS``, sketches merged by load and column."""

    def __init__(self, columns: list[str], load: str, by_value: set[str], texts: set[str], distinct: bool):
        self.columns, self.load, self.by_value, self.texts, self.distinct = columns, load, by_value, texts, distinct
        self.sketches: dict[tuple[str | None, int], np.ndarray] = {}
        self.rows: list[list] = []

    def add(self, load: list, no: int, null: bool, value, bucket, n, lo=None, hi=None) -> None:
        k = len(load)
        lo, hi = (x if x is not None else [None] * k for x in (lo, hi))
        self.rows.append([load, [no] * k, [null] * k, value, bucket, n, lo, hi, [None] * k])

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array([x for part in c for x in part], t) for c, t in zip(cols, _TYPES)], _NAMES)

    def flushed(self) -> None:
        for (load, no), r in self.sketches.items():
            self.rows.append([[load], [no], [False], [None], [None], [0], [None], [None], [r.tobytes()]])
        self.sketches.clear()

    def group(self, f: pq.ParquetFile, g: int) -> None:
        stats = statistics_of(f.metadata, g, [self.load, *self.columns])
        size = f.metadata.row_group(g).num_rows
        if not size:
            return
        own = stats[self.load]
        pure = own.nulls == 0 and own.lo is not None and own.lo == own.hi or own.nulls == size
        known = {c: stats[c].nulls == size or (stats[c].lo is not None and stats[c].lo == stats[c].hi and (pure and stats[c].nulls is not None or stats[c].nulls == 0)) for c in self.columns}
        read = [c for c in self.columns if not known[c]]
        table = f.read_row_group(g, columns=[*([] if pure else [self.load]), *(c for c in read if c != self.load)])
        if pure:
            loads, codes = [None if own.nulls == size else own.text], np.zeros(size, np.int64)
        else:
            d = table.column(self.load).combine_chunks().dictionary_encode()
            loads = [*as_text(d.dictionary).to_pylist(), None]
            codes = d.indices.fill_null(len(loads) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        per_load = np.bincount(codes, minlength=len(loads))
        for no, c in enumerate(self.columns):
            if known[c]:
                self.from_footer(no, c, stats[c], f.schema_arrow.field(c).type, loads, per_load, size)
            else:
                self.count(no, c, table.column(c).combine_chunks(), loads, codes)

    def from_footer(self, no: int, c: str, s: ChunkStatistics, kind: pa.DataType, loads: list, per_load: np.ndarray, size: int) -> None:
        some = np.flatnonzero(per_load)
        if s.nulls:  # all of them, or the nulls of the one load
            nulls = per_load[some] if s.nulls == size else [s.nulls]
            self.add([loads[k] for k in some], no, True, [None] * len(some), [None] * len(some), [int(n) for n in nulls])
        if s.nulls < size:
            n = per_load[some] - s.nulls
            kind = kind.value_type if pa.types.is_dictionary(kind) else kind
            self.known_values(no, c, pa.array([s.lo], kind), loads, some, np.zeros(len(some), np.int64), n)

    def count(self, no: int, c: str, values: pa.Array, loads: list, codes: np.ndarray) -> None:
        if values.null_count:
            null = values.is_null().to_numpy(zero_copy_only=False)
            some, n = np.unique(codes[null], return_counts=True)
            self.add([loads[k] for k in some], no, True, [None] * len(some), [None] * len(some), n.tolist())
            values, codes = values.drop_null(), codes[~null]
        if not len(values):
            return
        if c in self.by_value:
            d = values if pa.types.is_dictionary(values.type) else values.dictionary_encode()
            self.known_values(no, c, d.dictionary, loads, *tally(codes, d.indices.to_numpy(zero_copy_only=False), len(d.dictionary)))
        else:
            self.wide(no, values, loads, codes)

    def known_values(self, no: int, c: str, values: pa.Array, loads: list, load: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
        if c not in self.by_value:
            self.wide(no, values.take(pa.array(value)), loads, load, n)
            return
        text = as_text(values).to_pylist()
        bucket = [None] * len(text) if c in self.texts else buckets_of(values).tolist()
        self.add([loads[k] for k in load], no, False, [text[k] for k in value], [bucket[k] for k in value], n.tolist())

    def wide(self, no: int, values: pa.Array, loads: list, codes: np.ndarray, weight: np.ndarray | None = None) -> None:
        x, bucket = numbers_of(values).astype(np.float64), buckets_of(values)
        kinds, at = np.unique(bucket, return_inverse=True)
        key, inv = np.unique(codes * len(kinds) + at, return_inverse=True)
        n = np.bincount(inv, weight).astype(np.int64)
        lo, hi = np.full(len(key), np.inf), np.full(len(key), -np.inf)
        np.fmin.at(lo, inv, x)
        np.fmax.at(hi, inv, x)
        ranged = [[v if lo[i] <= hi[i] else None for i, v in enumerate(side.tolist())] for side in (lo, hi)]
        self.add([loads[k] for k in key // len(kinds)], no, False, [None] * len(key), kinds[key % len(kinds)].tolist(), n.tolist(), *ranged)
        if self.distinct:
            some, own = np.unique(codes, return_inverse=True)
            for k, r in zip(some, registers_of(values, own, len(some))):
                old = self.sketches.get((loads[k], no))
                self.sketches[loads[k], no] = r if old is None else np.maximum(old, r)


def scan(spark: SparkSession, groups: DataFrame, columns: list[str], load: str, by_value: set[str], texts: set[str], strings: list[str], distinct: bool) -> DataFrame:
    """``COUNTS`` of the row groups (file, row_group), several to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scan(columns, load, by_value, texts, distinct)
        for b in batches:
            per_file: dict[str, list[int]] = {}
            for uri, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                per_file.setdefault(uri, []).append(g)
            for uri, numbers in per_file.items():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    pf = pq.ParquetFile(f, read_dictionary=strings)
                    for g in numbers:
                        s.group(pf, g)
                        if len(s.sketches) > FLUSH:
                            s.flushed()
                        yield s.batch()
        s.flushed()
        yield s.batch()

    tasks = 4 * spark.sparkContext.defaultParallelism
    return groups.select("file", "row_group").repartition(tasks, "file", "row_group").mapInArrow(run, COUNTS)


# --- the profile -----------------------------------------------------------------------------------------------------


def settled(load: str) -> Column:
    """A chunk that isn't read: by its footer all null, or constant and of one load, or constant without nulls."""
    pure = F.coalesce((F.col("load_lo") == F.col("load_hi")) & (F.col("load_nulls") == 0), F.lit(False))
    constant = (F.col("lo") == F.col("hi")) & F.when(pure, F.col("n_null").isNotNull()).otherwise(F.col("n_null") == 0)
    return F.coalesce(F.col("n_null") == F.col("n_rows"), F.lit(False)) | F.coalesce(constant, F.lit(False))


def chunk_report(spark: SparkSession, path: str, load: str, columns: list[str] | None = None) -> DataFrame:
    """Per column: chunks, those that the profile doesn't read, and those whose dictionary names all their values."""
    df = spark.read.parquet(path)
    ch = chunk_statistics(files_of(df), columns or [c for c in flat_columns(df.schema) if c != load], load, NARROW)
    return ch.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("chunks"), F.count(F.when(settled(load), 1)).alias("settled"), F.count("candidates").alias("narrow_dictionaries"),
    )


def flat_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]


def profile(spark: SparkSession, path: str, load: str, rules: dict[str, Rule] | None = None, columns: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """One row per load and column: rows, nulls, distinct count (and whether it is exact), range, disallowed, drift.

    ``drift`` is half the sum of absolute differences between a load's shares of allowed values (or of their buckets) and
    the shares of all loads together. Without a rule every value is allowed. Range: numbers (dates and timestamps as days and
    microseconds) in ``min_num``, ``max_num``, texts in ``min_text``, ``max_text``. ``load_id`` names the load.
    """
    rules = rules or {}
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema}
    flat = flat_columns(df.schema)
    columns = [c for c in flat if c != load] if columns is None else columns
    if bad := [c for c in [load, *columns] if c not in flat]:
        raise ValueError(f"no flat columns {bad}")
    texts = {c for c in columns if _number(kinds[c], F.col(f"`{c}`")) is None}
    free = [c for c in columns if c not in texts and c not in rules]
    chunks = written(chunk_statistics(files_of(df), columns if distinct else columns[:1], load, NARROW if distinct else 0), "chunks")
    narrow = narrow_columns(chunks, free) if distinct and free else set()
    groups = chunks.select("file", "row_group").distinct()
    counted = written(scan(spark, groups, columns, load, texts | set(rules) | narrow, texts, [c for c in columns if isinstance(kinds[c], T.StringType)], distinct), "counts")
    discard(chunks)
    return summarise(counted, columns, kinds, kinds[load], rules, narrow, texts, distinct)


def narrow_columns(chunks: DataFrame, columns: list[str]) -> set[str]:
    """Columns all of whose chunks tell their values and whose values are few."""
    mine = chunks.where(F.col("column_name").isin(columns))
    told = mine.groupBy("column_name").agg(
        F.max(F.col("candidates").isNull() & F.coalesce(F.col("n_null") < F.col("n_rows"), F.lit(True))).alias("unknown"),
        F.max(F.coalesce(F.size("candidates"), F.lit(0))).alias("most"),
    )
    few = told.where(~F.col("unknown") & (F.col("most") <= NARROW)).select("column_name")
    union = mine.join(few, "column_name").select("column_name", F.explode("candidates").alias("v")).groupBy("column_name").agg(F.count_distinct("v").alias("k"))
    return {r.column_name for r in union.where(F.col("k") <= NARROW).collect()}


def _judged(no: int, c: str, kind: T.DataType, rule: Rule | None, text: bool) -> Column:
    """Of one column's counted value: whether it is allowed, the bucket it counts to, and its number."""
    v = F.col("value").try_cast(kind)
    number = _number(kind, v)
    ok = F.coalesce(rule.allowed(v), F.lit(False)) if rule else F.lit(True)
    if rule:
        bucket = (rule.bucket(v) if rule.bucket else v).cast("string")
    else:
        bucket = F.col("value") if text else F.col("bucket").cast("string")
    num = F.lit(None).cast("double") if number is None else F.nanvl(number, F.lit(None).cast("double"))
    return F.when(F.col("column_no") == no, F.struct((~ok).alias("is_bad"), bucket.alias("share"), num.alias("num")))


def summarise(
    counted: DataFrame, columns: list[str], kinds: dict[str, T.DataType], load_kind: T.DataType, rules: dict[str, Rule], narrow: set[str],
    texts: set[str], distinct: bool,
) -> DataFrame:
    by_value = [i for i, c in enumerate(columns) if c in texts or c in rules or c in narrow]
    is_value = F.col("column_no").isin(by_value) if by_value else F.lit(False)
    is_text = F.col("column_no").isin([i for i, c in enumerate(columns) if c in texts] or [-1])
    cells = counted.where("sketch is null").groupBy("load", "column_no", "is_null", "value", "bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    known = cells.where(is_value & ~F.col("is_null"))
    x = F.coalesce(*[_judged(i, columns[i], kinds[columns[i]], rules.get(columns[i]), columns[i] in texts) for i in by_value], F.struct(F.lit(False).alias("is_bad"), F.lit(None).cast("string").alias("share"), F.lit(None).cast("double").alias("num")))
    text = F.when(is_text, F.col("value"))
    named = ["load", "column_no", "is_null", "is_bad", "share", "n", "lo", "hi", "lo_text", "hi_text", "kinds"]
    known = known.withColumn("x", x).select("load", "column_no", "is_null", "x.is_bad", "x.share", "n", F.col("x.num").alias("lo"), F.col("x.num").alias("hi"), text.alias("lo_text"), text.alias("hi_text"), F.lit(1).cast("bigint").alias("kinds"))
    none = F.lit(None)
    rest = cells.where(~is_value | F.col("is_null")).select(
        "load", "column_no", "is_null", F.lit(False).alias("is_bad"), F.col("bucket").cast("string").alias("share"), "n", "lo", "hi",
        none.cast("string").alias("lo_text"), none.cast("string").alias("hi_text"), F.lit(0).cast("bigint").alias("kinds"),
    )
    one = known.select(*named).unionByName(rest.select(*named)).groupBy("load", "column_no", "is_null", "is_bad", "share").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_text").alias("lo_text"),
        F.max("hi_text").alias("hi_text"), F.sum("kinds").alias("kinds"),
    )
    one = written(one, "shares")  # loads x columns x buckets rows; read several times below
    tallied = one.where(~F.col("is_null") & ~F.col("is_bad") & F.col("share").isNotNull()).select("load", "column_no", "share", "n")
    per_load = tallied.groupBy(F.col("load").alias("__l"), F.col("column_no").alias("__c")).agg(F.sum("n").alias("own_n"))
    totals = tallied.groupBy("column_no").agg(F.sum("n").alias("all_n"))
    every = F.sum("n").over(Window.partitionBy("column_no", "share")) / F.col("all_n")
    same = F.col("load").eqNullSafe(F.col("__l")) & (F.col("column_no") == F.col("__c"))
    shared = tallied.join(totals, "column_no").withColumn("every", every).join(per_load, same)
    # Shares that a load lacks add the share of all loads, so the sum over the load's own buckets is enough.
    gaps = shared.groupBy("load", "column_no").agg(F.sum(F.abs(F.col("n") / F.col("own_n") - F.col("every")) - F.col("every")).alias("gap"))
    both = one.unionByName(gaps, allowMissingColumns=True)
    if distinct and len(by_value) < len(columns):

        def merge(key: tuple, t: pa.Table) -> pa.Table:
            best = np.zeros(REGISTERS, np.uint8)
            for r in t.column("sketch").to_pylist():
                best = np.maximum(best, np.frombuffer(r, np.uint8))
            return pa.table({"load": pa.array([key[0].as_py()], pa.string()), "column_no": pa.array([key[1].as_py()], pa.int32()), "kinds": pa.array([estimate(best)], pa.int64())})

        sketches = counted.where("sketch is not null").groupBy("load", "column_no").applyInArrow(merge, "load string, column_no int, kinds bigint")
        both = both.unionByName(sketches, allowMissingColumns=True)
    n = F.coalesce("n", F.lit(0))
    out = both.groupBy("load", "column_no").agg(
        F.sum(n).alias("n_rows"), F.sum(F.when(F.col("is_null"), n).otherwise(0)).alias("n_null"), F.sum("kinds").alias("n_distinct"),
        F.min("lo").alias("min_num"), F.max("hi").alias("max_num"), F.min("lo_text").alias("min_text"), F.max("hi_text").alias("max_text"),
        F.sum(F.when(F.col("is_bad"), n).otherwise(0)).alias("n_bad"), (0.5 * (1 + F.sum("gap"))).alias("drift"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    ruled = F.col("column_no").isin([i for i, c in enumerate(columns) if c in rules] or [-1])
    bad = F.when(ruled, F.col("n_bad"))
    return out.select(
        F.col("load").cast(load_kind).alias("load_id"), F.element_at(names, F.col("column_no") + 1).alias("column_name"), "n_rows", "n_null",
        (F.col("n_null") / F.col("n_rows")).alias("null_share"),
        (F.coalesce("n_distinct", F.lit(0)) if distinct else F.when(is_value, F.coalesce("n_distinct", F.lit(0)))).alias("n_distinct"),
        is_value.alias("distinct_exact"), "min_num", "max_num", "min_text", "max_text", bad.alias("n_disallowed"),
        (bad / F.nullif(F.col("n_rows") - F.col("n_null"), F.lit(0))).alias("disallowed_share"), "drift",
    )


def footer_profile(spark: SparkSession, path: str, load: str, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls and extrema of whole columns from footers alone; null where some chunk has no exact statistics."""
    df = spark.read.parquet(path)
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    ch = chunk_statistics(files_of(df), columns, load, 0)
    known = F.min(F.col("lo").isNotNull() | (F.coalesce(F.col("n_null"), F.lit(-1)) == F.col("n_rows")))
    is_num = F.col("column_name").isin([c for c in columns if numeric(kinds[c].simpleString())])
    out = ch.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.when(F.count("n_null") == F.count(F.lit(1)), F.sum("n_null")).alias("n_null"),
        F.min(F.when(F.col("lo").isNotNull(), F.struct(F.when(is_num, F.col("lo").try_cast("double")).alias("d"), F.col("lo").alias("s"))))["s"].alias("min_value"),
        F.max(F.when(F.col("hi").isNotNull(), F.struct(F.when(is_num, F.col("hi").try_cast("double")).alias("d"), F.col("hi").alias("s"))))["s"].alias("max_value"),
        known.alias("exact"),
    )
    return out.select(
        "column_name", "n_rows", "n_null", F.when(F.col("exact"), F.col("min_value")).alias("min_value"),
        F.when(F.col("exact"), F.col("max_value")).alias("max_value"),
    )

"""Delimited records parsed by structural indexing, failing ones set apart with the reason.

Arrow batches of lines become one byte buffer. Quote positions and their running parity per record tell which commas are
structural; commas and record ends give field bounds; the bytes that stay are copied once into one contiguous column of
all fields, which typed checks then read column by column. No shuffle, no per-row Python.

Results for odd input: a null line counts as an empty one; a final carriage return and blanks around a value never fail;
an empty value or NA is null. Columns of the input that clash with record fields don't matter, as the fields come out
inside one struct column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, COMMA, RETURN = 34, 44, 13

Check = Callable[[pa.Array], np.ndarray]


def matches(pattern: str) -> Check:
    """A check that a text value matches ``pattern`` (RE2); true means it fails."""
    return lambda col: ~pc.fill_null(pc.match_substring_regex(col, pattern), True).to_numpy(zero_copy_only=False)


def hhmm(col: pa.Array) -> np.ndarray:
    """Fails unless the number is a time from 0 to 2400 with minutes below 60."""
    v = pc.fill_null(col, 0).to_numpy(zero_copy_only=False)
    return (v < 0) | (v > 2400) | (v % 100 >= 60)


class Index:
    """Structural index of a batch: field bounds of each record and whether its quoting holds."""

    def __init__(self, lines: pa.Array, delimiter: int = COMMA):
        lines = pc.fill_null(lines.cast(pa.large_string()), "")
        if isinstance(lines, pa.ChunkedArray):
            lines = lines.combine_chunks()
        n = self.n = len(lines)
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1] if n else np.zeros(1, np.int64)
        body = lines.buffers()[2]
        self.data = data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts, ends = offsets[:-1], offsets[1:].copy()
        some = ends > starts
        ends[some] -= data[ends[some] - 1] == RETURN
        self.starts, self.ends = starts, ends

        quotes = np.flatnonzero(data == QUOTE)
        rec = np.searchsorted(offsets, quotes, "right") - 1
        first = np.searchsorted(quotes, starts)
        opening = (np.arange(len(quotes)) - first[rec]) % 2 == 0 if len(quotes) else np.zeros(0, bool)
        padded = np.concatenate([[0], data, [0]])
        before, after = padded[quotes], padded[quotes + 2]
        last = quotes + 1 == ends[rec]  # what follows is the next record's
        ok = np.where(opening, (quotes == starts[rec]) | (before == delimiter) | (before == QUOTE), last | (after == delimiter) | (after == QUOTE))
        self.bad_quotes = np.bincount(rec, minlength=n) % 2 == 1
        self.bad_quotes[rec[~ok]] = True

        commas = np.flatnonzero(data == delimiter)
        crec = np.searchsorted(offsets, commas, "right") - 1
        outside = (np.searchsorted(quotes, commas) - first[crec]) % 2 == 0 if len(commas) else np.zeros(0, bool)
        self.commas, self.crec = commas[outside], crec[outside]
        self.width = np.bincount(self.crec, minlength=n) + 1
        self.dropped_quotes = quotes[opening | last | (after != QUOTE)]

    def fields(self, good: np.ndarray, width: int) -> pa.Array:
        """All fields of the ``good`` records, each of ``width`` fields, as one text column in record order."""
        keep = np.zeros(len(self.data) + 1, bool)
        delta = np.zeros(len(self.data) + 1, np.int64)
        s, e = self.starts[good], self.ends[good]
        np.add.at(delta, s, 1)
        np.add.at(delta, e, -1)
        keep[:-1] = np.cumsum(delta)[:-1] > 0
        inner = self.commas[good[self.crec]]
        keep[inner] = False
        keep[self.dropped_quotes] = False
        prefix = np.concatenate([[0], np.cumsum(keep)])
        heads = np.empty((len(s), width), np.int64)
        heads[:, 0] = s
        heads[:, 1:] = inner.reshape(len(s), width - 1) + 1
        offsets = np.append(prefix[heads.ravel()], prefix[-1]).astype(np.int64)
        body = np.ascontiguousarray(self.data[keep[:-1]])
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))


def integers(col: pa.Array, bits: int) -> tuple[pa.Array, np.ndarray]:
    """Whole numbers from text: optional sign, ASCII digits, within ``bits``; and which values fail."""
    fits = pc.fill_null(pc.match_substring_regex(col, r"^[+-]?[0-9]+$"), True).to_numpy(zero_copy_only=False).copy()
    plain = pc.replace_substring_regex(col, r"^[+]?(-?)0*([0-9]+)$", r"\1\2")
    top = 1 << (bits - 1)
    length = pc.fill_null(pc.utf8_length(plain), 0).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(fits & (length > 18)):  # may not fit 64 bits: rare, so one by one
        fits[i] = bits == 64 and length[i] <= 20 and -top <= int(plain[i].as_py()) < top
    nums = pc.if_else(pa.array(fits), plain, pa.scalar(None, col.type)).cast(pa.int64())
    if bits < 64:
        fits &= pc.fill_null(pc.and_(pc.greater_equal(nums, -top), pc.less_equal(nums, top - 1)), True).to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(fits), nums, pa.scalar(None, pa.int64())), ~fits


def parse_batch(
    lines: pa.Array, schema: T.StructType, checks: dict[str, Check], nulls: tuple[str, ...] = ("", "NA"),
) -> tuple[pa.Array, pa.Array, dict[str, pa.Array]]:
    """Per line: the first reason that applies (``quoting``, ``columns``, ``value`` or null), the first failing field, typed fields."""
    ix, width = Index(lines), len(schema)
    reason = np.full(ix.n, None, object)
    reason[ix.width != width] = "columns"
    reason[ix.bad_quotes] = "quoting"
    good = ~ix.bad_quotes & (ix.width == width)
    rows = np.flatnonzero(good)
    cells = ix.fields(good, width)
    cells = pc.ascii_trim(cells, characters=" \t")
    cells = pc.if_else(pc.is_in(cells, pa.array(nulls, cells.type)), pa.scalar(None, cells.type), cells)
    failed_at = np.full(len(rows), width)
    cols: dict[str, pa.Array] = {}
    back = np.full(ix.n, -1)
    back[rows] = np.arange(len(rows))
    place = pa.array(back, mask=back < 0)
    for j, f in enumerate(schema):
        col = cells.take(pa.array(np.arange(j, len(rows) * width, width)))
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            col, bad = integers(col, 32 if isinstance(f.dataType, T.IntegerType) else 64)
            col = col.cast(pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64())
        else:
            col, bad = col.cast(pa.string()), np.zeros(len(rows), bool)
        if f.name in checks:
            bad = bad | checks[f.name](col)
        failed_at[bad] = np.minimum(failed_at[bad], j)
        cols[f.name] = col
    wrong = failed_at < width
    reason[rows[wrong]] = "value"
    field = np.full(ix.n, None, object)
    field[rows[wrong]] = np.array(schema.names, object)[failed_at[wrong]]
    ok = pa.array(np.isin(np.arange(ix.n), rows[~wrong]))
    typed = {}
    for name, c in cols.items():
        wide = c.take(place)
        typed[name] = pc.if_else(ok, wide, pa.scalar(None, wide.type))
    return pa.array(reason, pa.string()), pa.array(field, pa.string()), typed


def parse_records(
    df: DataFrame, line: str, schema: T.StructType, checks: dict[str, Check] | None = None,
    keep: list[str] | None = None, values: bool = True,
) -> DataFrame:
    """``keep`` columns, ``reason`` and ``field`` (null for a valid line) and, with ``values``, the struct ``record``.

    ``schema`` may hold int, bigint and string fields. A valid line has all its typed fields in ``record``; a failing
    one has a null ``record``. Names in ``keep`` must not be ``reason``, ``field`` or ``record``.
    """
    keep = [c for c in df.columns if c != line] if keep is None else keep
    clash = {"reason", "field", "record"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"rename columns {sorted(clash)} first")
    for f in schema:
        if not isinstance(f.dataType, (T.IntegerType, T.LongType, T.StringType)):
            raise ValueError(f"unsupported field type {f.dataType.simpleString()}")
    checks = checks or {}
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{line}`").alias("__line"))
    fields = [df.schema[c] for c in keep] + [T.StructField("reason", T.StringType()), T.StructField("field", T.StringType())]
    if values:
        fields.append(T.StructField("record", T.StructType([T.StructField(f.name, f.dataType) for f in schema])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reason, field, typed = parse_batch(b.column(b.num_columns - 1), schema, checks)
            out = [*b.columns[:-1], reason, field]
            names = [*b.schema.names[:-1], "reason", "field"]
            if values:
                out.append(pa.StructArray.from_arrays(list(typed.values()), list(typed), mask=pc.is_valid(reason)))
                names.append("record")
            yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, T.StructType(fields))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects with reason and field)."""
    kept = [c for c in parsed.columns if c not in ("reason", "field", "record")]
    return parsed.where("reason is null").select(*kept, "record.*"), parsed.where("reason is not null").select(*kept, "reason", "field")

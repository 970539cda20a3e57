"""Parquet footers and dictionary pages, read by the executors: statistics of column chunks without decoding their data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, row_group int, n_rows bigint, column_name string, n_null bigint, lo string, hi string, load_lo string, load_hi string, load_nulls bigint, candidates array<string>"


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[i]
        i += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, i
        shift += 7


def _header(buf: bytes, i: int = 0) -> tuple[dict[int, object], int]:
    """A compact-protocol struct of integers, booleans and structs as {field id: value}, and where it ends."""
    out: dict[int, object] = {}
    at = 0
    while True:
        head = buf[i]
        i += 1
        if head == 0:
            return out, i
        kind = head & 15
        if head >> 4:
            at += head >> 4
        else:
            z, i = _varint(buf, i)
            at = (z >> 1) ^ -(z & 1)
        if kind in (1, 2):
            out[at] = kind == 1
        elif kind in (4, 5, 6):
            z, i = _varint(buf, i)
            out[at] = (z >> 1) ^ -(z & 1)
        elif kind == 12:
            out[at], i = _header(buf, i)
        else:
            raise ValueError("not a page header of integers")


def dictionary(f: pa.NativeFile, chunk: pq.ColumnChunkMetaData, most: int) -> list | None:
    """The values of a chunk's dictionary page: the chunk's distinct candidates. Null where there is none or it is larger than ``most``."""
    if not chunk.has_dictionary_page or chunk.dictionary_page_offset is None:
        return None
    size = chunk.data_page_offset - chunk.dictionary_page_offset
    if size <= 0 or size > 1 << 20:
        return None
    raw = f.read_at(size, chunk.dictionary_page_offset)
    head, at = _header(raw)
    n = head[7][1]
    if n > most:
        return None
    body = raw[at : at + head[3]]
    if chunk.compression != "UNCOMPRESSED":
        body = pa.Codec(chunk.compression.lower()).decompress(body, head[2]).to_pybytes()
    kind = {"INT32": np.int32, "INT64": np.int64, "DOUBLE": np.float64, "FLOAT": np.float32}.get(chunk.physical_type)
    if kind:
        return np.frombuffer(body, kind, n).tolist()
    if chunk.physical_type != "BYTE_ARRAY":
        return None
    out, i = [], 0
    for _ in range(n):
        k = int.from_bytes(body[i : i + 4], "little")
        out.append(body[i + 4 : i + 4 + k].decode("utf-8", "replace"))
        i += 4 + k
    return out


def _text(v: object) -> str | None:
    return None if v is None else v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)


def _exact(st, side: str) -> bool:
    """False where the writer may have cut a long text short."""
    flag = getattr(st, f"is_{side}_value_exact", None)
    return flag is not False


@dataclass
class ChunkStatistics:
    """Of one chunk: nulls, and extrema where they are exact; null where the footer doesn't tell. ``text``: ``lo`` as text."""

    nulls: int | None
    lo: object
    hi: object

    @property
    def text(self) -> str | None:
        return _text(self.lo)


def statistics_of(meta: pq.FileMetaData, group: int, columns: list[str]) -> dict[str, ChunkStatistics]:
    where = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    rg = meta.row_group(group)
    out = {}
    for c in columns:
        st = rg.column(where[c]).statistics if c in where else None
        exact = st is not None and st.has_min_max and _exact(st, "min") and _exact(st, "max")
        out[c] = ChunkStatistics(
            st.null_count if st is not None and st.has_null_count else None, st.min if exact else None, st.max if exact else None,
        )
    return out


def read_file(uri: str, columns: list[str], load: str, most: int) -> Iterator[tuple]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        where = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            stats = statistics_of(meta, g, [load, *columns])
            ls = stats[load]
            for c in columns:
                if c in where:
                    values = dictionary(f, rg.column(where[c]), most) if most else None
                    st = stats[c]
                    yield (uri, g, rg.num_rows, c, st.nulls, _text(st.lo), _text(st.hi), _text(ls.lo), _text(ls.hi), ls.nulls, None if values is None else [_text(v) for v in values])


def files_of(df: DataFrame) -> DataFrame:
    """(file): the files of a table that hold rows, by a scan that reads no column; no list of them passes through the driver."""
    return df.select(F.col("_metadata.file_path").alias("file")).distinct()


def chunk_statistics(files: DataFrame, columns: list[str], load: str, most: int = 512) -> DataFrame:
    """One row per column chunk of ``files``."""
    names = files.select("file").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, F.col("file"))
    order = [w.split()[0] for w in SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = list(read_file(uri, columns, load, most))
                cols = list(zip(*rows)) if rows else [()] * len(order)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], order)

    return names.mapInArrow(run, SCHEMA)

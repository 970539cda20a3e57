"""``FrameManager``: one session, the catalog of named frames, SQL, loading and persistence."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.frame import Frame
from tallyframe.operators.relational import rows_text
from tallyframe.plans import sqlfront
from tallyframe.schema import parse_columns
from tallyframe.session import build_session, shared_dir, ship
from tallyframe.sources import delimited


class FrameManager:
    def __init__(self, spark: SparkSession | None = None, warehouse: str | None = None):
        self.spark = spark or build_session()
        ship(self.spark)
        self.frames: dict[str, Frame] = {}
        self._warehouse = warehouse

    def new_frame(self, df: DataFrame, name: str | None = None) -> Frame:
        return self.add(Frame(self, df), name)

    def add(self, frame: Frame, name: str | None = None) -> Frame:
        """Register under ``name`` (one is made up if it's missing), also as a temp view."""
        frame.name = name or frame.name or f"tbl_{uuid.uuid4().hex}"
        self.frames[frame.name] = frame
        frame.df.createOrReplaceTempView(frame.name)
        return frame

    def get(self, name: str) -> Frame:
        if name not in self.frames:
            if not self.spark.catalog.tableExists(name):
                raise KeyError(f"no frame named {name!r}")
            self.frames[name] = Frame(self, self.spark.table(name), name)
        return self.frames[name]

    def list_frames(self) -> list[str]:
        return sorted(self.frames)

    def rename(self, frame: Frame, name: str) -> Frame:
        if frame.name in self.frames:
            del self.frames[frame.name]
            self.spark.catalog.dropTempView(frame.name)
        return self.add(frame, name)

    def copy_from(self, *_args, **_kw):
        raise NotImplementedError("copying from another manager is not supported")

    def read_parquet(self, path: str, name: str | None = None) -> Frame:
        return self.new_frame(self.spark.read.parquet(path), name)

    def load_file(self, path: str, sep: str = ",", has_header: bool = False) -> Frame:
        return self.new_frame(delimited.load_file(self.spark, path, sep, has_header))

    def _select(self, text: str, this: Frame | None) -> DataFrame:
        if "@this" in text:
            if this is None:
                raise ValueError("@this needs a frame")
            text = text.replace("@this", "__this__")
        stmt = sqlfront.parse(text)
        if not isinstance(stmt, sqlfront.Select):
            raise ValueError("a SELECT is needed here")
        return sqlfront.plan(stmt, lambda n: this.df if n == "__this__" else self.get(n).df)

    def sql2frame(self, text: str, this: Frame | None = None, names: list[str] | None = None) -> Frame:
        df = self._select(text, this)
        return self.new_frame(df.toDF(*names) if names else df)

    def sql(self, text: str, max_rows: int | None = None, this: Frame | None = None) -> list[str]:
        """Rows as tab-joined texts, all of them or the first ``max_rows``; CREATE and LOAD answer ``["0"]``."""
        if text.lstrip()[:6].lower() == "create" or text.lstrip()[:4].lower() == "load":
            stmt = sqlfront.parse(text)
            if isinstance(stmt, sqlfront.Create):
                self.new_frame(self.spark.createDataFrame([], parse_columns(stmt.columns)), stmt.name)
            else:
                schema = self.get(stmt.table).df.schema
                df = delimited.load_into(self.spark, stmt.path, schema, stmt.sep, stmt.null, stmt.empty, stmt.defaults)
                self.new_frame(df, stmt.table)
            return ["0"]
        return [r.row_text for r in rows_text(self._first(text, max_rows, this)).collect()]

    def sql_typed(self, text: str, max_rows: int | None = None, this: Frame | None = None) -> list:
        return self._first(text, max_rows, this).collect()

    def _first(self, text: str, max_rows: int | None, this: Frame | None) -> DataFrame:
        df = self._select(text, this)
        return df if max_rows is None else df.limit(max_rows)

    def warehouse(self) -> str:
        return self._warehouse or os.path.join(shared_dir(self.spark), "frames")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def persist(self, frame: Frame, namespace: str | None = None, name: str | None = None) -> str:
        if not frame.persistable:
            raise ValueError("the frame isn't persistable")
        name = name or frame.name or self.add(frame).name
        path = "/".join([self.warehouse(), namespace or "default", name])
        frame.df.write.mode("overwrite").parquet(path)
        return path

    def load_persisted(self, name: str, namespace: str = "default") -> Frame:
        return self.read_parquet("/".join([self.warehouse(), namespace, name]), name)

    def unpersist(self, name: str, namespace: str = "default") -> bool:
        p, fs = self._fs("/".join([self.warehouse(), namespace, name]))
        return fs.delete(p, True)

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def list_namespaces(self) -> list[str]:
        return self._names(self.warehouse())

    def list_items(self, namespace: str = "default") -> list[str]:
        return self._names("/".join([self.warehouse(), namespace]))

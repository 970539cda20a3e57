"""``Frame``: a named DataFrame with the engine's operators as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.operators import aggregate as A
from tallyframe.operators import binning as B
from tallyframe.operators import missing as N
from tallyframe.operators import relational as R
from tallyframe.operators import sampling, stats, transform


class Frame:
    """Operators return a new Frame; after ``set_mutable(True)`` the in-place ones (``drop_na``, ``fill_na``,
    ``remove_columns``, ``binning``, transforms) also rebind this one."""

    def __init__(self, manager, df: DataFrame, name: str | None = None):
        self.manager, self.df, self.name, self.mutable, self.persistable = manager, df, name, False, True

    def _new(self, df: DataFrame, in_place: bool = False) -> Frame:
        df = S.copy_marks(self.df, df)
        if in_place and self.mutable:
            self.df = df
            if self.name:
                df.createOrReplaceTempView(self.name)
            return self
        return Frame(self.manager, df)

    def set_mutable(self, on: bool) -> Frame:
        self.mutable = on
        return self

    @property
    def num_rows(self) -> int:
        return self.df.count()

    @property
    def num_columns(self) -> int:
        return len(self.df.columns)

    @property
    def column_names(self) -> list[str]:
        return list(self.df.columns)

    def column(self, name: str):
        return self.df.schema[name]

    def column_index(self, name: str) -> int:
        return self.df.columns.index(name)

    def copy(self) -> Frame:
        out = Frame(self.manager, S.copy_marks(self.df, self.df.select("*")))
        out.persistable = self.persistable
        return out

    def sql(self, text: str) -> Frame:
        """``@this`` stands for this frame."""
        return self.manager.sql2frame(text, this=self)

    def sql_rows(self, text: str, max_rows: int | None = None) -> list[str]:
        return self.manager.sql(text, max_rows, this=self)

    def project(self, *columns: str) -> Frame:
        return self._new(R.project(self.df, *columns))

    def remove_columns(self, *columns: str) -> Frame:
        return self._new(R.remove_columns(self.df, *columns), True)

    remove_column = remove_columns

    def head(self, n: int) -> list:
        return self.df.limit(n).collect()

    def top(self, n: int, column: str, order: str = "desc") -> list:
        return R.top(self.df, n, column, order).collect()

    def subset(self, columns: list[str], where: str | None = None) -> Frame:
        return self._new(R.subset(self.df, columns, where))

    def join(self, other: Frame, how: str | None = None, by=None, by_left=None, by_right=None) -> Frame:
        return self._new(R.join(self.df, other.df, how, by, by_left, by_right))

    def merge(self, other: Frame) -> Frame:
        return self._new(R.merge(self.df, other.df))

    def aggregate(self, spec: str) -> dict[str, list[float]]:
        return A.aggregate_map(self.df, spec)

    xtabs = aggregate

    def aggregate_on_column(self, fn: str, column: str) -> float:
        return A.aggregate_on_column(self.df, fn, column).first()[0]

    def group_by(self, groups: list[str], aggregates: list[str] | None = None):
        return A.Grouped(self.df, groups) if aggregates is None else self._new(A.group_by(self.df, groups, aggregates))

    def correlation(self, x: str, y: str) -> float:
        return A.correlation(self.df, x, y).first()[0]

    def covariance(self, x: str, y: str) -> float:
        return stats.covariance(self.df, x, y).first()[0]

    def summary(self) -> list:
        return stats.summary(self.df).orderBy("column_no").collect()

    def simple_summary(self) -> list:
        return stats.simple_summary(self.df).collect()

    def five_num_summary(self, columns: list[str] | None = None, exact: bool = True) -> list:
        return stats.five_num(self.df, columns, exact).orderBy("column_no").collect()

    def quantiles(self, column: str, probs: list[float], exact: bool = True) -> list[float]:
        return [r.value for r in stats.quantiles(self.df, column, probs, exact).orderBy("prob").collect()]

    def mean(self, column: str) -> float:
        return stats.mean(self.df, column).first()[0]

    def variance(self, column: str):
        return stats.variance(self.df, column).first()

    def histogram(self, column: str, bins: int, even: bool = False) -> list:
        return stats.histogram(self.df, column, bins, even).orderBy("x").collect()

    approx_histogram = histogram

    def binning(self, column: str, kind: str, bins=None, breaks=None, include_lowest=True, right=True, exact=True) -> Frame:
        return self._new(B.binning(self.df, column, kind, bins, breaks, include_lowest, right, exact), True)

    def drop_na(self, by: str = "row", how: str = "any", thresh: int = 0, columns=None) -> Frame:
        return self._new(N.drop_na(self.df, by, how, thresh, columns), True)

    def fill_na(self, value=None, method=None, fn=None, values=None, columns=None) -> Frame:
        return self._new(N.fill_na(self.df, value, method, fn, values, columns), True)

    def set_as_factor(self, column: str | int) -> Frame:
        self.df = S.set_as_factor(self.df, column)
        return self

    def string_columns_as_factors(self, columns=None) -> Frame:
        self.df = S.string_columns_as_factors(self.df, columns)
        return self

    def factor_counts(self) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {c: {} for c in S.factors(self.df)}
        for r in S.factor_counts(self.df).collect():
            out[r.column_name][r.level] = r.n
        return out

    def level_map(self, column: str) -> dict[str, int]:
        """Levels of a factor in order, numbered from 1: those it was given, else the values there are."""
        meta = self.df.schema[column].metadata or {}
        levels = meta.get("levels") or sorted(S.factor_counts(self.df, [column]).toPandas()["level"])
        return {v: i + 1 for i, v in enumerate(levels)}

    def sample(self, n: int, replace: bool = False, seed: int = 0) -> list:
        return sampling.sample_rows(self.df, n, replace, seed).collect()

    def sample_fraction(self, fraction: float, replace: bool = False, seed: int = 0) -> Frame:
        return self._new(sampling.sample_fraction(self.df, fraction, replace, seed))

    def cv_kfold(self, k: int, seed: int = 0):
        return [(self._new(a), self._new(b)) for a, b in sampling.cv_kfold(self.df, k, seed)]

    def cv_random(self, k: int, training: float, seed: int = 0):
        return [(self._new(a), self._new(b)) for a, b in sampling.cv_random(self.df, k, training, seed)]

    def transform(self, assignment: str) -> Frame:
        return self._new(transform.transform_expr(self.df, assignment), True)

    def transform_batches(self, fn, schema: str) -> Frame:
        """User code from pandas batches to pandas batches."""
        return self._new(transform.transform_batches(self.df, fn, schema), True)

    def map_reduce(self, map_fn, reduce, value_type: str = "double", combine: bool = True) -> Frame:
        return self._new(transform.map_reduce(self.df, map_fn, reduce, value_type, combine))

    def scale_minmax(self) -> Frame:
        return self._new(transform.scale_minmax(self.df), True)

    def scale_standard(self) -> Frame:
        return self._new(transform.scale_standard(self.df), True)

    def train(self, algorithm: str, **params):
        from tallyframe.operators import ml

        return ml.train(self.df, algorithm, **params)

    def predict(self, model, has_labels: bool = False, include_features: bool = True) -> Frame:
        return self._new(model.transform(self.df, has_labels, include_features))

    def confusion_matrix(self, model, threshold: float = 0.5) -> list[list[int]]:
        from tallyframe.operators import ml

        return ml.confusion_matrix(self.df, model, threshold)

    def rows_text(self) -> DataFrame:
        return R.rows_text(self.df)

    def cache(self) -> Frame:
        self.df = self.df.cache()
        return self

    def persist(self, namespace: str | None = None, name: str | None = None) -> str:
        return self.manager.persist(self, namespace, name)

    def count_known(self, column: str) -> int:
        return self.df.agg(F.count(column)).first()[0]

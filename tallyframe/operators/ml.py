"""A thin machine-learning facade over Spark ML. Rows with a null are left out of training; the first column is the label."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "__features"


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="skip").transform(df)


def to_matrix(df: DataFrame) -> DataFrame:
    """All columns as one array of doubles per row, rows with a null dropped."""
    return features(df, df.columns).select(vector_to_array(FEATURES).alias("values"))


class Model:
    """A trained predictor with the columns it reads."""

    def __init__(self, kind: str, raw, columns: list[str], negative: float = 0.0):
        self.kind, self.raw, self.columns, self.negative = kind, raw, columns, negative

    def transform(self, df: DataFrame, has_labels: bool = False, include_features: bool = True) -> DataFrame:
        """Input columns plus ``yPredict``; only the prediction (and the label, if there is one) without the features."""
        if self.kind in ("als", "centroids"):
            out = self.raw.transform(df).withColumnRenamed("prediction", "yPredict")
        else:
            out = self.raw.transform(features(df, self.columns)).withColumnRenamed("prediction", "yPredict")
        y = F.col("yPredict").cast("double")
        if self.kind == "svm" and self.negative:
            y = F.when(y == 0.0, F.lit(self.negative)).otherwise(y)
        label = [df.columns[0]] if has_labels else []
        return out.select(*(df.columns if include_features else label), y.alias("yPredict"))


def svm(df: DataFrame, iterations: int = 100, regularization: float = 0.01, tolerance: float = 1e-4) -> Model:
    """Linear SVM. Labels of -1 and 1 (or 0 and 1) in the first column.

    Solved by a quasi-Newton method over the whole table, which needs no blocks, step size or seed.
    """
    label, cols = df.columns[0], df.columns[1:]
    rows = df.dropna()
    low = rows.agg(F.min(F.col(label).cast("double"))).first()[0]
    data = features(rows, cols).withColumn("__label", (F.col(label).cast("double") > 0).cast("double"))
    raw = LinearSVC(featuresCol=FEATURES, labelCol="__label", maxIter=iterations, regParam=regularization, tol=tolerance).fit(data)
    return Model("svm", raw, cols, low if low is not None and low < 0 else 0.0)


def mlr(df: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> Model:
    label, cols = df.columns[0], df.columns[1:]
    data = features(df.dropna(), cols).withColumn("__label", F.col(label).cast("double"))
    return Model("mlr", LinearRegression(featuresCol=FEATURES, labelCol="__label", maxIter=iterations, tol=tolerance).fit(data), cols)


def als(df: DataFrame, factors: int = 10, regularization: float = 0.1, iterations: int = 10, blocks: int = 10, seed: int = 0) -> Model:
    """Columns by position: user, item, rating."""
    u, i, r = df.columns[:3]
    raw = ALS(
        userCol=u, itemCol=i, ratingCol=r, rank=factors, regParam=regularization, maxIter=iterations,
        numUserBlocks=blocks, numItemBlocks=blocks, seed=seed, coldStartStrategy="nan",
    ).fit(df.select(u, i, r).dropna())
    return Model("als", raw, [u, i])


class Centroids:
    """Cluster centres with the nearest-centre prediction as one expression."""

    def __init__(self, columns: list[str], centres: list[list[float]]):
        self.columns, self.centres = columns, centres

    def nearest(self):
        x = [F.col(f"`{c}`").cast("double") for c in self.columns]
        far = [F.struct(sum(((a - F.lit(float(b))) ** 2 for a, b in zip(x, c)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        return (far[0] if len(far) == 1 else F.least(*far))["i"]

    def transform(self, df: DataFrame) -> DataFrame:
        known = df.dropna(subset=self.columns)
        return known.withColumn("prediction", self.nearest())


def lloyd(df: DataFrame, centroids: list[list[float]], iterations: int = 10) -> Model:
    """k-means from given centres: a fixed number of rounds, each one aggregation; a centre without rows stays."""
    cols = list(df.columns)
    if not centroids or any(len(c) != len(cols) for c in centroids):
        raise ValueError("every centre needs a number per column")
    raw = Centroids(cols, [[float(v) for v in c] for c in centroids])
    rows = df.dropna()
    for _ in range(iterations):
        new = rows.groupBy(raw.nearest().alias("__i")).agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{k}") for k, c in enumerate(cols)]).collect()
        for r in new:  # one row per cluster
            raw.centres[r["__i"]] = [r[f"m{k}"] for k in range(len(cols))]
    return Model("centroids", raw, cols)


def plus_plus(df: DataFrame, clusters: int, seed: int = 1) -> list[list[float]]:
    """First centres of k-means++: each one a row drawn with a chance in proportion to its squared distance from the others.

    A draw is one aggregation: the row with the largest log(u) / weight, u being a hash of row and seed. Fewer distinct rows
    than clusters give as many centres.
    """
    cols = list(df.columns)
    rows = df.dropna().select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    at = [F.col(f"c{i}") for i in range(len(cols))]
    centres: list[list[float]] = []
    for n in range(clusters):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), *at), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
        far = [sum(((a - F.lit(b)) ** 2 for a, b in zip(at, c)), F.lit(0.0)) for c in centres]
        weight = F.lit(1.0) if not far else far[0] if len(far) == 1 else F.least(*far)
        r = rows.withColumn("w", weight).where("w > 0").agg(F.max_by(F.struct(*at), F.log(u) / F.col("w")).alias("x")).first().x
        if r is None:
            break
        centres.append([float(v) for v in r])
    if not centres:
        raise ValueError("no row without a null")
    return centres


def k_means(df: DataFrame, clusters: int, iterations: int = 10, init: str = "k-means||", seed: int = 1, centroids: list[list[float]] | None = None, init_rounds: int = 2) -> Model:
    """``init`` is ``random``, ``k-means||`` (in ``init_rounds`` rounds) or ``k-means++``; ``centroids`` are given first centres."""
    if centroids is None and init == "k-means++":
        centroids = plus_plus(df, clusters, seed)
    if centroids is not None:
        return lloyd(df, centroids, iterations)
    cols = list(df.columns)
    raw = KMeans(featuresCol=FEATURES, k=clusters, maxIter=iterations, initMode=init, initSteps=init_rounds, tol=0.0, seed=seed).fit(features(df.dropna(), cols))
    return Model("kmeans", raw, cols)


ALGORITHMS = {"svm": svm, "mlr": mlr, "als": als, "kmeans": k_means}


def train(df: DataFrame, name: str, **params) -> Model:
    try:
        fn = ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown algorithm {name!r}") from None
    return fn(df, **params)


def confusion(df: DataFrame, truth: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """One row with tp, fn, fp, tn; positive means above the threshold. Rows with a null on either side are left out."""
    t, p = F.col(truth) > threshold, F.col(predicted) > threshold
    cells = {"tp": t & p, "fn": t & ~p, "fp": ~t & p, "tn": ~t & ~p}
    return df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in cells.items()])


def confusion_matrix(df: DataFrame, model: Model, threshold: float = 0.5) -> list[list[int]]:
    r = confusion(model.transform(df), df.columns[0], "yPredict", threshold).first()
    return [[r.tp, r.fn], [r.fp, r.tn]]


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """r2, rmse and the mean residual in one pass."""
    e = F.col(truth) - F.col(predicted)
    rows = df.where(e.isNotNull())
    return rows.agg((1 - F.sum(e * e) / (F.var_pop(truth) * F.count(F.lit(1)))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_residual"))


def roc(df: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """(threshold, tpr, fpr) at ``steps`` + 1 even thresholds over the range of the scores, from one small histogram."""
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    span = rows.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi")).first()
    spark = df.sparkSession
    if span.lo is None:
        return spark.createDataFrame([], "threshold double, tpr double, fpr double")
    width = (span.hi - span.lo) / steps or 1.0
    bin_no = F.least(F.lit(steps), F.floor((F.col(score) - F.lit(span.lo)) / F.lit(width))).cast("int")
    got = rows.groupBy(bin_no.alias("b")).agg(F.count(F.when(F.col(truth) > 0, 1)).alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    pos, neg = [0] * (steps + 1), [0] * (steps + 1)
    for r in got:  # at most steps + 1 rows
        pos[r.b], neg[r.b] = r.pos, r.n - r.pos
    all_pos, all_neg = sum(pos), sum(neg)
    out = [(span.lo + i * width, sum(pos[i:]) / all_pos if all_pos else 0.0, sum(neg[i:]) / all_neg if all_neg else 0.0) for i in range(steps + 1)]
    return spark.createDataFrame(out, "threshold double, tpr double, fpr double")

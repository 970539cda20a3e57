"""Session helpers: settings that hold on a cluster, the shared working folder, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tallyframe", **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC on; ``conf`` overrides anything (underscores stand for dots)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so their Python finds it wherever it is installed here."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyframe-"), "tallyframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._tallyframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. Set here only where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_LEFT: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor never recomputes what came before; columns stay prunable, filters pushable.
    The table is deleted by ``discard``, where an operator knows that no later plan reads it, or else by ``clean``, which
    also runs when the driver's Python ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if not _LEFT:
        atexit.register(clean)
    _LEFT[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written`` that no plan still to run reads."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path in _LEFT:
            _delete(_LEFT.pop(path), path)


def clean() -> None:
    """Delete every table that ``written`` made and nobody discarded: call it when all results have been used."""
    while _LEFT:
        path, spark = _LEFT.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the context may be gone; then its folder is its owner's to clear
            pass


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table with at least a partition per core, for steps that compute much per row. Large tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def numeric(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")

"""Session helpers. Operators never change the session; only entry points call these."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(app: str = "faresight", cores: str | int = "*", **conf: str) -> SparkSession:
    """Session for tests and the benchmark. A cluster supplies its own master and sizes."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where that setting is absent, falls back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, "faresight", f"{name}-{os.urandom(6).hex()}")
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix=f"faresight-{name}-")


#: Spark removes the files of a query's shuffles when the query ends; without it, when the driver's JVM next collects garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is run inside go when that query ends. The session is as before afterwards."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SWEEP)
        else:
            spark.conf.set(_SWEEP, before)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, in whatever store it is."""
    store, at = _folder(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``work_dir`` whose tables nobody reads any more."""
    store, at = _folder(spark, path)
    store.delete(at, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes checkpoints possible: the cluster's folder where it names one, else a local session's own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or work_dir(spark, "checkpoint"))

"""Tables, and the shared folder in which long plans are cut.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
session without that setting (a test, a laptop) gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = (
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "spark.sql.shuffleDependency.fileCleanup.enabled",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lumisift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_LOCK = threading.Lock()
_HELD: dict = {}  # by application: how many statements are inside, and the settings before the first


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the statements inside are deleted as each one ends.

    Jobs in several threads may be inside at once: the first sets the session, the last sets it back.
    """
    app = spark.sparkContext.applicationId
    with _LOCK:
        n, old = _HELD.get(app, (0, {}))
        if not n:
            old = {k: spark.conf.get(k, None) for k in _FREE_SHUFFLES}
            for k in _FREE_SHUFFLES:
                spark.conf.set(k, "true")
        _HELD[app] = (n + 1, old)
    try:
        yield
    finally:
        with _LOCK:
            n, old = _HELD[app]
            _HELD[app] = (n - 1, old)
            if n == 1:
                for k, v in old.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, ends the lineage, and gives later
    plans a real size for their join choices.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`cut` that nothing will read again."""
    path = getattr(df, "cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

"""Tables written in the folder that driver and executors share, to cut lineage: later jobs neither recompute them nor lose them with an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _OWN[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed by discard() or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame | str) -> None:
    """Deletes what materialise() or fresh_path() made, once nothing reads it any more."""
    path = df if isinstance(df, str) else getattr(df, "_lectern_path", None)
    if path and (spark := _WRITTEN.pop(path, None)):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_WRITTEN):
        try:
            discard(path)
        except Exception:  # noqa: BLE001  the session has ended, and with it the way to its files
            return

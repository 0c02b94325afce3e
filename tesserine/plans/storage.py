"""Tables written to the folder that driver and executors share, to cut lineage or to be read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserine-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_paths: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _paths.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:  # the session is gone: the folder's owner clears it
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  a folder that can't be cleared fails no query
        pass


@atexit.register
def _clear() -> None:
    for path in list(_paths):
        _remove(path)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs no earlier stage.
    Its shuffle files go as soon as it is written, so stages don't add up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserine-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    _paths[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for t in tables:
        _remove(t._written_to)


def tables_since(known: set[str] | None = None) -> set[str]:
    """The paths of the written tables that are not among ``known``."""
    return set(_paths) - (known or set())


def discard_paths(paths: set[str]) -> None:
    for p in paths:
        _remove(p)

"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to drop the shuffle files of an execution at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all executors run on this machine (tests, local mode)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postloom-"))
    return sc.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage starts at those files,

    so a lost executor costs only the tasks that ran on it. The shuffle files of the write are removed as soon as it
    is done, the files themselves by ``release``, ``release_all`` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (df.repartition(*keys) if keys else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._postloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of ``tables`` that ``written`` gave, once everything made of them is written itself."""
    paths = {t._postloom_path for t in tables}
    for spark, path in [w for w in _written if w[1] in paths]:
        _delete(spark, path)
        _written.remove((spark, path))


def release_all() -> None:
    """Deletes every written table: for long sessions, between queries whose results are saved."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    try:
        release_all()
    except Exception:  # the session may be gone already
        return

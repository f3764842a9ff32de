"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a Parquet table into ``spark.checkpoint.dir``. A lost executor therefore never loses an
intermediate result, and a long chain of rounds never has to be recomputed.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and the session has one machine (tests).

    A session on a cluster without a checkpoint folder is an error: a machine-local folder would lose tables.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="cohortlab-")
    context.setCheckpointDir(own)
    return shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortlab/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has materialized; no result that reads them may be in use any more."""
    for session, path in _written:
        if session is spark:
            _delete(spark, path)
    _written[:] = [x for x in _written if x[0] is not spark]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system Spark knows, whole or absent: it is written beside its place and renamed."""
    fs, target = _fs(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

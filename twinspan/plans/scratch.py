"""Tables written between the stages of a plan.

A stage boundary that several later stages read is written as Parquet below the folder that the
session names in spark.checkpoint.dir, which every executor shares. Writing cuts the lineage, so that
a lost executor costs the tasks it ran and not the stages before, and it keeps a count of rows and
bytes at hand for the plan that follows.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one is made only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="twinspan-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{root(spark)}/twinspan/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def keep(spark: SparkSession, path: str) -> None:
    """What lies there is deleted when the process ends."""
    _written.append((spark, path))


def free(*tables: DataFrame | None) -> None:
    """Delete saved tables that no later plan reads; whatever else is given is left alone."""
    gone = {path for x in tables if (path := getattr(x, "_saved_at", None))}
    for spark, path in [x for x in _written if x[1] in gone]:
        _written.remove((spark, path))
        delete(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: what a Python worker holds stays bounded, however long a text or sequence.

    The same for all operators, so that it doesn't matter which was built last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans whose results are saved.

    Its cleaner acts when the driver's garbage is collected, which a driver with little to do may put
    off for the whole of a long plan; until then every stage's files stay on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear() -> None:
    """Delete every table that was saved; DataFrames that read them can't be used afterwards."""
    while _written:
        delete(*_written.pop())


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    """A path of any file system that Spark knows, with that file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    where, files = _place(spark, path)
    return files.getContentSummary(where).getLength()


def read_start(spark: SparkSession, path: str, count: int) -> bytes:
    """A file's first few bytes."""
    where, files = _place(spark, path)
    stream = files.open(where)
    try:
        return bytes(x for x in (stream.read() for _ in range(count)) if x >= 0)
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        where, files = _place(spark, path)
        files.delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file from the driver."""
    where, files = _place(spark, path)
    out = files.create(where, True)
    try:
        for at in range(0, len(data), 1 << 22):
            out.write(bytearray(data[at : at + (1 << 22)]))
    finally:
        out.close()


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes the rows of one task, a column of text, as one file and not as a folder of files."""
    spark = lines.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    lines.write.text(parts)
    folder, files = _place(spark, parts)
    found = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")]
    if len(found) > 1:
        raise ValueError("lines of one file must lie in one task")
    delete(spark, path)
    if found:
        files.rename(found[0], _place(spark, path)[0])
    else:
        write_bytes(spark, path, b"")
    delete(spark, parts)


atexit.register(clear)

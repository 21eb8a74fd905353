"""Helpers that the operators share: words, fresh names, shared-folder scratch, numbering."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits on just this set.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``sf_dir``, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of ``text`` as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each prefixed until no column of ``df`` has it (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one if Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
        folder = tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    folder = folder.rstrip("/")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs a read and not the lineage.

    Spark's cleaner deletes the files when the frame is no longer referenced
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slim(df: DataFrame, rows: int, each: int = 1 << 15, least: int = 8) -> DataFrame:
    """``df`` in fewer tasks if it has few rows: ``each`` rows (measured or bounded by ``rows``) a task, and ``least`` tasks.

    Every exchange writes files for each task before it, so that many tasks with a few
    rows each cost more disk and time than the rows. A narrow step; tables with more rows keep their tasks.
    """
    return df.coalesce(max(least, -(-rows // each)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless ``keep``, it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"
    if not keep:

        def gone() -> None:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, path)

        atexit.register(gone)
    return path


def number(rows: DataFrame, group: list[str], bin_: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the place (long, gapless from 0) of a row in its ``group``, by ``bin_`` and then ``order``.

    No task holds a group: rows are counted by group and bin (combined before the
    shuffle), the counts become offsets in a table of one row a group and bin, and a
    row is then numbered within its bin. ``rows`` must give the same rows each time.
    """
    keys = [*group, bin_]
    count, before = fresh(rows, "_n", "_before")
    counts = rows.groupBy(*keys).agg(F.count("*").alias(count))
    ahead = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias(before))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.join(offsets, keys)
        .withColumn(out, F.col(before) + F.row_number().over(within) - 1)
        .drop(before)
    )


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most ``rows`` rows and, but for single long rows, about ``size`` bytes."""
    for batch in batches:
        lengths = [n or 0 for n in pc.binary_length(batch.column(column).cast(pa.large_binary())).to_pylist()]
        begin = total = 0
        for at, n in enumerate(lengths):
            if at > begin and (at - begin >= rows or total + n > size):
                yield batch.slice(begin, at - begin)
                begin, total = at, 0
            total += n
        if begin < len(lengths):
            yield batch.slice(begin)

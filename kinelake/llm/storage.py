"""Shared scratch storage for intermediate tables.

Lineage is cut with written Parquet tables below ``spark.checkpoint.dir``, a
folder that the driver and every executor share, so a lost executor costs only
its running tasks.  A machine-local folder is used only on a local master where
that setting is absent (tests on one machine); elsewhere its absence is an error.

A scratch folder belongs to whoever made it: ``drop`` removes a table that no
later plan reads, ``delete`` everything, and what is left goes when the session's
JVM ends.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of the Arrow batches handed to Python while a table is written.
ROWS, SIZE = 2000, "16m"
#: Files whose numbers are broadcast to number rows; tables of more files are written with their numbers.
BROADCAST_FILES = 100_000
#: Without its native library, Hadoop starts a process (chmod) for each local file and folder made, and three
#: more for a file with checksums; until such a process runs its command, the JVM's memory counts twice.
#: So local scratch files have no checksum file.  Other file systems are not concerned.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a file have numbers below this.
FILE_ROWS = 1 << 40


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on a local master a temporary one if unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinelake-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the time of a block; those before are put back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bounded(spark: SparkSession, rows: int = ROWS):
    """Settings under which tables are written and small results fetched.

    Arrow batches are bounded by rows and by bytes, a file counts as several times
    its compressed size when Spark decides what to broadcast, and shuffle files go
    when the write that made them has ended.
    """
    return settings(
        spark,
        spark__sql__execution__arrow__maxRecordsPerBatch=str(rows),
        spark__sql__execution__arrow__maxBytesPerBatch=SIZE,
        spark__sql__sources__fileCompressionFactor="10",
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
    )


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``, for functions of plans that run under the caller's settings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: What a Python worker keeps from one task to the next, and other operators' tasks drop.
KEPT: list[dict] = []


def forget() -> None:
    """Drop what this worker keeps."""
    for kept in KEPT:
        kept.clear()


def hand_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow`` in a worker that is small between tasks, as idle workers stay beside the JVM's own stages."""

    @functools.wraps(run)
    def leaving_little(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return leaving_little


class Scratch:
    """A folder of its own below the shared root."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        spark._jvm.java.lang.System.gc()  # Spark then removes the shuffle files of plans that nobody holds
        self.root = f"{shared_root(spark)}/kinelake/{uuid.uuid4().hex}"
        system, where = self._place(self.root)
        system.mkdirs(where)
        system.deleteOnExit(where)

    def _place(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
        """Write ``df`` as Parquet, in Arrow batches of at most ``rows`` where Python takes part, and read it back with the same schema."""
        with bounded(self.spark, rows):
            df.write.options(compression="zstd", **LOCAL_FILES).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            system, where = self._place(self.path(name))
            system.delete(where, True)

    def keep_only(self, *names: str) -> None:
        """Remove all tables but these."""
        system, where = self._place(self.root)
        self.drop(*(n for n in (s.getPath().getName() for s in system.listStatus(where)) if n not in names))

    def delete(self) -> None:
        """Remove everything."""
        system, where = self._place(self.root)
        system.delete(where, True)


def _is_file_scan(df: DataFrame) -> bool:
    """Whether ``df`` is the whole of one Parquet path, so that file and row index name each row once."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and plan.relation().location().rootPaths().length() == 1


def numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc`` (all columns of ``df`` as a struct) and ``uid``, a number of its own for each row that is the same in every run.

    In a Parquet table the number follows from the row's place in its file, so no
    row is copied; only the list of files is written (``files``).  Any other plan
    is written once with its numbers (``rows``).  Both stay in the scratch folder
    for as long as the result is read.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    if _is_file_scan(df):
        place = df.metadataColumn("_metadata")
        files = scratch.table(df.select(place["file_path"].alias("file")).distinct(), "paths")
        if files.count() <= BROADCAST_FILES:
            files = scratch.table(files.select("file", F.row_number().over(Window.orderBy("file")).cast("long").alias("number")), "files")
            scratch.drop("paths")
            rows = df.select(doc, place["file_path"].alias("file"), place["row_index"].alias("row"))
            return rows.join(F.broadcast(files), "file").select("doc", (F.col("number") * FILE_ROWS + F.col("row")).alias("uid"))
        scratch.drop("paths")
    return scratch.table(df.select(doc, F.monotonically_increasing_id().alias("uid")), "rows")

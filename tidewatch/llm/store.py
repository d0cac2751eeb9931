"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all work is on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


#: Rows and bytes of an Arrow batch while a table is written, so that long texts do not add up in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_lock, _writers = threading.Lock(), 0
_before: dict[str, str | None] = {}


class _SmallBatches:
    """The session's batch settings while any thread writes; the last one to end puts them back."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        global _writers
        with _lock:
            _writers += 1
            if _writers == 1:
                _before.update({k: self.conf.get(k, None) for k in BATCH})
                for k, v in BATCH.items():
                    self.conf.set(k, v)

    def __exit__(self, *error: object) -> None:
        global _writers
        with _lock:
            _writers -= 1
            if not _writers:
                for k, v in _before.items():
                    self.conf.unset(k) if v is None else self.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _SmallBatches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`materialise` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables of one operator, deleted together; ``with`` deletes them when its result has been written."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.frames.append(materialise(df, name))
        return self.frames[-1]

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        discard(*frames)
        self.frames = [f for f in self.frames if not any(f is g for g in frames)]

    def clear(self) -> None:
        discard(*self.frames)
        self.frames = []

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table of its own; all tables kept so far are deleted."""
        out = materialise(df, name)
        self.clear()
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.clear()


Batches = Iterator[pa.RecordBatch]


def frugal(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``function`` of a task's batches, which gives the worker's free memory back to the machine when the task ends."""

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, by Spark's own comparison."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

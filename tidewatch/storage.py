"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all work is on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`materialise` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark).split(":")[-1].lstrip("/")
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":")[-1].lstrip("/").startswith(root):
                path = hadoop.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over all rows in the given order, the own row included.

    Rows are dealt by ranges of the order and sorted there; a range adds the
    totals of those before. No task holds more than a range, and the order is
    that of the written table, so a retry changes nothing. Rows that tie in the
    order are summed in any order: group them first.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("_range", F.shiftright("_at", 33)), "ordered")
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums))
    within = W.partitionBy("_range").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop("_at", "_range", *(f"_t_{n}" for n in sums))


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds each row's place from 1 in the given order: the place in its range, and the rows of the ranges before.

    Rows are dealt and written as in :func:`running_sums`, and what is read back needs no sort and no window.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(rows, "ordered").withColumn("_range", F.shiftright("_at", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    totals = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    return rows.join(F.broadcast(totals), "_range").withColumn(name, F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1 + F.col("_n")).drop("_at", "_range", "_n")

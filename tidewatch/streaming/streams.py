"""Structured Streaming forms of the keyed operators, and sinks that repeat without harm."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cases import insert_missing
from ..storage import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, *, files_a_batch: int = 64) -> DataFrame:
    """Event files as a stream; ``files_a_batch`` bounds what one batch takes."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/event[s].parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its output back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        # the file sink only appends: a later batch's rows of a key replace the earlier ones by batch number
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(f"{base}/out" if mode == "append" else f"{base}/out/*")
    return out


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival of each event within the watermark; state goes with it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed sessions of each user: start, end, events, volume."""
    s = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("volume"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "volume")


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return s.select(F.col("w.start").alias("start"), "event_type", "events")


def running_profiles(events: DataFrame) -> DataFrame:
    """Per user, kept across batches: events so far, volume, last event id (update mode)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, volume, last_us, last_id = state.get if state.exists else (0, 0.0, -(2**62), -1)
        for pdf in batches:
            n, volume = n + len(pdf), volume + float(pdf["value"].sum())
            us, i = max(zip(pdf["us"].tolist(), pdf["event_id"].tolist(), strict=True))
            if (us, i) > (last_us, last_id):
                last_us, last_id = us, i
        state.update((n, volume, last_us, last_id))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "volume": [volume], "last_id": [last_id]})

    e = events.select("user_id", "event_id", "value", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, volume double, last_id long", "n long, volume double, last_us long, last_id long", "update", GroupStateTimeout.NoTimeout)


def write_once(target: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the rows whose key the table lacks, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(conf).exists(path):
            batch = insert_missing(spark.read.schema(batch.schema).parquet(target), batch, key)
        else:
            batch = batch.dropDuplicates(key)
        batch.write.mode("append").parquet(target)

    return write


def write_idempotent(target: str, dead_letters: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a key's first payload (``digest``) is appended to the table, equal ones are dropped, others go to the dead letters.

    A repeated batch appends nothing to the table; its conflicts are told by
    (key, digest) and are not written twice either.
    """

    def there(spark: SparkSession, path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key, "digest"])
        known = spark.read.schema(batch.schema).parquet(target).select(key, F.col("digest").alias("_known")) if there(spark, target) else spark.createDataFrame([], batch.select(key, F.col("digest").alias("_known")).schema)
        firsts = batch.groupBy(key).agg(F.min("digest").alias("_first"))
        j = batch.join(known, key, "left").join(firsts, key).withColumn("_first", F.coalesce("_known", "_first"))
        conflicts = j.where("digest <> _first").select(*batch.columns)
        if there(spark, dead_letters):
            conflicts = conflicts.join(spark.read.schema(batch.schema).parquet(dead_letters).select(key, "digest"), [key, "digest"], "left_anti")
        conflicts.write.mode("append").parquet(dead_letters)
        j.where("_known is null and digest = _first").select(*batch.columns).write.mode("append").parquet(target)

    return write

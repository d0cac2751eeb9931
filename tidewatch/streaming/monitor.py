"""How far a stream is: its backlog from source and checkpoint, its state from the store itself, its progress as a table."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.registry import _Files

PROGRESS = "query string, batch long, at string, rows long, rows_per_second double, state_rows long, state_bytes long, dropped_late long, watermark string, duration_ms long"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each finished batch of each query of the session to a table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        states = p.get("stateOperators") or []
        total = lambda k: int(sum(s.get(k, 0) for s in states))
        row = (p["id"], int(p["batchId"]), p["timestamp"], int(p.get("numInputRows", 0)), float(p.get("processedRowsPerSecond", 0.0)), total("numRowsTotal"), total("memoryUsedBytes"), total("numRowsDroppedByWatermark"), (p.get("eventTime") or {}).get("watermark"), int((p.get("durationMs") or {}).get("triggerExecution", 0)))
        self.spark.createDataFrame([row], PROGRESS).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _log_numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in _Files(spark, folder).names() if n.isdigit())


def backlog(spark: SparkSession, checkpoint: str, inputs: Sequence[str]) -> DataFrame:
    """Of each file source of a stream: source, files, done, pending (taken by a batch that has not been committed), undelivered (not taken yet).

    ``inputs`` are the folders in the order of the stream's sources; only files
    of the folder itself count, as for the source. A stream that has never run has taken nothing.
    """
    committed = max(_log_numbers(spark, f"{checkpoint}/commits"), default=-1)
    out = None
    for i, folder in enumerate(inputs):
        log = f"{checkpoint}/sources/{i}"
        names = [n for n in _Files(spark, log).names() if n.split(".")[0].isdigit()]
        entry = "path string, timestamp long, batchId long"
        if names:
            lines = spark.read.text([f"{log}/{n}" for n in names]).where("value like '{%'")
            taken = lines.select(F.from_json("value", entry).alias("e")).select(F.regexp_extract("e.path", "[^/]+$", 0).alias("name"), F.col("e.batchId").alias("batch")).groupBy("name").agg(F.min("batch").alias("batch"))
        else:
            taken = spark.createDataFrame([], "name string, batch long")
        # names only: contents are not read
        there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name")).where(~F.col("name").rlike("^[._]"))
        j = there.join(taken, "name", "left")
        one = j.agg(F.lit(i).alias("source"), F.count("*").alias("files"), F.count_if(F.col("batch") <= committed).alias("done"), F.count_if(F.col("batch") > committed).alias("pending"), F.count_if(F.col("batch").isNull()).alias("undelivered"))
        out = one if out is None else out.unionByName(one)
    return out


def state_keys(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """How many keys the last committed state of an operator holds: partition, keys. Read from the store of a stream, running or not."""
    s = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return s.groupBy("partition_id").agg(F.count("*").alias("keys")).select(F.col("partition_id").alias("partition"), "keys")

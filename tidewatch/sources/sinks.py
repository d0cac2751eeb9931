"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell


def decisions(df: DataFrame, path: str) -> None:
    """Append decisions as Parquet, by day."""
    df.withColumn("day", F.to_date(F.timestamp_micros("us"))).write.mode("append").partitionBy("day").parquet(path)


def csv_export(df: DataFrame, path: str) -> None:
    """Quoted CSV; texts that a spreadsheet would run are defused."""
    df.select(*(csv_cell(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes)).write.csv(path, header=True, quoteAll=True)


def back_test(df: DataFrame, names: list[str], path: str) -> None:
    """JSON lines {id, y, f} with features to 6 digits."""
    values = F.create_map(*(x for n in names for x in (F.lit(n), F.round(F.col(n).cast("double"), 6))))
    df.select(F.col("tx_id").cast("string").alias("id"), F.col("label").alias("y"), values.alias("f")).write.json(path)


def egress(df: DataFrame) -> DataFrame:
    """The few fields that leave the engine."""
    return df.select("tx_id", "us", "cust", "decision", "risk_score", F.array_join("overrides", ",").alias("overrides"), "case_required", "hold_minutes")


def dataset(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables as Parquet below one folder, and a manifest with their rows and columns."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, spark.read.parquet(f"{path}/{name}").count(), df.columns) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, rows long, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def report(draft: DataFrame, path: str) -> None:
    """Suspicious-activity drafts as JSON lines, with the digest that an approver signs."""
    whole = F.to_json(F.struct(*sorted(draft.columns)))
    draft.withColumn("digest", F.sha2(whole, 256)).write.mode("overwrite").json(path)

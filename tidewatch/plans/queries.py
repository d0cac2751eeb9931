"""Queries of the reference's operators and the SQL of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import advice, analysis, documents, evaluation, features, full, graphs, joins, learned, learning, records, signals

PARTS = [features, joins, graphs, analysis, learning, learned, records, signals, evaluation, full, documents, advice]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLES.items()}


def entry(spark: SparkSession) -> DataFrame:
    """How many events each action takes: features, rules, policy."""
    return features.f22_decisions(spark, "/root/testdata/sf0.001").groupBy("decision").agg(F.count("*").alias("events"), F.round(F.avg("risk_score"), 6).alias("mean_risk"))

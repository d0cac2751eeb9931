"""Mergeable sketches of distributions: counts of values in buckets of a fixed relative width.

Bucket i holds the values in (g^(i-1), g^i], with g = (1 + e) / (1 - e), so its
middle is within the share e of every value in it, and a quantile of the sketch
is within the share e of the true one. Negative values have buckets of their own and values
nearer to 0 than ``LEAST`` one in the middle. Sketches are tables: one for each day is
added up to those of weeks or of a whole population, in any order, and what a
sketch costs does not grow with its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Relative error of a value, and the least size that is told from 0.
ERROR, LEAST = 0.01, 1e-9
_G = (1 + ERROR) / (1 - ERROR)
#: Buckets of positive values start here, those of negative ones mirror them.
_OFFSET = 1 - math.ceil(math.log(LEAST) / math.log(_G))


def bucket(value: Column) -> Column:
    """The bucket of a number; buckets are in the order of their values. Null and NaN have none; an infinite value has the last."""
    size = F.least(F.greatest(F.abs(value), F.lit(LEAST)), F.lit(1e300))
    i = F.ceil(F.round(F.log(size) / F.lit(math.log(_G)), 9)).cast("long") + _OFFSET
    return F.when(value.isNull() | F.isnan(value), None).when(F.abs(value) < LEAST, 0).when(value > 0, i).otherwise(-i)


def middle(b: Column) -> Column:
    """The value that stands for a bucket."""
    size = F.pow(F.lit(_G), F.abs(b) - F.lit(_OFFSET)) * F.lit(2 / (1 + _G))
    return F.when(b == 0, 0.0).when(b > 0, size).otherwise(-size)


def sketches(rows: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A sketch of each of ``values`` and of each group: by..., name, bucket, n. One pass over the rows."""
    every = F.array(*(F.struct(F.lit(v).alias("name"), bucket(F.col(v).cast("double")).alias("bucket")) for v in values))
    long = rows.select(*by, F.explode(every).alias("_e")).select(*by, "_e.*").where("bucket is not null")
    return long.groupBy(*by, "name", "bucket").agg(F.count("*").alias("n"))


def merged(of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches added up to those of ``by`` and name."""
    return of.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))


def quantiles(of: DataFrame, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., name, point, value: the value of the lower order statistic at each point, to the sketch's error."""
    keys = [*by, "name"]
    w = W.partitionBy(*keys).orderBy("bucket")
    run = of.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(W.partitionBy(*keys)))
    at = run.withColumn("point", F.explode(F.array(*map(F.lit, map(float, points)))))
    place = F.floor(F.col("point") * (F.col("_all") - 1)) + 1
    return at.where((F.col("_upto") >= place) & (F.col("_upto") - F.col("n") < place)).select(*keys, "point", middle(F.col("bucket")).alias("value"))


def drift(expected: DataFrame, actual: DataFrame, by: Sequence[str] = (), bins: int = 10, smoothing: float = 1e-4) -> DataFrame:
    """by..., name, psi: the population stability index of each group of ``actual`` against ``expected``.

    Bins are cut at the expected deciles, on borders of buckets, so counts on
    both sides are exact; a decile that shares its bucket with another gives no bin of its own.
    Shares are smoothed and renormalised. Names that ``expected`` lacks are left out.
    """
    w = W.partitionBy("name").orderBy("bucket")
    e = expected.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(W.partitionBy("name")))
    # a bucket ends a bin if a decile's order statistic lies in it
    ends = F.array(*(F.floor(F.lit(i / bins) * (F.col("_all") - 1)) + 1 for i in range(1, bins)))
    e = e.withColumn("_end", F.exists(ends, lambda p: (F.col("_upto") >= p) & (F.col("_upto") - F.col("n") < p)))
    edges = e.where("_end").groupBy("name").agg(F.array_sort(F.collect_list("bucket")).alias("_edges"))

    def shares(of: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        b = F.size(F.filter("_edges", lambda x: x < F.col("bucket")))
        return of.join(F.broadcast(edges), "name").groupBy(*keys, "name", b.alias("_b")).agg(F.sum("n").alias(name))

    groups = actual.select(*by, "name").distinct()
    grid = groups.join(F.broadcast(edges), "name").withColumn("_b", F.explode(F.sequence(F.lit(0), F.size("_edges")))).drop("_edges")
    j = grid.join(shares(expected, (), "e"), ["name", "_b"], "left").join(shares(actual, by, "a"), [*by, "name", "_b"], "left").fillna(0, ["e", "a"])
    t = W.partitionBy(*by, "name")
    p, q = ((F.col(c) / F.sum(c).over(t) + smoothing) / (1 + smoothing * F.count("*").over(t)) for c in ("e", "a"))
    return j.withColumn("_psi", (q - p) * F.log(q / p)).groupBy(*by, "name").agg(F.sum("_psi").alias("psi"))

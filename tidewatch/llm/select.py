"""The k-th largest value of a column without sorting it, by refined histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048
#: So many rows at most are sorted to find the last cut; a larger range is refined further.
SORTED_ROWS = 4096


def kth(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value (k from 1) of ``key``, which holds no nulls or NaN; None if there are fewer rows."""
    rows, need = df.select(F.col(key).alias("x")), k
    while True:
        lo, hi, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if n < need:
            return None
        if lo == hi:
            return lo
        if n <= SORTED_ROWS:
            return rows.orderBy(F.desc("x")).limit(need).agg(F.min("x")).first()[0]
        width = (float(hi) - float(lo)) / BINS
        bin_ = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1))
        counts = dict(rows.groupBy(bin_.alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if counts[b] >= need:
                break
            need -= counts[b]
        if len(counts) == 1 or width <= 0:  # neighbouring floats: split at the smaller value
            most = rows.where(F.col("x") == F.lit(hi)).count()
            rows, need = (rows.where(F.col("x") == F.lit(hi)), need) if most >= need else (rows.where(F.col("x") < F.lit(hi)), need - most)
        else:
            rows = rows.where(bin_ == F.lit(b))

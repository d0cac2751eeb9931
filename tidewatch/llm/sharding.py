"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition p draws how many of its rows go to each shard s: the
matrix M[p][s] is one draw of the multivariate hypergeometric law with the row
sums (rows of p) and column sums (rows of s) fixed. Each partition permutes its
rows and deals them out by its line of M; each shard permutes what it receives.
The composition is a uniform permutation of all rows, and no shard can be off
its size by a single row.

Only the row counts of partitions reach the driver. The main path is DataFrame
code.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma, log, log1p, sqrt
from random import Random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import free_name, materialise

#: Rows that one task permutes within a shard, about.
ROWS_A_TASK = 250_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _grown(a: int, d: int) -> float:
    """log gamma(a + d) - log gamma(a) - d log a, without the error of large logarithms."""
    if a < 10**6 or a + d < 10**5:
        return lgamma(a + d) - lgamma(a) - d * log(a)
    return (a + d - 0.5) * log1p(d / a) - d + 1 / (12 * (a + d)) - 1 / (12 * a)


def hypergeometric(rng: Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items without replacement are good; exact for populations of any size.

    Rejection from a flat top with exponential tails, which covers every
    log-concave law: p(mode + i) <= p(mode) min(1, exp(1 + q - q |i|)) for any
    q <= p(mode), and no law on the integers has a highest probability under
    1 / sqrt(1 + 12 variance).
    """
    all_ = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = (draws + 1) * (good + 1) // (all_ + 2)
    share = good / all_
    q = 1 / sqrt(1 + 12 * draws * share * (1 - share) * (all_ - draws) / max(1, all_ - 1))
    up, down = (good - mode + 1) * (draws - mode + 1), (mode + 1) * (bad - draws + mode + 1)
    lean = log1p((up - down) / down)
    w = 1 + q / 2
    while True:
        y = rng.random() * w / q if rng.random() <= w / (1 + w) else (w - log(1 - rng.random())) / q
        i = round(y) * (1 if rng.random() < 0.5 else -1)
        if not low <= mode + i <= high:
            continue
        ratio = i * lean - _grown(mode + 1, i) - _grown(good - mode + 1, -i) - _grown(draws - mode + 1, -i) - _grown(bad - draws + mode + 1, i)
        if log(1 - rng.random()) + min(0.0, w - q * y) <= ratio:
            return mode + i


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: int) -> np.ndarray:
    """M with row sums ``counts`` and column sums ``sizes``, drawn row by row."""
    if sum(counts) != sum(sizes):
        raise ValueError("the shards must hold all rows")
    rng = Random(seed)
    left = [int(n) for n in sizes]
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest, need = sum(left), int(n)
        for s, good in enumerate(left):
            x = hypergeometric(rng, good, rest - good, need)
            out[p, s] = x
            left[s] -= x
            rest, need = rest - good, need - x
    return out


def shuffle_to_shards(df: DataFrame, shards: int, *, seed: int = 17) -> DataFrame:
    """``df`` with the columns ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    Existing columns of those two names are replaced, all others stay whatever
    their names. Equal rows are dealt as separate rows; nulls need no care, as
    no column is a key, and long texts are moved once. An empty table gives an
    empty table. The rows are first written to the shared folder, so that a row's
    number, and with it every draw, is the same in any later read.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    own = [F.col(f"`{c}`") for c in df.columns]
    uid, part, r, upto, z, piece, n, first = (free_name(df, c) for c in ("_uid", "_part", "_r", "_upto", "_z", "_piece", "_n", "_first"))
    rows = materialise(df.withColumn(uid, F.monotonically_increasing_id()), "shard-rows").withColumn(part, F.shiftright(uid, 33))
    counts = {x[part]: x["count"] for x in rows.groupBy(part).count().collect()}  # a row for each input partition
    parts = sorted(counts)
    total = sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, shards), seed)
    plan = spark.createDataFrame([(p, [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)], f"`{part}` long, `{upto}` array<long>")
    local = F.row_number().over(W.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), uid), uid))
    dealt = rows.withColumn(r, local).join(plan, part).withColumn("shard", F.size(F.filter(upto, lambda c: c < F.col(r))))
    pieces = max(4, -(-total // shards // ROWS_A_TASK))
    dealt = dealt.withColumn(z, F.xxhash64(F.lit(seed + 1), uid)).withColumn(piece, F.pmod(z, F.lit(pieces))).select(*own, "shard", uid, z, piece)
    before = W.partitionBy("shard").orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", piece).agg(F.count("*").alias(n)).select("shard", piece, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(W.partitionBy("shard", piece).orderBy(z, uid))
    return dealt.withColumn(n, within).join(offsets, ["shard", piece]).withColumn("slot", F.col(first) + F.col(n) - 1).select(*own, "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int, *, seed: int = 17) -> None:
    """Write ``df`` as one folder a shard, its rows in slot order."""
    shuffle_to_shards(df, shards, seed=seed).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(documents: DataFrame, shards: int = 24, *, seed: int = 17) -> DataFrame:
    """Where each document goes: the law is ``rows`` (counts at most one apart).

    size is the UTF-8 length of the text plus 8 (null: 8), text_crc32 is that
    of the text's bytes (null: of none).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(rows, shards, seed=seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))

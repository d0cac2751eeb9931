"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are packed into blocks; a task scores one block pair as
a matrix product. No score is kept. Each pass recomputes the scores and counts
them in histograms, which are summed over all tasks; the bin holding a query's
k-th best value becomes the range of its next, finer pass, until bins are
single values. A last pass returns the scores above that value and the
smallest identifiers at it. Of a block's histogram a task sends only the top
bins down to its own k-th best score: no lower bin can hold the global one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import discard, materialise

#: Vectors of a query block and of a candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 2048
#: Candidate blocks of a slice at most (on average); every query block meets every slice.
SLICE_BLOCKS = 64
_LOW = np.iinfo(np.int64).min
#: Bits of the score dropped in each pass.
SHIFTS = (14, 7, 0)
#: Vectors with a component from here on are kept in blocks of their own.
_SMALL = 2**20
_BLOCK = "dim int, n int, ids binary, vectors binary"


def _pack(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            dims = np.diff(np.asarray(lists.offsets))
            flat = np.floor(256 * np.asarray(lists.flatten(), np.float64))
            starts = np.concatenate(([0], np.cumsum(dims)))
            large = np.zeros(len(dims), bool)
            large[np.repeat(np.arange(len(dims)), dims)[np.abs(flat) >= _SMALL]] = True
            rows = []
            for dim, wide in sorted({*zip(dims.tolist(), large.tolist(), strict=True)}):
                of = np.flatnonzero((dims == dim) & (large == wide))
                for a in range(0, len(of), size):
                    part = of[a : a + size]
                    vectors = flat[starts[part][:, None] + np.arange(dim)].astype(np.float64 if wide else np.int32)
                    rows.append((dim, len(part), ids[part].astype(np.int64).tobytes(), vectors.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("dim", "n", "ids", "vectors"), r, strict=True)) for r in rows], pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return pack


def _matrix(row: dict, name: str, n: int) -> np.ndarray:
    """Whole numbers, as int32 or, where they are large, as float64."""
    raw = row[name]
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * row["dim"] else np.float64).reshape(n, row["dim"])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond a long are the nearest long but the least."""
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(c).T, _LOW + 1, 2**63 - 1).astype(np.int64)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores, and which of them are of a query with itself."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    return q_ids, c_ids, products(_matrix(row, "q_vectors", len(q_ids)), _matrix(row, "vectors", len(c_ids))), q_ids[:, None] == c_ids[None, :]


def _count(k: int, shift: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Histograms of one pass: bins are scores without ``shift`` bits, within the bin that the pass before (of ``last`` bits) chose."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, _, scores, own = _scores(row)
                scores = np.where(own, _LOW, scores)
                if row["bins"] is not None:
                    want = {s["query_id"]: s["bin"] for s in row["bins"]}
                    bins = np.array([want.get(int(q), _LOW) for q in q_ids])[:, None]
                    scores = np.where((scores >> last == bins) & ~own, scores, _LOW)
                take = min(k, scores.shape[1])
                top = np.partition(scores, scores.shape[1] - take, axis=1)[:, -take:]
                who = np.repeat(np.arange(len(q_ids)), take)
                floor = top.min(axis=1)
                # a bin that the block's own k-th best score falls into is counted whole
                low = np.where(floor == _LOW, _LOW + 1, floor >> shift << shift)
                i, j = np.nonzero(scores >= np.maximum(low, _LOW + 1)[:, None])
                del who, top
                keys, n = np.unique(np.stack([q_ids[i], scores[i, j] >> shift]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n.astype(np.int64))], ["query_id", "bin", "n"])

    return count


def _take(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, scores, own = _scores(row)
                want = {s["query_id"]: s["bin"] for s in row["bins"] or ()}
                kth = np.array([want.get(int(q), np.iinfo(np.int64).max) for q in q_ids])[:, None]
                i, j = np.nonzero((scores > kth) & ~own)
                ti, tj = np.nonzero((scores == kth) & ~own)
                order = np.lexsort((c_ids[tj], ti))
                ti, tj = ti[order], tj[order]
                nth = np.arange(len(ti)) - np.searchsorted(ti, ti)
                i, j = np.concatenate((i, ti[nth < k])), np.concatenate((j, tj[nth < k]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(scores[i, j])], ["query_id", "vec_id", "score"])

    return take


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Components are quantised to floor(256 * x). Candidates are all rows with
    another identifier; equal scores go to the smaller one. Rows whose
    identifier or vector is null, or whose vector is empty or holds a null or
    non-finite component, take no part; vectors of different lengths are not
    compared. Of several rows with one query identifier all are candidates and
    the smallest vector is the query, and each scores against rows of other
    identifiers only. Scores are exact whatever the size of a component; one that a
    long cannot hold is told, and ranked, as the nearest long. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    queries = good.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-good.where("q").count() // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed = materialise(queries.repartition(blocks, "vec_id").mapInArrow(_pack(QUERY_BLOCK), _BLOCK), "queries")
    queries = materialise(packed.withColumn("b", F.monotonically_increasing_id()).select("b", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "query-blocks")
    candidates = materialise(good.select("vec_id", "v").mapInArrow(_pack(CANDIDATE_BLOCK), _BLOCK).withColumn("c", F.monotonically_increasing_id()), "candidates")
    # candidates are shuffled once a pass; it is the fifty times fewer queries that are sent to each slice of them
    number = candidates.count()
    spread = max(1, min(number, 4 * spark.sparkContext.defaultParallelism), -(-number // SLICE_BLOCKS))
    left = candidates.withColumn("s", F.pmod(F.xxhash64("c"), F.lit(spread))).drop("c")
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))

    def pairs(state: DataFrame | None) -> DataFrame:
        bins = queries.withColumn("bins", F.lit(None).cast("array<struct<query_id:long,bin:long>>")) if state is None else queries.join(state, "b")
        met = left.join(bins.withColumn("s", slices), ["dim", "s"])
        return met.select("dim", "ids", "vectors", "q_ids", "q_vectors", "bins")

    members = queries.select("b", F.col("q_ids")).mapInArrow(_unpack, "b long, query_id long")
    state, stale = None, None
    for n, shift in enumerate(SHIFTS):
        counts = pairs(state).mapInArrow(_count(k, shift, SHIFTS[n - 1] if n else 63), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down)).join(need, "query_id") if n else counts.withColumn("upto", F.sum("n").over(down)).withColumn("need", F.lit(k).cast("long"))
        # the bin of the k-th value: the first whose running count reaches what is needed; the lowest if none does
        found = counts.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("need"), F.col("bin"))), F.min("bin")).alias("bin"), F.first("need").alias("was"), F.collect_list(F.struct("bin", "n")).alias("all"))
        found = found.select("query_id", "bin", (F.col("was") - F.aggregate(F.filter("all", lambda x: x["bin"] > F.col("bin")), F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("need"))
        fresh = materialise(found.join(members, "query_id").repartition(max(1, min(spread, blocks)), "b"), "kth-bins")
        need = fresh.select("query_id", "need")
        state = fresh.groupBy("b").agg(F.collect_list(F.struct("query_id", "bin")).alias("bins"))
        if stale is not None:
            discard(stale)
        stale = fresh
    best = pairs(state).mapInArrow(_take(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = materialise(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(packed, queries, candidates, stale)
    return found


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["b"])), pa.array(ids)], ["b", "query_id"])

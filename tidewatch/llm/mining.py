"""Hard negatives by norm-bucketed inner-product search.

Candidates are sorted by norm and cut into buckets, which know their largest
norm. An anchor's inner product with any row of a bucket is at most the product
of its norm and the bucket's (Cauchy-Schwarz), so a bucket is passed over for
every window whose lower limit, or whose running k-th score, lies above that.
Buckets are dealt to slices; a task holds one slice and one group of anchors,
takes the slice's buckets by falling norm, and returns the k best of its slice
for each window. What slices return is ranked once more.

The search runs twice: an anchor's positives have the window (-inf, inf) and
rows of its own label; each positive then opens a window of scores for rows of
other labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import Scratch
from .topk import products

#: Rows of a norm bucket, of a slice of candidates, of a group of anchors, and anchors scored at once.
BUCKET, SLICE, GROUP, AT_ONCE = 1000, 1 << 16, 1 << 15, 250
LOW, HIGH = -(2**63), 2**63 - 1
_BUCKETS = "dim int, n int, norm double, ids binary, labels binary, vectors binary, limits binary"
_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("limits", pa.binary())])
#: Component size from which a vector is kept as floats, in a bucket of its own kind.
_SMALL = 2**20


@dataclass
class Bucket:
    """Rows of one length: ``norm`` is the largest of their norms, ``norms`` the norm of each."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norm: float
    norms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = np.sqrt(np.square(self.vectors.astype(np.float64)).sum(axis=1))


@dataclass
class Windows:
    """One search each: of the anchor at row ``of``, for scores in [lo, hi]; ``key`` names it in the result."""

    of: np.ndarray
    key: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def best_of(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each window by falling score and rising identifier."""
    order = np.lexsort((ids, ~score, window))
    window, score, ids = window[order], score[order], ids[order]
    keep = np.arange(len(window)) - np.searchsorted(window, window) < k
    return window[keep], score[keep], ids[keep]


def search(anchors: Bucket, windows: Windows, buckets: Sequence[Bucket], k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of each window as (window, score, id), and the number of window and bucket pairs that were scored.

    ``buckets`` come by falling norm. Rows are those of the anchor's label, or of
    the other labels; the anchor's own row is none of them. A bucket whose bound
    equals the k-th score is scored, as ties go to the smaller identifier.
    """
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    floor = windows.lo.copy()
    scored = 0
    for b in buckets:
        if b.vectors.shape[1] != anchors.vectors.shape[1]:
            continue
        # rounding of the norms stays below one part in 2**40
        bound = anchors.norms * b.norm * (1 + 2**-40) + 1
        live = np.flatnonzero(bound[windows.of] >= floor)
        scored += len(live)
        if not len(live):
            continue
        rows, at = np.unique(windows.of[live], return_inverse=True)
        scores = products(anchors.vectors[rows], b.vectors)
        fits = (anchors.labels[rows][:, None] == b.labels[None, :]) == same_label
        fits &= anchors.ids[rows][:, None] != b.ids[None, :]
        scores = scores[at]
        fits = fits[at] & (scores >= floor[live][:, None]) & (scores <= windows.hi[live][:, None])
        if b.vectors.shape[0] > k:
            # a row below the bucket's own k-th fitting score is none of the k best
            kth = np.partition(np.where(fits, scores, LOW), len(b.ids) - k, axis=1)[:, len(b.ids) - k]
            fits &= scores >= kth[:, None]
        i, j = np.nonzero(fits)
        best = best_of(np.concatenate((best[0], live[i])), np.concatenate((best[1], scores[i, j])), np.concatenate((best[2], b.ids[j])), k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) == k)
        if len(full):
            floor[full] = np.maximum(floor[full], best[1][np.searchsorted(best[0], full, side="right") - 1])
    return *best, scored


def packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of ``size`` rows (vec_id, label, v, limits) as one row each, by length of the vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, limits = (batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "limits"))
            ids, labels, limits = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), limits.to_pylist()
            lists = batch.column(batch.schema.get_field_index("v"))
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
                    v = flat[starts[part][:, None] + np.arange(dim)].reshape(len(part), dim)
                    norm = float(np.sqrt(np.square(v).sum(axis=1)).max())
                    told = np.array([(p, x["key"], x["lo"], x["hi"]) for p, i in enumerate(part) for x in limits[i] or ()], np.int64).reshape(-1, 4)
                    rows.append((dim, len(part), norm, ids[part].astype(np.int64).tobytes(), labels[part].astype(np.int64).tobytes(), v.astype(np.float64 if wide else np.int32).tobytes(), told.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], _ARROW)

    return pack


def _bucket(row: dict) -> Bucket:
    n, dim, raw = row["n"], row["dim"], row["vectors"]
    vectors = np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim)
    return Bucket(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors, row["norm"])


def _of_slice(k: int, same_label: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        buckets = [_bucket(r) for r in sorted(candidates.to_pylist(), key=lambda r: (-r["norm"], r["ids"]))]
        out = []
        for row in anchors.to_pylist():
            a = _bucket(row)
            limits = np.frombuffer(row["limits"], np.int64).reshape(-1, 4)
            w, score, ids, _ = search(a, Windows(*limits.T), buckets, k, same_label)
            out.append(pa.table([a.ids[limits[w, 0]], limits[w, 1], score, ids], ["anchor_id", "key", "score", "vec_id"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4, ["anchor_id", "key", "score", "vec_id"])

    return found


def _searched(scratch: Scratch, buckets: DataFrame, n_slices: int, anchors: DataFrame, n_anchors: int, k: int, same_label: bool) -> DataFrame:
    """anchor_id, key, rank, vec_id, score of each window's k best; ``anchors`` has vec_id, label, v and limits (key, lo, hi)."""
    groups = -(-n_anchors // GROUP)
    blocks = anchors.repartition(max(1, -(-n_anchors // AT_ONCE)), "vec_id").mapInArrow(packed(AT_ONCE), _BUCKETS)
    blocks = scratch.keep(blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")), "anchor-blocks")
    # a bucket is read by each group of 2**15 anchors, an anchor by each slice of 2**16 candidates: in blocks, not in rows
    left = buckets.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    part = left.groupBy("s", "g").cogroup(right.groupBy("s", "g")).applyInArrow(_of_slice(k, same_label), "anchor_id long, key long, score long, vec_id long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: F.Column, *, label: F.Column | None = None, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, most_percent: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are quantised to floor(256 * x); a score is the inner product of
    two rows, exact whatever the size of a component (one that a long cannot hold
    is the nearest long). An anchor's positives are the ``n_positives`` best other
    rows of its label. Each positive of score p, from which follow the limits
    least_percent * p <= 100 * n <= most_percent * p, is given the
    ``n_negatives`` best rows of other labels with a score n within them. Equal
    scores go to the smaller identifier. All are returned where there are fewer;
    an anchor without positives, and a positive without negatives, has no row.

    ``label`` (an expression over ``vectors``) replaces the label column. Rows
    whose identifier, label or vector is null, or whose vector holds a null or
    non-finite component, take no part. Of rows with one identifier the smallest
    by label and vector stands for all, so repeated rows count once. Vectors of
    different lengths are not compared; empty ones score 0 among themselves.
    Other columns are not read, whatever their names. An empty table, or one
    without anchors, gives an empty result. Any number of rows may share a norm,
    a vector or a label: buckets are cut by number of rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    given = (F.col(label_col) if label is None else label).cast("long")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), given.alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), is_anchor.alias("anchor"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    good = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("anchor").alias("anchor")).select("vec_id", "r.label", "r.v", "anchor")
    # the order of the buckets only: a bucket's own norm is that of its quantised rows
    good = scratch.keep(good.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    n, n_anchors = good.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    if not n_anchors:
        scratch.clear()
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none = F.lit(None).cast("array<struct<key:long,lo:long,hi:long>>")
    # sorted by norm; rows of one norm are told apart by their identifier, so that they spread as well
    by_norm = good.repartitionByRange(max(1, -(-n // SLICE)), F.desc("square"), "vec_id").sortWithinPartitions(F.desc("square"), "vec_id")
    buckets = by_norm.select("vec_id", "label", "v", none.alias("limits")).mapInArrow(packed(BUCKET), _BUCKETS)
    n_slices = max(-(-n // SLICE), min(2 * spark.sparkContext.defaultParallelism, -(-n // BUCKET)))
    buckets = scratch.keep(buckets.withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(n_slices)).cast("int")), "norm-buckets")
    anchors = good.where("anchor").select("vec_id", "label", "v")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(LOW).cast("long").alias("lo"), F.lit(HIGH).alias("hi")))
    positives = scratch.keep(_searched(scratch, buckets, n_slices, anchors.withColumn("limits", whole), n_anchors, n_positives, True), "positives")
    p = F.col("score")
    limits = F.struct(F.col("vec_id").alias("key"), _part(p, least_percent, up=True).alias("lo"), _part(p, most_percent, up=False).alias("hi"))
    opened = positives.where(_part(p, least_percent, up=True) <= _part(p, most_percent, up=False)).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(limits).alias("limits"))
    found = _searched(scratch, buckets, n_slices, anchors.join(opened, "vec_id"), n_anchors, n_negatives, False)
    named = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = found.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor_id", "positive_id"])
    result = result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return scratch.result(result, "hard-negatives")


def _part(score: F.Column, percent: int, up: bool) -> F.Column:
    """``percent`` hundredths of a whole number, rounded up or down, in whole numbers."""
    rest = F.pmod(score, F.lit(100))
    hundreds = F.call_function("div", score, F.lit(100)) - F.when((score < 0) & (rest != 0), 1).otherwise(0)
    part = rest * percent
    return hundreds * percent + F.call_function("div", part + 99 if up else part, F.lit(100))


#: The rows of the query, in DuckDB.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) <= 5
"""

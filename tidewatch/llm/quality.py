"""Importance resampling with hashed n-gram generative models.

Two bag-of-n-grams models are fitted on labelled documents: of target text
(quality 1, not toxic), and of raw text, for which the labelled documents of
every kind stand. A text's importance weight is target(x) / raw(x). As in the
published method texts are weighed in pieces of one length: the log ratios of the n-grams in a
window of WINDOW tokens are added up, and a document has the weight of its
window of least weight, so length counts neither for nor against it. Documents
are drawn without replacement in proportion to their weights by Gumbel top-k:
the k largest sums of a log weight and a standard Gumbel variable.

A window is the set of its n-grams: single tokens and pairs of neighbours,
hashed, and how often a token repeats the one before it, in powers of two. The
ratio of a feature is estimated from how many windows of target text have it,
and how many the raw model leads to expect. It is smoothed by a mixture prior: most features are as
frequent in target as in raw text, up to the mix of languages and topics (a
negative binomial of shape SAME), and the others have any ratio (of shape
OTHER). A feature that no labelled text has says nothing.

Poor and toxic text is kept out by a cut, apart from the sampling: documents
below it have weight 0. It is the one that tells target documents from others
with fewest errors among labelled documents that the models were not fitted on,
and never above weight 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import select, text
from .store import Scratch, free_name, frugal, materialise

#: Buckets of single tokens, and of pairs.
BUCKETS, PAIRS = 1 << 18, 1 << 15
#: So many labelled documents are used at most: those whose id hashes lowest.
MAX_LABELLED = 40_000
#: Of these every HELD_OUT-th is left for the cut.
HELD_OUT = 5
#: Tokens of a window.
WINDOW = 256
#: All features: tokens, pairs, and powers of two of the number of repeats in a window.
SIZE = BUCKETS + PAIRS + 16
#: Shapes of the two parts of the prior, and the share of features of the second part.
SAME, OTHER, OTHER_SHARE = 8.0, 0.5, 0.3

_KIND = np.full(256, 2, np.uint8)
for _a, _b in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_a : _b + 1] = 1
_KIND[[*range(33)]] = 0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature numbers of every window, the window each is of, and the text of each window.

    Tokens are runs of letters and digits, or of other signs. Texts without tokens have no window.
    """
    buf, at = text.joined(texts)
    kind = _KIND[buf]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    ends = np.append(change[1:], len(buf))
    token = kind[change] > 0
    starts, ends = change[token], ends[token]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    h = text.runs(buf, starts, ends)
    of = np.searchsorted(at, starts, side="right") - 1
    first = np.flatnonzero(np.diff(of, prepend=-1))
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    begins = nth % WINDOW == 0
    window = np.cumsum(begins) - 1
    single = (h % np.uint64(BUCKETS)).astype(np.int64)
    near = window[1:] == window[:-1]
    same = near & (h[1:] == h[:-1])
    pair = (text.mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(PAIRS)).astype(np.int64) + BUCKETS
    # the first, second, fourth, eighth... token of a window that repeats the one before
    repeats = window[1:][same]
    count = np.arange(1, len(repeats) + 1) - np.searchsorted(repeats, repeats)
    power = np.log2(count)
    whole = power == np.floor(power)
    number = np.concatenate((single, pair[near & ~same], BUCKETS + PAIRS + power[whole].astype(np.int64)))
    where = np.concatenate((window, window[1:][near & ~same], repeats[whole]))
    key = np.unique(where * SIZE + number)
    return key % SIZE, key // SIZE, of[begins]




def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, target: 1 or 0) to the windows of target text, and of all, that have a feature; feature SIZE counts windows."""
    counts = np.zeros((2, SIZE + 1), np.int64)
    for batch in batches:
        texts, target = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for a, b in text.chunks(texts):
            number, window, of = features(texts[a:b])
            good = target[a:b][of] == 1
            counts[0, :SIZE] += np.bincount(number[good[window]], minlength=SIZE)
            counts[1, :SIZE] += np.bincount(number, minlength=SIZE)
            counts[:, SIZE] += (int(good.sum()), len(of))
    some = np.flatnonzero(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["feature", "target", "raw"])


def log_ratios(target: np.ndarray, raw: np.ndarray, share: float) -> np.ndarray:
    """Log of a feature's frequency in target text over that in raw text, smoothed; both count windows, of which ``share`` are target text."""
    expected = raw * share

    def likelihood(shape: float) -> np.ndarray:  # of a negative binomial, without what both parts share
        kinds, of = np.unique(target, return_inverse=True)
        rising = np.array([lgamma(shape + c) - lgamma(shape) for c in kinds])[of]
        return rising + shape * np.log(shape / (shape + expected)) - target * np.log(shape + expected)

    odds = np.log(OTHER_SHARE / (1 - OTHER_SHARE)) + likelihood(OTHER) - likelihood(SAME)
    other = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return np.where(raw > 0, np.log(1 - other + other * (target + OTHER) / (expected + OTHER)), 0.0)


def _labelled(documents: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, target (1 or 0) and whether it is held out, of labelled documents. Labels with a null are left out."""
    target = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long").alias("target")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", target)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    held_out = (F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "target", held_out)


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Log ratios by feature, and the cut. A document labelled twice counts twice.

    Without labelled documents of both kinds all ratios are 1 and the cut is below all weights.
    """
    spark = documents.sparkSession
    with Scratch() as scratch:
        rows = scratch.keep(_labelled(documents, labels, max_labelled), "labelled")
        if len({r["target"] for r in rows.select("target").distinct().collect()}) < 2:
            return np.zeros(SIZE, np.float32), -np.inf
        tallied = rows.where("not held_out").select("text", "target").mapInArrow(frugal(_tally), "feature long, target long, raw long")
        got = tallied.groupBy("feature").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
        counts = np.zeros((2, SIZE + 1), np.int64)
        counts[:, got.column("feature").to_numpy()] = [got.column(c).to_numpy() for c in ("target", "raw")]
        ratios = log_ratios(*counts[:, :SIZE], counts[0, SIZE] / max(1, counts[1, SIZE])).astype(np.float32)
        told = rows.where("held_out").select("text", "target").mapInArrow(_weigh(spark.sparkContext.broadcast(ratios)), "target long, log_weight double").toArrow()  # a fifth of max_labelled rows
    return ratios, min(0.0, best_cut(told.column("log_weight").to_numpy(), told.column("target").to_numpy()))


def best_cut(weights: np.ndarray, target: np.ndarray) -> float:
    """The cut between two weights with fewest targets below and others above; of equally good ones the widest."""
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], target[order]
    if not len(w):
        return -np.inf
    bounds = np.concatenate(([w[0] - 2], w, [w[-1] + 2]))
    wrong = np.concatenate(([0], np.cumsum(y))) + (1 - y).sum() - np.concatenate(([0], np.cumsum(1 - y)))
    gaps = np.diff(bounds)
    wrong = np.where(gaps > 0, wrong, len(y) + 1)
    i = int(np.lexsort((-gaps, wrong))[0])
    return float((bounds[i] + bounds[i + 1]) / 2)


def _weigh(ratios) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), np.zeros(batch.num_rows)
            for a, b in text.chunks(texts):
                number, window, of = features(texts[a:b])
                if len(of):
                    sums = np.bincount(window, table[number], len(of))
                    first = np.flatnonzero(np.diff(of, prepend=-1))
                    out[a + of[first]] = np.minimum.reduceat(sums, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*batch.schema.names[1:], "log_weight"])

    return frugal(weigh)


def weights(documents: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, float]:
    """The columns ``keep`` with ``log_weight``, and the cut."""
    ratios, cut = fit(documents, labels, max_labelled)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return documents.select("text", *keep).mapInArrow(_weigh(documents.sparkSession.sparkContext.broadcast(ratios)), f"{schema}, log_weight double"), cut


def gumbel(seed: int | Column, *cols: str) -> Column:
    """Standard Gumbel noise that a row's own values decide."""
    u = (F.shiftrightunsigned(F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.log(-F.log(u))


def resample(documents: DataFrame, labels: DataFrame, *, seed: int = 29, k: int | None = None, max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The sampled documents: the columns ``keep``, log_weight, key.

    Documents below the cut have weight 0 and are never drawn: noise must not
    let poor or toxic text in. k defaults to the number of all others, so that
    no clean document is lost; a smaller k draws among them in proportion to
    their weights. Null and empty texts give no evidence (log weight 0). Noise is drawn by
    ``keep``, so rows with one id share it, and equal rows are drawn together:
    rows that tie at the k-th key all stay. A long text is weighed whole,
    window by window. Columns other than ``keep`` and text are not read. Without
    labels of both kinds every weight is 1; an empty table gives an empty sample.
    """
    scored, cut = weights(documents, labels, max_labelled=max_labelled, keep=keep)
    scored = materialise(scored.where(F.col("log_weight") >= cut).withColumn("key", F.col("log_weight") + gumbel(seed, *keep)), "weights")
    if k is None:
        return scored
    last = select.kth(scored, "key", k) if k > 0 else None
    if last is None:
        return scored if k > 0 else scored.limit(0)
    return scored.where(F.col("key") >= last)


def sampled(documents: DataFrame, labels: DataFrame, share: float, *, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """All documents that may be drawn, as :func:`resample` returns them, with ``drawn``: whether Gumbel top-k takes
    them into a sample of ``share`` of their number (rounded down; rows that tie at the last key are all drawn).
    """
    scored = resample(documents, labels, keep=keep, **options)
    k = int(scored.count() * share)
    last = select.kth(scored, "key", k) if k else None
    return scored.withColumn("drawn", F.col("key") >= F.lit(last) if last is not None else F.lit(False))


def accepted(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose id and text are in the sample."""
    xx, did = (free_name(documents, c) for c in ("_xx", "_did"))
    d = documents.withColumns({xx: F.xxhash64("text"), did: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    sample = resample(d, labels, keep=(did, xx), **options).select(did, xx).distinct()
    return d.join(sample, [did, xx], "left_semi").select(*(F.col(f"`{c}`") for c in documents.columns))

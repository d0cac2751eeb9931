"""Half-space trees: an anomaly score that learns from trusted events as they come.

Each of a few random trees halves a random axis of its box at every node. Trees
count the trusted events that pass through their nodes, in windows of a fixed
number of events: the counts of the last full window (the mass) score, those of
the running one are gathered and take over when it is full. An event in a thin
part of the space meets little mass.

What an event is scored by is therefore decided by one number, how many trusted
events came before it. The batch form numbers events by running sums, gives
every window the mass of the one before, and scores windows side by side; so it
equals the event-by-event form (:class:`HalfSpaceModel`), which the stream keeps
as keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..storage import discard, materialise, running_sums

# Size of the forest, events of a window, bins of the score histogram, percentile from which an event is unusual, weight of its reason.
TREES, HEIGHT, WINDOW, BINS, USUAL, REASON_WEIGHT = 15, 8, 250, 200, 0.9, 0.5
#: A node with less than this share of a window's events ends a walk.
THIN = 0.1
#: Events of a window scored by one task call, and of a block of the running histogram.
CHUNK, BLOCK = 20_000, 4096


@dataclass(frozen=True)
class Forest:
    """``axis`` and ``cut`` of the inner nodes of each tree, children of node i being 2i + 1 and 2i + 2."""

    axis: np.ndarray
    cut: np.ndarray
    height: int
    window: int

    def walks(self, x: np.ndarray) -> np.ndarray:
        """The nodes (rows, trees, height + 1) that rows pass through."""
        out = np.zeros((len(x), len(self.axis), self.height + 1), np.int64)
        tree = np.arange(len(self.axis))[None, :]
        row = np.arange(len(x))[:, None]
        for d in range(self.height):
            at = out[:, :, d]
            right = x[row, self.axis[tree, at]] >= self.cut[tree, at]
            out[:, :, d + 1] = 2 * at + 1 + right
        return out

    def mass(self, x: np.ndarray) -> np.ndarray:
        """How many rows pass through each node (trees, nodes)."""
        size = 2 ** (self.height + 1) - 1
        at = self.walks(x) + size * np.arange(len(self.axis))[None, :, None]
        return np.bincount(at.ravel(), minlength=size * len(self.axis)).reshape(len(self.axis), size)

    def score(self, x: np.ndarray, mass: np.ndarray | None) -> np.ndarray:
        """Scores in [0, 1], high where there is little mass; 0 before the first full window."""
        if mass is None:
            return np.zeros(len(x))
        m = mass[np.arange(len(self.axis))[None, :, None], self.walks(x)].astype(np.float64)
        thick = np.cumprod(m >= THIN * self.window, axis=2)
        reached = np.concatenate((np.ones_like(thick[:, :, :1]), thick[:, :, :-1]), axis=2)
        total = (m * reached * 2.0 ** np.arange(self.height + 1)).sum(axis=(1, 2))
        return 1.0 - total / (len(self.axis) * self.window * (2 ** (self.height + 1) - 1))


@cache
def forest(n_axes: int, trees: int = TREES, height: int = HEIGHT, window: int = WINDOW, seed: int = 42) -> Forest:
    """Random trees over features in [0, 1]: each tree's box reaches beyond that around a random centre, and is halved at every node."""
    rng = np.random.default_rng(seed)
    n = 2**height - 1
    axis, cut = np.zeros((trees, n), np.int64), np.zeros((trees, n))
    for t in range(trees):
        centre = rng.uniform(size=n_axes)
        reach = 2 * np.maximum(centre, 1 - centre)
        box = {0: (centre - reach, centre + reach)}
        for i in range(n):
            lo, hi = box.pop(i)
            a = int(rng.integers(n_axes))
            mid = (lo[a] + hi[a]) / 2
            axis[t, i], cut[t, i] = a, mid
            left, right = hi.copy(), lo.copy()
            left[a] = right[a] = mid
            box[2 * i + 1], box[2 * i + 2] = (lo, left), (right, hi)
    return Forest(axis, cut, height, window)


def bins(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw * BINS).astype(np.int64), 0, BINS - 1)


def unusual(percentile: np.ndarray) -> np.ndarray:
    """The part of a percentile above the usual ones, from 0 to 1."""
    return np.clip((percentile - USUAL) / (1 - USUAL), 0.0, 1.0)


class HalfSpaceModel:
    """The event-by-event form: score an event, then learn it if it is trusted."""

    def __init__(self, of: Forest, state: tuple | None = None):
        self.forest = of
        shape = (len(of.axis), 2 ** (of.height + 1) - 1)
        if state is None:
            self.learned, self.ready = 0, False
            self.mass, self.next, self.histogram = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(BINS, np.int64)
        else:
            self.learned, self.ready = state[0], state[0] >= of.window
            self.mass, self.next = (np.frombuffer(b, np.int64).reshape(shape).copy() for b in state[1:3])
            self.histogram = np.frombuffer(state[3], np.int64).copy()

    def state(self) -> tuple[int, bytes, bytes, bytes]:
        return self.learned, self.mass.tobytes(), self.next.tobytes(), self.histogram.tobytes()

    def score(self, x: np.ndarray) -> tuple[float, float]:
        """(raw score, calibrated score) of one event."""
        raw = float(self.forest.score(x[None, :], self.mass if self.ready else None)[0])
        if not self.ready:
            return raw, 0.0
        b = int(bins(np.array([raw]))[0])
        percentile = (self.histogram[:b].sum() + 0.5 * self.histogram[b]) / self.histogram.sum()
        return raw, float(unusual(percentile))

    def learn(self, x: np.ndarray, raw: float) -> None:
        walk = self.forest.walks(x[None, :])[0]
        self.next[np.arange(len(walk))[:, None], walk] += 1
        self.histogram[bins(np.array([raw]))[0]] += 1
        self.learned += 1
        if self.learned % self.forest.window == 0:
            self.mass, self.next, self.ready = self.next, np.zeros_like(self.next), True


def _matrix(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(np.float64) for c in columns], axis=1) if t.num_rows else np.zeros((0, len(columns)))


def _scored(of: Forest, columns: list[str], told: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(events: pa.Table, reference: pa.Table) -> pa.Table:
        raw = of.score(_matrix(events, columns), of.mass(_matrix(reference, told)) if reference.num_rows else None)
        return pa.table([events.column("tx_id"), events.column("_n"), events.column("_trusted"), events.column("_t"), pa.array(raw)], ["tx_id", "_n", "_trusted", "_t", "raw"])

    return run


def _ranked(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Percentiles of a block's events among the trusted events before each."""

    def run(events: pa.Table, base: pa.Table) -> pa.Table:
        order = np.argsort(events.column("_n").to_numpy())
        raw, trusted, before = (events.column(c).to_numpy(zero_copy_only=False)[order] for c in ("raw", "_trusted", "_t"))
        counts = np.zeros(BINS, np.int64)
        if base.num_rows:
            counts[base.column("bin").to_numpy()] = base.column("upto").to_numpy()
        b = bins(raw)
        score = np.zeros(len(raw))
        for i in range(len(raw)):
            if before[i] >= window:
                score[i] = (counts[: b[i]].sum() + 0.5 * counts[b[i]]) / before[i]
            counts[b[i]] += int(trusted[i])
        ready = before >= window
        return pa.table([events.column("tx_id").take(pa.array(order)), pa.array(raw), pa.array(np.where(ready, unusual(score), 0.0)), pa.array(ready)], ["tx_id", "raw", "online_score", "ready"])

    return run


def half_space_scores(events: DataFrame, columns: Sequence[str], *, trusted: Column | None = None, trees: int = TREES, height: int = HEIGHT, window: int = WINDOW, seed: int = 42) -> DataFrame:
    """tx_id, raw, online_score, ready of every event, each scored by what came before it (order: us, tx_id).

    ``columns`` hold features in [0, 1]; a null counts as 0. ``trusted`` says which
    events are learned (a null is no; all by default). online_score is how far
    above the 90th percentile of earlier trusted scores an event lies, 0 until a
    first window is full (``ready``). tx_id is unique; other columns are not read.
    However many events that are not trusted stand between two trusted ones,
    a task holds a bounded number of events.
    """
    columns = list(columns)
    of = forest(len(columns), trees, height, window, seed)
    yes = F.coalesce(F.lit(True) if trusted is None else trusted, F.lit(False))
    x = events.select("tx_id", "us", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), yes.alias("_trusted"))
    x = running_sums(x, [F.col("us"), F.col("tx_id")], {"_n": F.lit(1), "_t": F.col("_trusted").cast("int")})
    # how many events, and trusted ones, came before
    x = x.withColumns({"_n": F.col("_n") - 1, "_t": F.col("_t") - F.col("_trusted").cast("int")})
    x = materialise(x.withColumns({"_w": F.expr(f"_t div {window}"), "_c": F.expr(f"_n div {CHUNK}")}), "online-events")
    chunks = x.groupBy("_w").agg(F.min("_c").alias("a"), F.max("_c").alias("b"))
    # names of their own: both sides come from one table
    told = [f"_r{i}" for i in range(len(columns))]
    reference = x.where("_trusted").select((F.col("_w") + 1).alias("_w"), *(F.col(c).alias(n) for c, n in zip(columns, told, strict=True))).join(chunks, "_w").select(F.col("_w").alias("_rw"), F.explode(F.sequence("a", "b")).alias("_rc"), *told)
    kind = x.schema["tx_id"].dataType.simpleString()
    scored = x.groupBy("_w", "_c").cogroup(reference.groupBy("_rw", "_rc")).applyInArrow(_scored(of, columns, told), f"tx_id {kind}, _n long, _trusted boolean, _t long, raw double")
    scored = materialise(scored.withColumn("_b", F.expr(f"_n div {BLOCK}")), "online-raw")
    bin_ = F.least(F.greatest((F.col("raw") * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    counted = scored.where("_trusted").groupBy("_b", bin_.alias("bin")).agg(F.count("*").alias("n"))
    # running counts of a bin over the blocks: a row for each block and bin
    grid = scored.select("_b").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    upto = F.coalesce(F.sum("n").over(W.partitionBy("bin").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = grid.join(counted, ["_b", "bin"], "left").withColumn("upto", upto).where("upto > 0").select(F.col("_b").alias("_rb"), "bin", "upto")
    out = scored.groupBy("_b").cogroup(base.groupBy("_rb")).applyInArrow(_ranked(window), f"tx_id {kind}, raw double, online_score double, ready boolean")
    out = materialise(out, "online-scores")
    discard(x, scored)
    return out


def online_reasons(scores: DataFrame, least: float) -> DataFrame:
    """tx_id, code, source, weight: one reason for each score of at least ``least``."""
    return scores.where(F.col("online_score") >= least).select("tx_id", F.lit("ONLINE_ANOMALY").alias("code"), F.lit("signal").alias("source"), (F.col("online_score") * REASON_WEIGHT).alias("weight"))


def half_space_stream(events: DataFrame, columns: Sequence[str], by: str, *, trees: int = TREES, height: int = HEIGHT, window: int = WINDOW, seed: int = 42) -> DataFrame:
    """The same over a stream, with a forest of its own for each value of ``by`` (append mode): by, tx_id, raw, online_score.

    Events have us, tx_id, ``columns`` and trusted. Of one batch they are learned
    in the order of us and tx_id; an event that comes in a later batch is learned
    when it comes. The state is the counts of two windows and one histogram.
    """
    columns = list(columns)
    of = forest(len(columns), trees, height, window, seed)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model = HalfSpaceModel(of, state.get if state.exists else None)
        for pdf in [pd.concat(list(batches)).sort_values(["us", "tx_id"])]:
            x = np.nan_to_num(pdf[columns].to_numpy(np.float64))
            out = []
            for i, trusted in enumerate(pdf["trusted"].fillna(False).tolist()):
                raw, score = model.score(x[i])
                if trusted:
                    model.learn(x[i], raw)
                out.append((raw, score))
            yield pd.DataFrame({by: pdf[by], "tx_id": pdf["tx_id"], "raw": [r for r, _ in out], "online_score": [s for _, s in out]})
        state.update(model.state())

    return events.groupBy(by).applyInPandasWithState(step, f"`{by}` {kinds[by]}, tx_id {kinds['tx_id']}, raw double, online_score double", "n long, mass binary, next binary, histogram binary", "append", GroupStateTimeout.NoTimeout)

"""Evaluation protocols: splits, layers, paired bootstrap, drift windows, sampling, selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scores import action_rank, logit, sigmoid
from ..storage import materialise, positions, running_sums
from . import metrics as mx

_P = 2**31 - 1


def row_split(rows: DataFrame, order: Sequence[str], train: float = 0.70, valid: float = 0.15, exclude: str | None = None) -> DataFrame:
    """Adds ``part``: by position in the order, which must be unique; rows marked ``exclude`` are dropped first."""
    if exclude:
        rows = rows.where(~F.coalesce(F.col(exclude), F.lit(False)))
    placed = positions(rows, [F.col(c) for c in order], "_nth")
    total = rows.agg(F.count("*").alias("_all"))
    nth = F.col("_nth") - 1
    part = F.when(nth < F.floor(F.col("_all") * train), "train").when(nth < F.floor(F.col("_all") * (train + valid)), "valid").otherwise("test")
    return placed.crossJoin(F.broadcast(total)).withColumn("part", part).drop("_nth", "_all")


# --- layers -----------------------------------------------------------------------------------
LAYERS = ("rules", "gbm", "rules_gbm", "anomaly", "graph", "full")


def ensemble(first: Column, second: Column) -> Column:
    """The anomaly score: the mean of two calibrated percentiles."""
    return (first + second) / 2


def layer_scores(df: DataFrame, two: tuple[float, float, float], three: tuple[float, float, float, float], combine) -> DataFrame:
    """Adds a score for each layer: rules, model, both stacked, with anomalies, with signals, and the full decision.

    ``two`` and ``three`` are the stackers' coefficients and intercept (last)
    over the logits of rule_score, ml_score and anomaly_score; ``combine`` maps
    a stacked Column to the combined risk. The full layer ranks by action, then risk.
    """
    r, m, a = (logit(F.col(c)) for c in ("rule_score", "ml_score", "anomaly_score"))
    stacked3 = sigmoid(r * three[0] + m * three[1] + a * three[2] + three[3])
    combined = combine(stacked3)
    return df.withColumns({"rules": F.col("rule_score"), "gbm": F.col("ml_score"), "rules_gbm": sigmoid(r * two[0] + m * two[1] + two[2]), "anomaly": stacked3, "graph": combined, "full": action_rank(F.col("decision")) + combined})


def layer_metrics(scored: DataFrame, layers: Sequence[str] = LAYERS, budget: float = 0.01) -> DataFrame:
    """One row a layer: the standard block over its score."""
    parts = [standard_block(scored.select("y", "amount", F.col(n).alias("s")), budget).withColumn("layer", F.lit(n)) for n in layers]
    return reduce(lambda a, b: a.unionByName(b), parts)


def standard_block(rows: DataFrame, budget: float = 0.01) -> DataFrame:
    """n, positives, PR and ROC area, recall at 1 % false positives, precision and recall at the alert budget; rows are (y, s, amount)."""
    one = mx.rank_metrics(rows).select("n", "positives", F.round("average_precision", 4).alias("pr_auc"), F.round("roc_auc", 4).alias("roc_auc"))
    two = mx.recall_at_fpr(rows).select(F.round("recall", 4).alias("recall_at_1pct_fpr"))
    three = mx.budget_metrics(rows, budget).select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round("amount_recall", 4).alias("amount_recall"))
    return one.crossJoin(two).crossJoin(three)


# --- bootstrap --------------------------------------------------------------------------------
def draw(nth: Column, round_: Column, n: Column) -> Column:
    """Row number from 0 to n - 1 that the nth draw of a round takes: squares modulo a prime, the same in any engine."""
    x = F.pmod(nth * 48271 + round_ * 69621 + 12345, F.lit(_P))
    x = F.pmod(x * x, F.lit(_P))
    return F.pmod(F.pmod(x * 16807 + round_, F.lit(_P)), n)


#: Rows of a block, whose draws a task counts at once, and draws that a task makes at once.
BLOCK, CHUNK = 2**16, 2**20


def _draws(spark: SparkSession, n: int, rounds: int, block: int, chunk: int) -> DataFrame:
    """_b, round, places: the draws of n rows, as places (16 bits each) in blocks of rows; see :func:`draw`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in (i for b in batches for i in b.column(0).to_pylist()):
            nth, r = np.arange(at // rounds * chunk, min(n, (at // rounds + 1) * chunk)), at % rounds + 1
            x = (nth * 48271 + r * 69621 + 12345) % _P
            x = x * x % _P
            drawn = np.sort((x * 16807 + r) % _P % n)
            hit = np.unique(drawn // block)
            ends = np.searchsorted(drawn, np.append(hit, hit[-1] + 1) * block)
            places = (drawn % block).astype("<u2")
            yield pa.RecordBatch.from_pydict({"_b": hit, "round": np.full(len(hit), r), "places": pa.array([places[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())})

    jobs = -(-n // chunk) * rounds
    parts = min(jobs, max(spark.sparkContext.defaultParallelism, jobs // 16))
    return spark.range(0, jobs, 1, parts).mapInArrow(run, "_b long, round long, places binary")


def drawn(rows: DataFrame, order: Sequence[str], rounds: int, *, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Stratified resamples, a row for each row: adds ``times``, how often each round draws it.

    For each round, positives and negatives are drawn apart with replacement, as many as there are.
    ``times`` holds a 32-bit number a round. The order must be unique. Draws are made in chunks and
    go to the block of the row that they take, so rows x rounds are bytes and never rows.
    """
    spark = rows.sparkSession
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block has 1 to {BLOCK} rows")
    rows = rows.where(F.col("y").isin(0, 1))
    y = F.col("y")
    placed = running_sums(rows, [F.col(c) for c in order], {f"_i{k}": F.when(y == k, 1).otherwise(0) for k in (0, 1)})
    i = F.when(y == 1, F.col("_i1")).otherwise(F.col("_i0")) - 1
    placed = placed.withColumns({"_y": y.cast("int"), "_b": F.floor(i / block).cast("long"), "_o": F.pmod(i, F.lit(block)).cast("int")}).drop("_i0", "_i1")
    count = {r["y"]: r["n"] for r in rows.groupBy(y.cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    parts = [_draws(spark, n, rounds, block, chunk).withColumn("_y", F.lit(k)) for k, n in sorted(count.items())]
    if not parts:
        return rows.withColumn("times", F.lit(None).cast("binary"))

    def run(own: pa.Table, draws: pa.Table) -> pa.Table:
        counts = np.zeros((own.num_rows, rounds), "<u4")
        taken: dict[int, list[bytes]] = {}
        for r, p in zip(draws.column("round").to_pylist(), draws.column("places").to_pylist(), strict=True):
            taken.setdefault(r, []).append(p)
        for r, p in taken.items():
            counts[:, r - 1] = np.bincount(np.frombuffer(b"".join(p), "<u2"), minlength=own.num_rows)
        mine = counts[own.column("_o").to_numpy()]
        return own.drop_columns(["_y", "_b", "_o"]).append_column("times", pa.array([t.tobytes() for t in mine], pa.binary()))

    schema = T.StructType([*rows.schema.fields, T.StructField("times", T.BinaryType())])
    return placed.groupBy("_y", "_b").cogroup(reduce(DataFrame.unionByName, parts).groupBy("_y", "_b")).applyInArrow(run, schema)


def _matrix(packed: pa.Array, rounds: int | None = None) -> np.ndarray:
    """Counts (rows, rounds) as they are packed; empty ones, which need ``rounds``, are zeros."""
    got = packed.to_pylist()
    rounds = rounds or len(got[0]) // 4
    return np.frombuffer(b"".join(p or bytes(4 * rounds) for p in got), "<u4").reshape(len(got), rounds).astype(np.int64)


def resampled(rows: DataFrame, order: Sequence[str], rounds: int) -> DataFrame:
    """The rows of :func:`drawn`, one for each round that draws it, with ``round`` and ``times``: rows x rounds, for small tables."""
    fields = [*rows.schema.fields, T.StructField("round", T.LongType()), T.StructField("times", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts = _matrix(b.column(b.num_columns - 1))
                at, r = np.nonzero(counts)
                kept = pa.Table.from_batches([b]).drop_columns(["times"]).take(pa.array(at))
                yield from kept.append_column("round", pa.array(r + 1)).append_column("times", pa.array(counts[at, r])).to_batches()

    return drawn(rows, order, rounds).mapInArrow(run, T.StructType(fields))


def _steps(sample: DataFrame, score: str) -> DataFrame:
    """s, n, pos: counts of each round by score, put together within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, at = np.unique(b.column(0).to_numpy(zero_copy_only=False) + 0.0, return_inverse=True)
            order = np.argsort(at, kind="stable")
            firsts = np.searchsorted(at[order], np.arange(len(s)))
            counts, y = _matrix(b.column(2))[order], b.column(1).to_numpy(zero_copy_only=False)[order]
            n, pos = np.add.reduceat(counts, firsts), np.add.reduceat(counts * y[:, None], firsts)
            some = pos.any(axis=1)
            yield pa.RecordBatch.from_pydict({"s": s, "n": pa.array([x.astype("<u4").tobytes() for x in n], pa.binary()), "pos": pa.array([x.astype("<u4").tobytes() if any_ else b"" for x, any_ in zip(pos, some, strict=True)], pa.binary())})

    s = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    return sample.select(s.alias("s"), F.col("y").cast("long").alias("y"), "times").mapInArrow(run, "s double, n binary, pos binary")


def average_precision_by_round(sample: DataFrame, score: str) -> DataFrame:
    """round, ap: average precision of each resample (:func:`drawn`), a step for each distinct score; null without positives.

    Counts are put in order by ranges of the score; a range is streamed with the counts of
    those above it. A missing score is the lowest.
    """
    rows = _steps(sample, score).repartitionByRange(F.desc("s")).sortWithinPartitions(F.desc("s")).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("_range", F.shiftright("_at", 33)), "score-steps")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy()
            n = _matrix(b.column(1))
            pos = _matrix(b.column(2), n.shape[1])
            for r in np.unique(of):
                here = of == r
                yield pa.RecordBatch.from_pydict({"_range": np.full(n.shape[1], r), "round": np.arange(1, n.shape[1] + 1), "n": n[here].sum(axis=0), "pos": pos[here].sum(axis=0)})

    schema = "_range long, round long, n long, pos long"
    totals = rows.select("_range", "n", "pos").mapInArrow(sums, schema).groupBy("_range", "round").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    got = totals.toPandas().sort_values(["_range", "round"])  # ranges x rounds
    n, pos = 0, 0
    for r, g in got.groupby("_range"):
        above[int(r)] = (n, pos)
        n, pos = n + g["n"].to_numpy(), pos + g["pos"].to_numpy()
    shared = sample.sparkSession.sparkContext.broadcast(above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s, n, pos, cum_n, cum_pos, ap = None, None, 0, 0, 0, 0, 0.0

        def taken(n: np.ndarray, pos: np.ndarray) -> None:
            """Steps that are whole."""
            nonlocal cum_n, cum_pos, ap
            up_n, up_pos = cum_n + np.cumsum(n, axis=0), cum_pos + np.cumsum(pos, axis=0)
            ap = ap + (pos * up_pos / np.maximum(up_n, 1)).sum(axis=0)
            cum_n, cum_pos = up_n[-1], up_pos[-1]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"round": np.arange(1, len(ap) + 1), "ap": ap, "pos": cum_pos - shared.value[at][1]})

        for b in batches:
            ranges, scores, ns = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            poss = _matrix(b.column(3), ns.shape[1])
            for r in np.unique(ranges):
                here = ranges == r
                v, hn, hp = scores[here], ns[here], poss[here]
                if at != r:
                    if at is not None:
                        taken(n[None], pos[None])
                        yield told()
                    at, s, ap = int(r), None, 0.0
                    cum_n, cum_pos = shared.value[at]
                same = np.equal(v[1:], v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
                firsts = np.append(0, np.flatnonzero(~same) + 1)
                hn, hp = np.add.reduceat(hn, firsts), np.add.reduceat(hp, firsts)
                if s is not None and (s == v[0] or (np.isnan(s) and np.isnan(v[0]))):
                    hn[0] += n
                    hp[0] += pos
                elif s is not None:
                    hn, hp = np.vstack([n[None], hn]), np.vstack([pos[None], hp])
                if len(hn) > 1:
                    taken(hn[:-1], hp[:-1])
                s, n, pos = v[-1], hn[-1], hp[-1]
        if at is not None:
            taken(n[None], pos[None])
            yield told()

    parts = rows.repartition("_range").sortWithinPartitions("_range", "_at").select("_range", "s", "n", "pos").mapInArrow(run, "round long, ap double, pos long")
    return parts.groupBy("round").agg(F.when(F.sum("pos") > 0, F.sum("ap") / F.sum("pos")).alias("ap"))


def interval(df: DataFrame, value: str) -> DataFrame:
    """low, high: the 2.5 and 97.5 percentiles, to 4 digits."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return df.agg(F.round(q[0], 4).alias("low"), F.round(q[1], 4).alias("high"))


def verdict(delta: Column, low: Column, high: Column) -> Column:
    """What a layer adds: nothing if the interval of the difference holds 0."""
    return F.when((low <= 0) & (high >= 0), "none").when(delta > 0, "gain").otherwise("harm")


def paired_difference(rows: DataFrame, order: Sequence[str], better: str, base: str, rounds: int = 200) -> DataFrame:
    """Interval of the difference of two scores' average precision on the same resamples, and the verdict."""
    sample = materialise(drawn(rows.select("y", *order, better, base), order, rounds), "resamples")
    return difference(rows, better, base, *(average_precision_by_round(sample, c) for c in (better, base)))


def difference(rows: DataFrame, better: str, base: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`paired_difference` of two scores whose average precision by round is known."""
    d = a.join(b.withColumnRenamed("ap", "base"), "round").withColumn("d", F.col("ap") - F.col("base"))
    whole = [mx.rank_metrics(rows.select("y", F.col(c).alias("s"))).select(F.col("average_precision").alias(f"_{i}")) for i, c in enumerate((better, base))]
    out = interval(d, "d").crossJoin(whole[0]).crossJoin(whole[1]).withColumn("delta", F.round(F.col("_0") - F.col("_1"), 4))
    return out.select("delta", "low", "high", verdict(F.col("delta"), F.col("low"), F.col("high")).alias("verdict"))


def f1_by_round(sample: DataFrame, score: str, threshold: float) -> DataFrame:
    """round, f1 of each resample (:func:`drawn`) at a fixed threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hit, y = (b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (0, 1))
                counts = _matrix(b.column(2))
                yield pa.RecordBatch.from_pydict({"round": np.arange(1, counts.shape[1] + 1), "tp": counts[hit & y].sum(axis=0), "p": counts[hit].sum(axis=0), "pos": counts[y].sum(axis=0)})

    hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
    parts = sample.select(hit.alias("hit"), (F.col("y") == 1).alias("y"), "times").mapInArrow(run, "round long, tp long, p long, pos long")
    g = parts.groupBy("round").agg(*(F.sum(c).alias(c) for c in ("tp", "p", "pos")))
    return g.select("round", (2 * F.col("tp") / F.greatest(F.lit(1), F.col("p") + F.col("pos"))).alias("f1"))


# --- held-out scores ------------------------------------------------------------------------------
def held_out(rows: DataFrame, coefficients: Sequence[float], intercept: float, inputs: Sequence[str]) -> DataFrame:
    """Log loss and Brier score of a stacker variant over the logits of its inputs."""
    z = reduce(lambda a, b: a + b, (logit(F.col(c)) * w for c, w in zip(inputs, coefficients, strict=True))) + intercept
    p = sigmoid(z)
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
    return rows.agg(F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg((p - F.col("y")) * (p - F.col("y"))), 6).alias("brier"))


def input_ablation(rows: DataFrame, variants: dict[str, tuple[Sequence[float], float]], inputs: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Held-out scores of stacker variants, and whether the anomaly input stays: it must lower the log loss of ``nonneg`` by more than the tolerance."""
    parts = [held_out(rows, c, b, inputs).withColumn("variant", F.lit(n)) for n, (c, b) in variants.items()]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    loss = lambda n: F.max(F.when(F.col("variant") == n, F.col("log_loss")))
    keep = out.agg((loss("nonneg") < loss("nonneg_no_anomaly") - tolerance).alias("anomaly_kept"))
    return out.crossJoin(F.broadcast(keep))


def without_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with the named features set to 0 for an ablation; all others as they are."""
    return rows.withColumns({n: F.lit(0.0) for n in names})


def champion(candidates: DataFrame) -> DataFrame:
    """The candidate with the least missed amount share on validation, then the largest PR area, then the smaller name."""
    return candidates.orderBy("missed_share", F.desc("pr_auc"), "version").limit(1)


# --- drift -----------------------------------------------------------------------------------------
def distribution(values: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bin, share: how the values lie between the edges; empty bins have share 0."""
    b = mx.bin_of(F.col(value), F.array(*map(F.lit, edges)))
    every = values.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    n = values.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    j = every.join(n, "bin", "left").fillna({"n": 0})
    return j.crossJoin(F.broadcast(values.agg(F.count("*").alias("_all")))).select("bin", F.when(F.col("_all") > 0, F.col("n") / F.col("_all")).otherwise(0.0).alias("share"))


def drift_windows(stream: DataFrame, order: Sequence[str], value: str, reference: DataFrame, edges: Sequence[float], *, window: int = 5000, every: int = 500, least: int = 50, smoothing: float = 1e-4) -> DataFrame:
    """seen, psi: after each ``every`` values of a stream, the stability index of the last ``window`` against reference shares (bin, share).

    Values are counted in blocks of ``every``; a window is a sum of blocks, so
    no window is held, and the counts of a block are all that is put together.
    """
    if window % every:
        raise ValueError("a window must be whole blocks")
    placed = running_sums(stream.where(F.col(value).isNotNull()).select(*order, value), [F.col(c) for c in order], {"_nth": F.lit(1)})
    b = mx.bin_of(F.col(value), F.array(*map(F.lit, edges)))
    blocks = placed.groupBy(F.floor((F.col("_nth") - 1) / every).alias("block"), b.alias("bin")).agg(F.count("*").alias("n"))
    whole = blocks.groupBy("block").agg(F.sum("n").alias("all")).where(F.col("all") == every).select("block")
    grid = whole.crossJoin(F.broadcast(reference))
    counts = grid.join(blocks, ["block", "bin"], "left").fillna({"n": 0})
    last = W.partitionBy("bin").orderBy("block").rowsBetween(-(window // every) + 1, 0)
    counts = counts.withColumn("w", F.sum("n").over(last))
    total = F.sum("w").over(W.partitionBy("block"))
    k = len(edges) + 1
    smooth = lambda c: (c + smoothing) / (1 + smoothing * k)
    counts = counts.withColumn("total", total).withColumns({"q": smooth(F.col("w") / F.col("total")), "p": smooth(F.col("share"))})
    out = counts.groupBy("block", "total").agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 4).alias("psi"))
    return out.where(F.col("total") >= least).select(((F.col("block") + 1) * every).alias("seen"), "psi")


# --- samples ----------------------------------------------------------------------------------------
def stratified_sample(rows: DataFrame, strata: Sequence[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each stratum (all, if there are fewer): those of least hash, so the same rows at any partitioning."""
    x = F.pmod(F.col(key) * 48271 + seed, F.lit(_P))
    h = F.pmod(x * x, F.lit(_P))
    nth = F.row_number().over(W.partitionBy(*strata).orderBy(h, key))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def connected_sample(nodes: DataFrame, edges: DataFrame, starts: DataFrame, n: int, hops: int) -> DataFrame:
    """Per step, up to n nodes reached from its start within ``hops`` steps of the undirected graph, nearest and least first: step, node, distance."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    of = nodes.select("node", "step")
    inner = both.join(of.select(F.col("node").alias("a"), F.col("step").alias("s")), "a").join(of.select(F.col("node").alias("b"), F.col("step").alias("t")), "b").where("s = t").select("a", "b")
    reached = materialise(starts.select("step", "node", F.lit(0).alias("distance")), "reached")
    for d in range(1, hops + 1):
        step = reached.where(F.col("distance") == d - 1).join(inner, F.col("node") == F.col("a")).select("step", F.col("b").alias("node")).distinct()
        fresh = step.join(reached.select("step", "node"), ["step", "node"], "left_anti").select("step", "node", F.lit(d).alias("distance"))
        reached = materialise(reached.union(fresh), "reached")
    nth = F.row_number().over(W.partitionBy("step").orderBy("distance", "node"))
    return reached.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


# --- outcomes ----------------------------------------------------------------------------------------
# How often a fraud of each kind passes a step-up, and how often the real customer fails it.
FRAUD_PASS, GENUINE_FAIL = 0.30, 0.05


def step_up_outcome(decision: Column, fraud: Column, label_noise: Column, uniform: Column, pass_rate: Column | None = None) -> Column:
    """step_up_passed or step_up_failed of a STEP_UP, null otherwise; a noisy label is undone, as the real payer answers."""
    real = fraud.cast("int").bitwiseXOR(F.coalesce(label_noise, F.lit(False)).cast("int"))
    rate = F.coalesce(pass_rate, F.lit(FRAUD_PASS)) if pass_rate is not None else F.lit(FRAUD_PASS)
    passed = F.when(real == 1, uniform < rate).otherwise(uniform >= GENUINE_FAIL)
    return F.when(decision == "STEP_UP", F.when(passed, "step_up_passed").otherwise("step_up_failed"))


def live_keys(seen: DataFrame, now_us: int, ttl_us: dict[str, int]) -> DataFrame:
    """kind, n: how many keys (kind, key, us) a store still holds when each kind has a time to live since its last sight."""
    last = seen.groupBy("kind", "key").agg(F.max("us").alias("us"))
    ttl = F.create_map(*(F.lit(x) for kv in ttl_us.items() for x in kv))
    return last.where(F.col("us") > now_us - F.element_at(ttl, F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


def late_arrivals(arrivals: DataFrame, key: str = "cust") -> DataFrame:
    """Arrivals (key, seq, us) whose time is before one of their key that had arrived earlier."""
    past = F.max("us").over(W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return arrivals.withColumn("_past", past).where(F.col("us") < F.col("_past")).drop("_past")

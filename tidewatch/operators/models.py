"""Learned scores: boosted trees, isolation forest, stacking, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.scores import logit, sigmoid
from ..storage import materialise
from .metrics import quantiles


def boosted_model(rows: DataFrame, columns: list[str], label: str = "y", *, rounds: int = 20, depth: int = 4, seed: int = 42):
    """A fitted boosted-tree model over the packed ``columns``."""
    pack = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    return GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(pack.transform(rows.withColumn(label, F.col(label).cast("double"))))


def boosted_scores(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``p``, the probability of the positive class."""
    pack = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    return model.transform(pack.transform(df)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def boosted_trees(rows: DataFrame, columns: list[str], label: str = "y", *, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Fit a boosted-tree model; returns a function that adds ``p``, and the features' importances."""
    model = boosted_model(rows, columns, label, rounds=rounds, depth=depth, seed=seed)
    return (lambda df: boosted_scores(model, df, columns)), dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True))


def stacker(rows: DataFrame, inputs: list[str], label: str = "y", l2: float = 1e-3) -> tuple[dict[str, float], float]:
    """Non-negative logistic weights of the logits of score columns, and the intercept."""
    x = rows.select(F.col(label).cast("double").alias("y"), *(logit(F.col(c)).alias(c) for c in inputs))
    fit = LogisticRegression(featuresCol="_x", labelCol="y", elasticNetParam=0.0, regParam=l2, standardization=False, lowerBoundsOnCoefficients=DenseMatrix(1, len(inputs), [0.0] * len(inputs))).fit(VectorAssembler(inputCols=inputs, outputCol="_x").transform(x))
    return dict(zip(inputs, fit.coefficients.toArray().tolist(), strict=True)), float(fit.intercept)


def stacked(weights: dict[str, float], intercept: float) -> Column:
    return sigmoid(sum((F.lit(w) * logit(F.col(c)) for c, w in weights.items()), F.lit(intercept)))


def quantile_points(rows: DataFrame, value: str, points: int = 201) -> list[float]:
    """Evenly spaced quantiles (a fixed number of values)."""
    got = quantiles(rows, value, [i / (points - 1) for i in range(points)]).select("point", "value").collect()
    return [r["value"] for r in sorted(got, key=lambda r: r["point"])]


def calibrated(value: Column, points: list[float]) -> Column:
    """Percentile of a value, linear between quantile points."""
    knots = F.array(*map(F.lit, points))
    n = len(points) - 1
    below = F.size(F.filter(knots, lambda k: k <= value))
    lo, hi = F.get(knots, below - 1), F.get(knots, below)
    inner = (below - 1 + F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)) / n
    return F.when(below == 0, 0.0).when(below > n, 1.0).otherwise(inner)


#: Trees of an isolation forest, and rows that each is grown on.
TREES, SAMPLE = 100, 256


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown_forest(rows: DataFrame, columns: list[str], *, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> dict:
    """A forest grown on a bounded sample (trees x sample rows, those that hash lowest), as plain lists: trees, and the scale of depths."""
    h = F.xxhash64(F.lit(seed), *columns)
    x = rows.select(*(F.col(c).cast("double") for c in columns)).orderBy(h).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(part: np.ndarray, depth: int):
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(len(columns))
        if depth >= limit or len(part) <= 1 or not spread.any():
            return depth + _path(len(part))
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] < cut
        return [f, cut, grow(part[left], depth + 1), grow(part[~left], depth + 1)]

    forest = [grow(x[rng.permutation(len(x))[:sample]], 0) for _ in range(trees)] if len(x) else []
    return {"trees": forest, "scale": _path(min(sample, max(len(x), 2))) or 1.0}


def _anomalies(forest: dict, x: np.ndarray) -> np.ndarray:
    def depths(node, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, list):
            out[at] += node
            return
        left = x[at, node[0]] < node[1]
        depths(node[2], at[left], out)
        depths(node[3], at[~left], out)

    out = np.zeros(len(x))
    for tree in forest["trees"]:
        depths(tree, np.arange(len(x)), out)
    return 2.0 ** (-out / max(len(forest["trees"]), 1) / forest["scale"])


def forest_scores(df: DataFrame, forest: dict, columns: list[str]) -> DataFrame:
    """Adds ``anomaly``, in (0, 1): high where few cuts set a row apart."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(anomaly=_anomalies(shared.value, pdf[columns].to_numpy(np.float64)))

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", anomaly double")


def forest_column(forest: dict, columns: list[str]) -> Column:
    """The same as a Column, for rows whose other columns have no business in Python."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            x = np.stack([a.to_numpy(zero_copy_only=False).astype(np.float64) for a in arrays], axis=1)
            yield pa.array(_anomalies(forest, x))

    return run(*(F.col(c).cast("double") for c in columns))


def isolation_forest(rows: DataFrame, columns: list[str], *, trees: int = TREES, sample: int = SAMPLE, seed: int = 42):
    """Grow a forest; returns a function that adds ``anomaly``."""
    forest = grown_forest(rows, columns, trees=trees, sample=sample, seed=seed)
    return lambda df: forest_scores(df, forest, columns)


#: Rows of a block, which asks for each of its values once.
TAIL_BLOCK = 2**13
_TAIL = "c int, v double, b long, n long"


def _each_value(columns: int, count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of values, and the block first, each value of a column once a batch and block: with its count, or asked for (no count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            for c in range(columns):
                v = batch.column(c + 1).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                for b in np.unique(block):
                    values, n = np.unique(v[(block == b) & ~np.isnan(v)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), c, np.int32)), pa.array(values), pa.array(np.full(len(values), b)), pa.array(n if count else np.zeros_like(n))], ["c", "v", "b", "n"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of values in order, how many are below and up to each that is asked for; at the end a row without block, with the range's count."""
    total, last, low, r = 0, None, 0, None
    names = ["r", "c", "v", "b", "below", "upto"]
    for batch in batches:
        if not batch.num_rows:
            continue
        r, c, v, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        first = np.append(last != (c[0], v[0]), (c[1:] != c[:-1]) | (v[1:] != v[:-1]))
        upto = total + np.cumsum(n)
        below = np.maximum.accumulate(np.where(first, upto - n, low))
        total, last, low = int(upto[-1]), (c[-1], v[-1]), int(below[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[n == 0]) for x in (r, c, v, b, below, upto)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(r[0])], pa.int32()), pa.array([0], pa.int32()), pa.array([0.0]), pa.array([None], pa.int64()), pa.array([0]), pa.array([total])], names)


def fitted_tails(rows: DataFrame, columns: list[str]):
    """Tails of each column of all rows; returns a function that adds ``ecod``.

    A value's tails are the shares of the rows that lie at or below and at or above
    it, at least 1 / (n + 1); the rarer counts, or the one on the side that the column
    leans to (both where it does not lean). Nulls and an empty table have no tails and add nothing.

    No value is left out and none is gathered: the values of all columns, and those asked
    for, are put in order by ranges, where each asked value meets its counts, and go back
    to the blocks of rows that asked. A value that most rows have is sent once a batch or block.
    """
    double = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    at = [f"_{i}" for i in range(len(columns))]
    x = rows.select(F.lit(0).cast("long").alias("_b"), *(double(c).alias(a) for c, a in zip(columns, at, strict=True)))
    told = x.agg(*(F.struct(F.count(a).alias("n"), F.skewness(a).alias("s"), (F.min(a) < F.max(a)).alias("wide")).alias(a) for a in at)).first()
    size = [told[a]["n"] for a in at]
    # a skewness that is no more than rounding is none
    lean = [float(np.sign(told[a]["s"])) if told[a]["wide"] and abs(told[a]["s"] or 0.0) > 1e-9 else 0.0 for a in at]
    start = np.concatenate(([0], np.cumsum(size)))

    def scored(own: pa.Table, tails: pa.Table) -> pa.Table:
        c, v, below, upto = (tails.column(i).to_numpy() for i in ("c", "v", "below", "upto"))
        total = np.zeros(own.num_rows)
        for i, (name, n, s) in enumerate(zip(columns, size, lean, strict=True)):
            asked = own.column(name).cast(pa.float64()).to_numpy() + 0.0
            known = ~np.isnan(asked)
            if not n or not known.any():
                continue
            here = np.flatnonzero(c == i)
            here = here[np.argsort(v[here])]
            place = here[np.searchsorted(v[here], asked[known])]
            left = -np.log(np.maximum(1 / (n + 1), (upto[place] - start[i]) / n))
            right = -np.log(np.maximum(1 / (n + 1), (n - below[place] + start[i]) / n))
            leant = left if s < 0 else right if s > 0 else left + right
            total[known] += np.maximum(np.maximum(left, right), leant)
        return own.drop_columns(["_b"]).append_column("ecod", pa.array(total))

    def add(df: DataFrame) -> DataFrame:
        # numbers of blocks hold only where rows lie still
        placed = materialise(df.withColumn("_b", F.expr(f"monotonically_increasing_id() div {TAIL_BLOCK}")), "tails-rows")
        asked = placed.select("_b", *(double(c) for c in columns)).mapInArrow(_each_value(len(columns), False), _TAIL)
        line = x.mapInArrow(_each_value(len(columns), True), _TAIL).unionByName(asked)
        # of equal values those that count come first
        line = line.repartitionByRange("c", "v").sortWithinPartitions("c", "v", F.desc("n")).select(F.spark_partition_id().alias("r"), "c", "v", "b", "n")
        ranked = materialise(line.mapInArrow(_ranked, "r int, c int, v double, b long, below long, upto long"), "tails")
        before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
        ranges = ranked.where("b is null").select("r", F.coalesce(F.sum("upto").over(before), F.lit(0)).alias("_o"))
        found = ranked.where("b is not null").join(F.broadcast(ranges), "r").select(F.col("b").alias("_tb"), "c", "v", (F.col("below") + F.col("_o")).alias("below"), (F.col("upto") + F.col("_o")).alias("upto"))
        return placed.groupBy("_b").cogroup(found.groupBy("_tb")).applyInArrow(scored, T.StructType([*df.schema.fields, T.StructField("ecod", T.DoubleType())]))

    return add


def leave_one_out(score, rows: DataFrame, columns: list[str], neutral: dict[str, float], key: str = "tx_id") -> DataFrame:
    """Contributions (key, feature, value): log-odds lost when a feature is set to its neutral value."""
    eps = 1e-6
    base = score(rows).select(key, logit(F.col("p"), eps).alias("b"))
    out = None
    for c in columns:
        part = score(rows.withColumn(c, F.lit(neutral[c]))).select(key, logit(F.col("p"), eps).alias("o")).join(base, key).select(key, F.lit(c).alias("feature"), (F.col("b") - F.col("o")).alias("value"))
        out = part if out is None else out.union(part)
    return out

"""Exact attributions of boosted trees: path-dependent Shapley values.

A saved model is a table of nodes. Every root-to-leaf path becomes one game: a
row follows the path at feature i (o_i = 1) or not (0), and where i is unknown a
share z_i of the training rows does, the product of the child-to-parent counts
at the path's splits on i. With the leaf's value v the worth of a set S of known
features is v * prod_{S} o_i * prod_{rest} z_i, and the Shapley value of i is

    v * (o_i - z_i) * sum_k k! (d - 1 - k)! / d! * c_k,

where c_k is the coefficient of t^k in the product of (z_j + o_j t) over the
path's other features: all subsets of k of them at once. Values of all paths
add up, and with the mean output they sum to the model's log-odds. Rows that
follow a path at the same features share its values, so a path costs a batch
one comparison a split and one polynomial a pattern that occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


@dataclass(frozen=True)
class Path:
    """A path to a leaf: its distinct features, for each the bound passed on the left (x <= hi) and on the right (not x <= lo), and its share."""

    features: tuple[int, ...]
    hi: tuple[float | None, ...]
    lo: tuple[float | None, ...]
    share: tuple[float, ...]
    value: float

    def follows(self, below: Callable[[int, float], np.ndarray], n: int) -> np.ndarray:
        """Bit i of a row: it goes along the path at the i-th feature; ``below`` tells which of n rows lie at or under a split's threshold. A missing value goes right, as in the model."""
        mask = np.zeros(n, np.int64)
        for i, f in enumerate(self.features):
            ok = np.ones(n, bool)
            if self.hi[i] is not None:
                ok &= below(f, self.hi[i])
            if self.lo[i] is not None:
                ok &= ~below(f, self.lo[i])
            mask |= ok.astype(np.int64) << i
        return mask

    def values(self, mask: int) -> list[float]:
        """Shapley values of the path's features for rows with this pattern."""
        d = len(self.features)
        o = [float(mask >> i & 1) for i in range(d)]
        out = []
        for i in range(d):
            c = np.ones(1)
            for j in range(d):
                if j != i:
                    c = np.convolve(c, (self.share[j], o[j]))
            weights = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
            out.append(self.value * (o[i] - self.share[i]) * float(np.dot(weights, c)))
        return out


def nodes(model) -> DataFrame:
    """The nodes of a fitted tree ensemble, as the model is stored: tree, weight, id, prediction, n, left, right, feature, threshold."""
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return saved_nodes(spark, path)


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The same of a model that was saved before."""
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return n.join(F.broadcast(weights), "tree").select("tree", "weight", "id", "prediction", F.col("rawCount").alias("n"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("categories"))


def paths(tree_nodes: DataFrame, scale: float = 2.0) -> list[Path]:
    """Every path of the ensemble (as many as leaves); ``scale`` turns summed outputs into log-odds (2 for Spark's boosted classifier)."""
    trees: dict[int, dict[int, dict]] = {}
    for r in tree_nodes.collect():  # the model itself: trees x nodes
        if r["left"] >= 0 and r["categories"] >= 0:
            raise ValueError("splits on categories have no threshold")
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    out: list[Path] = []

    def walk(tree: dict[int, dict], at: int, seen: dict[int, tuple[float | None, float | None, float]]) -> None:
        node = tree[at]
        if node["left"] < 0:
            f = tuple(seen)
            out.append(Path(f, tuple(seen[i][0] for i in f), tuple(seen[i][1] for i in f), tuple(seen[i][2] for i in f), scale * node["weight"] * node["prediction"]))
            return
        f, t = node["feature"], node["threshold"]
        hi, lo, share = seen.get(f, (None, None, 1.0))
        for child, bounds in ((node["left"], (t if hi is None else min(hi, t), lo)), (node["right"], (hi, t if lo is None else max(lo, t)))):
            walk(tree, child, {**seen, f: (*bounds, share * tree[child]["n"] / node["n"])})

    for _, tree in sorted(trees.items()):
        walk(tree, 0, {})
    return out


def expected(of: Sequence[Path]) -> float:
    """The model's mean log-odds over its training rows."""
    return float(sum(p.value * np.prod(p.share) for p in of))


#: Features of a path up to which its patterns are looked up by number, not sorted.
_NUMBERED = 10


def shapley(of: Sequence[Path], x: np.ndarray, known: dict[tuple[int, int], list[float]] | None = None) -> np.ndarray:
    """Attributions (rows, features) of the rows of ``x``. ``known`` keeps the values of a path's patterns from one call to the next."""
    known = {} if known is None else known
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    splits: dict[tuple[int, float], np.ndarray] = {}

    def below(f: int, t: float) -> np.ndarray:
        # paths of a tree share their splits
        if (f, t) not in splits:
            splits[f, t] = columns[f] <= t
        return splits[f, t]

    for k, p in enumerate(of):
        d = len(p.features)
        if not d:
            continue
        mask = p.follows(below, len(x))
        if d <= _NUMBERED:
            patterns, at, size = np.flatnonzero(np.bincount(mask, minlength=1 << d)), mask, 1 << d
            places = patterns
        else:
            patterns, at = np.unique(mask, return_inverse=True)
            places, size = np.arange(len(patterns)), len(patterns)
        table = np.zeros((d, size))
        for place, m in zip(places.tolist(), patterns.tolist(), strict=True):
            if (k, m) not in known:
                known[k, m] = p.values(m)
            table[:, place] = known[k, m]
        for i, f in enumerate(p.features):
            out[f] += table[i][at]
    return out.T


def _phi(of: Sequence[Path], columns: Sequence[pa.Array], known: dict) -> pa.Array:
    x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1)
    flat = shapley(of, x, known).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32)), pa.array(flat))


def contributions(rows: DataFrame, of: Sequence[Path], columns: Sequence[str], key: str = "tx_id") -> DataFrame:
    """key, feature, value: what each of ``columns`` adds to a row's log-odds. With :func:`expected` a row's values sum to its log-odds.

    A missing value is an unknown number to the model, which goes right at every
    split; every row has one value a column, zeros included. Repeated keys are
    told row by row.
    """
    phi = attributed(rows, of, columns, key)
    names = F.array(*map(F.lit, columns))
    return phi.select(key, F.posexplode("_phi").alias("_i", "value")).select(key, F.get(names, F.col("_i")).alias("feature"), "value")


def attributed(rows: DataFrame, of: Sequence[Path], columns: Sequence[str], key: str = "tx_id") -> DataFrame:
    """key and ``_phi``, the row's values of :func:`contributions` in the order of ``columns``: for what is told row by row."""
    shared = rows.sparkSession.sparkContext.broadcast(list(of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], list[float]] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _phi(shared.value, b.columns[1:], known)], [key, "_phi"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, f"`{key}` {kind}, _phi array<double>")


def attribution(of: Sequence[Path], columns: Sequence[str]) -> Column:
    """``_phi`` of :func:`attributed` as a Column, for rows whose other columns have no business in Python."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known: dict[tuple[int, int], list[float]] = {}
        for arrays in batches:
            yield _phi(of, arrays, known)

    return run(*(F.col(c).cast("double") for c in columns))

"""Protocols that refit models: expanding windows over time steps, and ablation of features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import evaluation as ev
from . import metrics as mx
from . import models as md

#: Fits that run side by side; each is a series of Spark jobs of its own.
AT_ONCE = 4
Fit = Callable[[DataFrame, Sequence[str]], Callable[[DataFrame], DataFrame]]


def boosted(rounds: int = 20, depth: int = 4, seed: int = 42) -> Fit:
    """Fits boosted trees on rows with ``y``; the function that it returns adds ``p``."""

    def fit(rows: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
        return md.boosted_trees(rows, list(columns), rounds=rounds, depth=depth, seed=seed)[0]

    return fit


def expanding_predictions(rows: DataFrame, columns: Sequence[str], step: str, folds: Sequence[tuple[int, int]], fit: Fit) -> DataFrame:
    """Rows of each fold (lo, hi) with ``p`` of a model that saw only steps before lo, and ``fitted_to``, its last step.

    Folds do not overlap. A fold without earlier rows of both classes, or with
    no row of its own, gives none.
    """
    for (_, b), (c, _) in zip(sorted(folds), sorted(folds)[1:], strict=False):
        if c <= b:
            raise ValueError("folds overlap")

    def one(fold: tuple[int, int]) -> DataFrame | None:
        lo, hi = fold
        train, held = rows.where(F.col(step) < lo), rows.where(F.col(step).between(lo, hi))
        classes, last = train.agg(F.count_distinct("y"), F.max(step)).first()
        if classes < 2 or held.isEmpty():
            return None
        return materialise(fit(train, columns)(held).withColumn("fitted_to", F.lit(last)), "fold")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = [p for p in pool.map(one, folds) if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumns({"p": F.lit(None).cast("double"), "fitted_to": F.col(step)}).limit(0)


def at_threshold(rows: DataFrame, threshold: float) -> DataFrame:
    """f1, precision, recall of rows (y, p) at a threshold."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    tp, p, n = F.count_if(hit & pos), F.count_if(hit), F.count_if(pos)
    return rows.agg((2 * tp / F.greatest(F.lit(1), p + n)).alias("f1"), F.when(p > 0, tp / p).otherwise(0.0).alias("precision"), F.when(n > 0, tp / n).otherwise(0.0).alias("recall"))


def temporal_protocol(rows: DataFrame, sets: dict[str, Sequence[str]], step: str, train_to: int, folds: Sequence[tuple[int, int]], fit: Fit, *, order: Sequence[str], rounds: int = 100) -> DataFrame:
    """One row a set of features: features, threshold, f1 (with low and high of a stratified bootstrap), precision, recall, f1_at_half, pr_auc.

    Models are fitted on steps up to ``train_to`` and told on later ones. The
    threshold is the best F1 of the expanding-window predictions inside training,
    so no later row has a part in it; 0.5 where no fold has predictions.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "protocol")
    train, test = rows.where(F.col(step) <= train_to), rows.where(F.col(step) > train_to)

    def fitted(columns: Sequence[str]) -> tuple[float, Callable[[DataFrame], DataFrame]]:
        inside = expanding_predictions(train, columns, step, [f for f in folds if f[1] <= train_to], fit)
        best = mx.best_f1(inside.select("y", F.col("p").alias("s"))).first()
        return 0.5 if best is None or best["threshold"] is None else float(best["threshold"]), fit(train, columns)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        models = list(pool.map(fitted, sets.values()))
    # all sets are told on one table, whose rows are drawn once
    told = test
    for i, (_, score) in enumerate(models):
        told = score(told).withColumnRenamed("p", f"_p{i}")
    told = materialise(told.select("y", *order, *(f"_p{i}" for i in range(len(sets)))), "told")
    sample = materialise(ev.drawn(told, order, rounds), "resamples")

    def one(i: int) -> DataFrame:
        (name, columns), threshold = list(sets.items())[i], models[i][0]
        own = told.withColumnRenamed(f"_p{i}", "p")
        ci = ev.interval(ev.f1_by_round(sample, f"_p{i}", threshold), "f1")
        half = at_threshold(own, 0.5).select(F.round("f1", 4).alias("f1_at_half"))
        area = mx.rank_metrics(own.select("y", F.col("p").alias("s"))).select(F.round("average_precision", 4).alias("pr_auc"))
        head = spark.createDataFrame([(name, len(columns), threshold)], "name string, features int, threshold double")
        out = head.crossJoin(at_threshold(own, threshold)).crossJoin(ci).crossJoin(half).crossJoin(area)
        return materialise(out.select("name", "features", "threshold", *(F.round(c, 4).alias(c) for c in ("f1", "precision", "recall")), "low", "high", "f1_at_half", "pr_auc"), "protocol-set")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(len(sets))))


def feature_ablation(train: DataFrame, test: DataFrame, columns: Sequence[str], groups: dict[str, Sequence[str]], fit: Fit) -> DataFrame:
    """What each group of features is worth: group, pr_auc of a model refitted without it, and loss against all (positive: the group helps)."""

    def area(item: tuple[str, Sequence[str]]) -> DataFrame:
        name, gone = item
        told = fit(ev.without_features(train, gone), columns)(ev.without_features(test, gone))
        return materialise(mx.rank_metrics(told.select("y", F.col("p").alias("s"))).select(F.lit(name).alias("group"), F.lit(len(gone)).alias("removed"), F.col("average_precision").alias("ap")), "ablation")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        every = reduce(DataFrame.unionByName, pool.map(area, [("", ()), *groups.items()]))
    base = every.where("group = ''").select(F.col("ap").alias("_all"))
    return every.crossJoin(F.broadcast(base)).select("group", "removed", F.round("ap", 6).alias("pr_auc"), F.round(F.col("_all") - F.col("ap"), 6).alias("loss"))


def learned_layers(rows: DataFrame, columns: Sequence[str], order: Sequence[str], *, trees: int = 20, depth: int = 4) -> DataFrame:
    """The last 15 % of rows in the order, with gbm, anomaly and hybrid: learned scores alone, no rules and no graph.

    Boosted trees are fitted on the first 70 %. The anomaly is the mean of an isolation forest and of
    tail shares, both of the clean rows there (of all of them; the forest's trees are grown on few, as the method has it), as percentiles of the clean rows of the next 15 %;
    on these the two scores are stacked. Rows need ``y``; the order must be unique.
    """
    columns = list(columns)
    split = materialise(ev.row_split(rows, order), "learned-split")
    part = lambda p: split.where(F.col("part") == p).drop("part")
    model = md.boosted_model(part("train"), columns, rounds=trees, depth=depth)
    clean = part("train").where("y = 0")
    forest, tails = md.isolation_forest(clean, columns), md.fitted_tails(clean, columns)
    raw = lambda df: tails(forest(md.boosted_scores(model, df, columns).withColumnRenamed("p", "gbm")))
    # both parts are told at once, so that all clean rows are put in order once
    told = materialise(raw(split.where("part <> 'train'")), "learned-told")
    valid, test = (told.where(F.col("part") == p).drop("part") for p in ("valid", "test"))
    usual = valid.where("y = 0")
    of_forest, of_tails = md.quantile_points(usual, "anomaly"), md.quantile_points(usual, "ecod")
    ready = lambda df: df.withColumn("anomaly", (md.calibrated(F.col("anomaly"), of_forest) + md.calibrated(F.col("ecod"), of_tails)) / 2).drop("ecod")
    weights, intercept = md.stacker(ready(valid), ["gbm", "anomaly"])
    return ready(test).withColumn("hybrid", md.stacked(weights, intercept))


def learned_only_protocol(scored: DataFrame, order: Sequence[str], *, budget: float = 0.01, rounds: int = 100) -> DataFrame:
    """One row a layer of :func:`learned_layers`, whose rows also have ``amount``: the standard block, the interval of its PR area,
    and what it gains on the boosted trees alone (null for these), with interval and verdict, on the same stratified resamples.
    """
    layers = ("gbm", "anomaly", "hybrid")
    scored = materialise(scored, "learned-scores")
    sample = materialise(ev.drawn(scored.select("y", *order, *layers), order, rounds), "learned-resamples")
    by_round = {n: materialise(ev.average_precision_by_round(sample, n), "by-round") for n in layers}
    blocks = ev.layer_metrics(scored, layers, budget)
    own = reduce(DataFrame.unionByName, (ev.interval(by_round[n], "ap").select(F.lit(n).alias("layer"), F.col("low").alias("pr_auc_low"), F.col("high").alias("pr_auc_high")) for n in layers))
    gain = reduce(DataFrame.unionByName, (ev.difference(scored, n, "gbm", by_round[n], by_round["gbm"]).select(F.lit(n).alias("layer"), F.col("delta").alias("gain"), F.col("low").alias("gain_low"), F.col("high").alias("gain_high"), "verdict") for n in layers[1:]))
    return blocks.join(F.broadcast(own), "layer").join(F.broadcast(gain), "layer", "left")

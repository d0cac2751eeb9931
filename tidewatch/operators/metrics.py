"""Rank metrics for rare events, calibration and drift, on rows (y, s[, amount])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import running_sums


def by_score(rows: DataFrame) -> DataFrame:
    """One row a distinct score, highest first, with running counts: s, n, pos, above_n, above_pos (inclusive: cum_n, cum_pos).

    Counts are taken first, so what is put in order is one row a distinct score, by ranges.
    """
    g = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    return running_sums(g, [F.desc("s")], {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def rank_metrics(rows: DataFrame) -> DataFrame:
    """n, positives, average precision (one step a distinct score) and ROC area (ties count half)."""
    g = by_score(rows)
    t = rows.agg(F.count("*").alias("all_n"), F.sum(F.col("y").cast("long")).alias("all_pos"))
    j = g.crossJoin(F.broadcast(t))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.first("all_pos")
    # negatives below a positive count one, at its score one half
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    auc = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)) / (F.first("all_pos") * (F.first("all_n") - F.first("all_pos")))
    return j.agg(F.first("all_n").alias("n"), F.first("all_pos").alias("positives"), ap.alias("average_precision"), auc.alias("roc_auc"))


def recall_at_fpr(rows: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Recall of scores strictly above the ``higher`` quantile 1 - fpr of the negatives' scores."""
    neg = by_score(rows.where("y = 0")).select("s", "cum_n")
    total = rows.where("y = 0").agg(F.count("*").alias("m"))
    # the order statistic from above: m - ceil((m - 1)(1 - fpr))
    place = F.col("m") - F.ceil((F.col("m") - 1) * (1 - fpr) - 1e-9)
    cut = neg.crossJoin(F.broadcast(total)).where(F.col("cum_n") >= place).agg(F.max("s").alias("threshold"))
    return rows.where("y = 1").crossJoin(F.broadcast(cut)).agg(F.avg((F.col("s") > F.col("threshold")).cast("double")).alias("recall"), F.first("threshold").alias("threshold"))


def budget_weights(rows: DataFrame, budget: float = 0.01) -> DataFrame:
    """Adds ``weight``: 1 above the k-th score, the rest of k shared by its ties, 0 below; k = budget of the rows, 1 at least."""
    g = by_score(rows)
    k = rows.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(budget)).cast("long")).alias("k"))
    at = g.crossJoin(F.broadcast(k)).where("cum_n >= k and cum_n - n < k").select(F.col("s").alias("kth"), ((F.col("k") - F.col("cum_n") + F.col("n")) / F.col("n")).alias("share"), "k")
    return rows.crossJoin(F.broadcast(at)).withColumn("weight", F.when(F.col("s") > F.col("kth"), 1.0).when(F.col("s") == F.col("kth"), F.col("share")).otherwise(0.0))


def budget_metrics(rows: DataFrame, budget: float = 0.01, review_cost: float = 50.0) -> DataFrame:
    """Precision, recall, recall by amount, and cost (missed amount and false alerts) at an alert budget."""
    w = budget_weights(rows, budget)
    hit, y = F.sum(F.col("weight") * F.col("y")), F.col("y")
    lost = F.sum(F.when(y == 1, F.col("amount") * (1 - F.col("weight"))).otherwise(0.0))
    return w.agg(F.first("k").alias("alerts"), (hit / F.first("k")).alias("precision"), (hit / F.sum(y)).alias("recall"), (F.sum(F.col("weight") * y * F.col("amount")) / F.sum(y * F.col("amount"))).alias("amount_recall"), (lost + review_cost * F.sum(F.col("weight") * (1 - y))).alias("cost"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins."""
    b = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg("s").alias("p"), F.avg("y").alias("q"), F.sum(F.pow(F.col("s") - F.col("y"), F.lit(2.0))).alias("e"))
    return g.agg((F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("q"))) / F.sum("n")).alias("ece"))


def bin_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below a value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def quantiles(values: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., point, value: exact quantiles of each group, linear between order statistics.

    Values are counted and the counts put in order by ranges, so a group that holds most
    rows is split too and no task keeps all distinct values. Null values are left out, NaN
    is the largest; groups without values have no rows, a null group is one of its own.
    """
    g = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    g = running_sums(g, [*map(F.col, by), F.col("_v")], {"_upto": F.col("_c")})
    whole = g.groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"))
    j = g.join(whole, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]) if by else g.crossJoin(F.broadcast(whole))

    def here(place: Column) -> Column:
        """Whether the order statistic of a place, from 0, is this row's value."""
        return (place >= F.col("_upto") - F.col("_c") - F.col("_base")) & (place < F.col("_upto") - F.col("_base"))

    places = F.array(*(F.struct(F.lit(float(p)).alias("point"), ((F.col("_n") - 1) * F.lit(float(p))).alias("at")) for p in points))
    low, high = F.floor("_p.at"), F.ceil("_p.at")
    met = j.withColumn("_p", F.explode(F.filter(places, lambda p: here(F.floor(p["at"])) | here(F.ceil(p["at"])))))
    ends = met.groupBy(*by, F.col("_p.point").alias("point")).agg(F.max(F.when(here(low), F.col("_v"))).alias("_low"), F.max(F.when(here(high), F.col("_v"))).alias("_high"), F.first("_p.at").alias("_at"))
    mid = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    return ends.select(*by, "point", F.when((F.col("_low") == F.col("_high")) | (F.floor("_at") == F.col("_at")), F.col("_low")).otherwise(mid).alias("value"))


def reference_edges(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row: distinct interpolated quantiles, to 8 digits; null without values."""
    q = quantiles(values, value, [i / bins for i in range(1, bins)])
    return q.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))), lambda x: F.round(x["value"], 8))).alias("edges")).select(F.when(F.size("edges") > 0, F.col("edges")).alias("edges"))


def psi(expected: DataFrame, actual: DataFrame, value: str, bins: int = 10, smoothing: float = 1e-4) -> DataFrame:
    """Population stability index of two samples over the expected one's deciles; shares are smoothed and renormalised."""
    edges = reference_edges(expected, value, bins)

    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.crossJoin(F.broadcast(edges)).groupBy(bin_of(F.col(value), F.col("edges")).alias("b")).agg(F.count("*").alias(name))

    every = edges.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("b"))
    j = every.join(shares(expected, "e"), "b", "left").join(shares(actual, "a"), "b", "left").fillna(0)
    total = j.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"), F.count("*").alias("k"))
    j = j.crossJoin(F.broadcast(total))
    p, q = ((F.col(c) / F.col(t) + smoothing) / (1 + smoothing * F.col("k")) for c, t in (("e", "te"), ("a", "ta")))
    return j.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def time_split(rows: DataFrame, order: str = "us", train: float = 0.70, valid: float = 0.15) -> DataFrame:
    """Adds ``part``: by time, cut where the share of rows is reached; equal times stay together."""
    g = running_sums(rows.groupBy(order).agg(F.count("*").alias("_n")), [F.col(order)], {"_upto": F.col("_n")})
    total = rows.agg(F.count("*").alias("_all"))
    first = F.col("_upto") - F.col("_n")
    g = g.crossJoin(F.broadcast(total)).select(order, F.when(first < F.floor(F.col("_all") * train), "train").when(first < F.floor(F.col("_all") * (train + valid)), "valid").otherwise("test").alias("part"))
    return rows.join(g, order)


def bootstrap_recall(rows: DataFrame, rounds: int = 100, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """Interval (2.5 and 97.5 percent) of recall and precision under Poisson resampling by row hash.

    Each row draws its count for every round from its own hash, so all rounds
    are one pass and the sums of a round are all that is shuffled.
    """
    r = rows.withColumn("_h", F.xxhash64(F.lit(seed), *rows.columns)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = (F.shiftrightunsigned(F.xxhash64("_h", "round"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    # Poisson(1) by inversion; beyond 6 the mass is under 1e-4
    cum, terms, p = 0.0, [], 2.718281828459045**-1
    for k in range(7):
        cum += p
        terms.append(cum)
        p /= k + 1
    times = sum((F.when(u > c, 1).otherwise(0) for c in terms), F.lit(0))
    s = r.withColumn("_k", times).groupBy("round").agg(F.sum(F.when((F.col("y") == 1) & (F.col("s") >= threshold), F.col("_k")).otherwise(0)).alias("tp"), F.sum(F.col("_k") * F.col("y")).alias("pos"), F.sum(F.when(F.col("s") >= threshold, F.col("_k")).otherwise(0)).alias("alerts"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return s.agg(F.round(q(F.col("tp") / F.col("pos"))[0], 4).alias("recall_low"), F.round(q(F.col("tp") / F.col("pos"))[1], 4).alias("recall_high"), F.round(q(F.col("tp") / F.col("alerts"))[0], 4).alias("precision_low"), F.round(q(F.col("tp") / F.col("alerts"))[1], 4).alias("precision_high"))


def best_f1(rows: DataFrame) -> DataFrame:
    """The threshold of the best F1, the highest on ties."""
    total = rows.agg(F.sum("y").alias("p"))
    g = by_score(rows).crossJoin(F.broadcast(total)).withColumn("f1", 2 * F.col("cum_pos") / (F.col("cum_n") + F.col("p")))
    return g.agg(F.max_by("s", F.struct("f1", "s")).alias("threshold"), F.max("f1").alias("f1"))


def empirical_tails(df: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier score of each row: sum over columns of -ln of the rarer tail's share, in one table (ECOD)."""
    out = df
    for c in columns:
        g = running_sums(df.groupBy(c).agg(F.count("*").alias("_n")), [F.col(c)], {"_low": F.col("_n")})
        total = df.agg(F.count("*").alias("_t"))
        tails = g.crossJoin(F.broadcast(total)).select(c, (-F.log(F.col("_low") / F.col("_t"))).alias(f"_l_{c}"), (-F.log((F.col("_t") - F.col("_low") + F.col("_n")) / F.col("_t"))).alias(f"_u_{c}"))
        out = out.join(tails, c)
    parts = [F.greatest(F.col(f"_l_{c}"), F.col(f"_u_{c}")) for c in columns]
    return out.withColumn("ecod", sum(parts[1:], parts[0])).drop(*(f"_{s}_{c}" for c in columns for s in "lu"))

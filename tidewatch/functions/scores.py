"""Arithmetic of scores on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def noisy_or(scores: Column) -> Column:
    """1 - product of (1 - score) over an array; scores are clipped to 0..1."""
    return F.lit(1.0) - F.aggregate(scores, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - clip(x)))


def logit(p: Column, eps: float = 1e-3) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def average_path_length(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    harmonic = F.log(n - 1) + F.lit(0.5772156649015329)
    return F.when(n > 2, 2 * harmonic - 2 * (n - 1) / n).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


#: Actions from mildest to strictest.
ACTIONS = ("ALLOW", "STEP_UP", "HOLD", "BLOCK")


def action_rank(action: Column) -> Column:
    """Place in ACTIONS; -1 for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), action).cast("int") - 1, F.lit(-1))


def ranked_action(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, ACTIONS)), rank.cast("int"))


def threshold_action(risk: Column, step_up: float = 0.35, hold: float = 0.60, block: float = 0.85) -> Column:
    if not 0 < step_up < hold < block <= 1:
        raise ValueError("thresholds must be 0 < step_up < hold < block <= 1")
    return F.when(risk >= block, "BLOCK").when(risk >= hold, "HOLD").when(risk >= step_up, "STEP_UP").otherwise("ALLOW")

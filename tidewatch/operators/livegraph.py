"""A payment graph that grows by increments: links by day, and components that are mended only where links came or went.

A link's counts are kept by day, so an increment is added up, a window moves by
leaving out days, and the state is the same in whatever order increments come.
An increment's new links join components; a component that lost a link is found
anew from its own links. All other labels stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise
from . import frames as fr
from .graph import components

LINKS = "a string, b string, day long, n long, total decimal(28,8), last_us long"
LABELS = "node string, component string"


@dataclass(frozen=True)
class GraphState:
    """``links``: a (C:..., D:...), b (A:..., D:...), day, n, total, last_us. ``labels``: node, component (its least node). ``day``: the newest seen."""

    links: DataFrame
    labels: DataFrame
    day: int | None = None

    def edges(self) -> DataFrame:
        """a, b, n, total, last_us over the days of the window."""
        return self.links.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_us").alias("last_us"))

    def discard(self) -> None:
        discard(self.links, self.labels)


def empty(spark: SparkSession) -> GraphState:
    return GraphState(spark.createDataFrame([], LINKS), spark.createDataFrame([], LABELS))


def links(tx: DataFrame) -> DataFrame:
    """Links of payments (us, cust, amount, payee, device): customer to account with its amounts, customer to device. Empty and null ends give none."""
    end = lambda kind, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    none = F.lit(0).cast("decimal(28,8)")
    both = F.array(F.struct(end("A", "payee").alias("b"), F.coalesce(F.col("amount").cast("decimal(28,8)"), none).alias("amount")), F.struct(end("D", "device").alias("b"), none.alias("amount")))
    e = tx.select(end("C", "cust").alias("a"), "us", F.explode(both).alias("e")).select("a", "e.*", "us").where("a is not null and b is not null and us is not null")
    return e.groupBy("a", "b", F.expr(f"us div {fr.DAY}").alias("day")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,8)").alias("total"), F.max("us").alias("last_us"))


def _pairs(links: DataFrame) -> DataFrame:
    return links.select("a", "b").distinct()


def observe(state: GraphState, tx: DataFrame, days: int) -> GraphState:
    """The state after an increment of payments; links older than ``days`` before the newest day seen go. The old state's tables can be discarded."""
    fresh = materialise(links(tx), "graph-increment")
    seen = fresh.agg(F.max("day")).first()[0]
    newest = max((d for d in (state.day, seen) if d is not None), default=None)
    if newest is None:
        return state
    first = newest - days
    every = state.links.unionByName(fresh).where(F.col("day") >= first)
    kept = materialise(every.groupBy("a", "b", "day").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,8)").alias("total"), F.max("last_us").alias("last_us")), "graph-links")
    before, after = _pairs(state.links), _pairs(kept)
    gone = before.join(after, ["a", "b"], "left_anti")
    came = after.join(before, ["a", "b"], "left_anti")
    labels = materialise(_mended(state.labels, after, gone, came), "graph-labels")
    discard(fresh)
    return GraphState(kept, labels, newest)


def _mended(labels: DataFrame, now: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """Labels after the pairs ``gone`` and ``came``; ``now`` are all pairs."""
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
    broken = gone.join(of("a", "component"), "a").select("component").distinct()
    whole = labels.join(broken, "component", "left_anti").select("node", "component")
    parts = labels.join(broken, "component", "left_semi").select("node")
    # what is left of the broken ones, from their own pairs alone; a node without pairs goes
    inner = now.join(came, ["a", "b"], "left_anti").join(parts.withColumnRenamed("node", "a"), "a", "left_semi")
    healed = components(inner).select("node", "component")
    labels = materialise(whole.unionByName(healed), "graph-healed")
    # new pairs join components: the pairs are drawn between labels, so only labels are walked
    named = came.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    between = materialise(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "graph-joins")
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = came.select(F.col("a").alias("node")).union(came.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = labels.unionByName(nodes).join(moved, "component", "left")
    return out.select("node", F.coalesce("to", "component").alias("component"))

"""Entity-graph signals of payments.

Payments have tx_id, us, cust, payee, amount; owners have payee and owner, the
customer whose account it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from ..storage import discard, materialise
from . import frames as fr

HUB = 200


def edge_burst(tx: DataFrame, window_us: int = fr.HOUR, threshold: int = 3) -> DataFrame:
    """tx_id, n: payments on the same edge in the closed window up to and with this one, and burst = n / threshold, 1 at most.

    Later payments of the same microsecond are not counted.
    """
    known = F.coalesce(F.col("payee"), F.lit("")) != ""
    n = fr.sums_before(tx.select("tx_id", "us", "cust", "payee"), ["cust", "payee"], {"n": (window_us + 1, F.lit(1))})
    n = n.select("tx_id", F.when(known, F.col("n").cast("long") + 1).otherwise(0).alias("n"))
    return n.withColumn("burst", F.least(F.lit(1.0), F.col("n") / threshold))


def pass_through(tx: DataFrame, owners: DataFrame, window_us: int, min_senders: int = 2, min_inflow: float = 10_000.0) -> DataFrame:
    """Money that came in from others in the closed window before a payment and is passed on with it.

    A customer's payments and what their accounts receive are one line in time,
    so inflow, outflow and the number of senders are running sums; no payment
    is paired with what came in before it.
    """
    known = F.coalesce(F.col("payee"), F.lit("")) != ""
    none = F.lit(None)
    paid = tx.select("tx_id", "us", "cust", "amount", F.when(known, F.col("amount")).otherwise(0.0).alias("out_amount"), F.lit(0.0).alias("in_amount"), none.cast("string").alias("sender"), F.lit(True).alias("pays"))
    got = tx.join(owners, "payee").where("owner <> cust").select("tx_id", "us", F.col("owner").alias("cust"), none.cast("double").alias("amount"), F.lit(0.0).alias("out_amount"), F.col("amount").alias("in_amount"), F.col("cust").cast("string").alias("sender"), F.lit(False).alias("pays"))
    line = fr.sums_before(paid.union(got), ["cust"], {"outflow": (window_us + 1, F.col("out_amount")), "inflow": (window_us + 1, F.col("in_amount"))})
    line = fr.distinct_before(line, ["cust"], F.col("sender"), {"fan_in": window_us + 1}).where("pays")
    j = line.select("tx_id", "amount", *(F.col(c).cast("double").alias(c) for c in ("outflow", "inflow")), F.col("fan_in").cast("long").alias("fan_in"))
    ratio = F.least(F.lit(1.0), (F.col("outflow") + F.col("amount")) / F.col("inflow"))
    enough = (F.col("fan_in") >= min_senders) | (F.col("inflow") >= min_inflow)
    return j.select("tx_id", "inflow", "fan_in", F.when((F.col("inflow") > 0) & (F.col("amount") > 0) & enough, ratio).otherwise(0.0).alias("pass_through"))


def cycles(tx: DataFrame, owners: DataFrame, window_us: int, hops: int = 3, band: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """tx_id of payments whose owner-to-owner path leads similar money back to the sender within the window before it."""
    moves = tx.join(owners, "payee").select(F.col("cust").alias("src"), F.col("owner").alias("dst"), F.col("us").alias("m_us"), F.col("tx_id").alias("m_tx"), F.col("amount").alias("m_amount"))
    moves = moves.withColumn("slot", F.floor(F.col("m_us") / F.lit(window_us)))
    at = tx.join(owners, "payee").where("owner <> cust").select("tx_id", "us", "cust", "amount", F.col("owner").alias("at"))
    found = None
    seen = at
    for hop in range(hops):
        probe = at.withColumn("slot", F.explode(F.array(F.floor(F.col("us") / F.lit(window_us)), F.floor(F.col("us") / F.lit(window_us)) - 1)))
        earlier = (F.col("m_us") < F.col("us")) | ((F.col("m_us") == F.col("us")) & (F.col("m_tx") < F.col("tx_id")))
        step = probe.join(moves, (probe["at"] == moves["src"]) & (probe["slot"] == moves["slot"])).where((F.col("m_us") >= F.col("us") - window_us) & earlier & F.col("m_amount").between(F.col("amount") * band[0], F.col("amount") * band[1]))
        step = step.select("tx_id", "us", "cust", "amount", F.col("dst").alias("at")).distinct()
        step = materialise(step, "cycle-step") if hop + 1 < hops else step
        back = step.where(F.col("at") == F.col("cust")).select("tx_id")
        found = back if found is None else found.union(back)
        at = step.where(F.col("at") != F.col("cust")).join(seen.select("tx_id", "at"), ["tx_id", "at"], "left_anti").select("tx_id", "us", "cust", "amount", "at")
        seen = seen.union(at)
    return found.distinct()


def undirected(tx: DataFrame) -> DataFrame:
    """Both directions of the customer-payee edges: a, b; customers are C:..., accounts A:...."""
    e = tx.where("payee <> ''").select(F.concat(F.lit("C:"), "cust").alias("a"), F.concat(F.lit("A:"), "payee").alias("b")).distinct()
    return e.union(e.select("b", "a"))


def fraud_distance(tx: DataFrame, edges: DataFrame, flagged: DataFrame, hub: int = HUB) -> DataFrame:
    """tx_id, fraud_distance: steps (0 to 2) from the payer or payee to a flagged node other than the payer; null beyond.

    Nodes with more than ``hub`` neighbours are not walked through.
    """
    degree = edges.groupBy("a").count().where(F.col("count") <= hub).select("a")
    walk = edges.join(degree, "a")
    starts = tx.select("tx_id", F.concat(F.lit("C:"), "cust").alias("me"), F.when(F.col("payee") != "", F.concat(F.lit("A:"), "payee")).alias("to"))
    ends = starts.select("tx_id", "me", F.explode(F.array("me", "to")).alias("n")).where("n is not null")
    flag = flagged.select("n").distinct()
    zero = ends.where("n <> me").join(flag, "n").select("tx_id", F.lit(0).alias("d"))
    # distances of nodes, not of payments: each node's flagged neighbours are found once
    near = walk.join(flag.select(F.col("n").alias("b")), "b").select("a", F.col("b").alias("f")).distinct()
    one = ends.join(near, ends["n"] == near["a"]).where("f <> me").select("tx_id", F.lit(1).alias("d")).distinct()
    few = near.groupBy("a").agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    two_of = walk.join(few.withColumnRenamed("a", "b"), "b").select("a", "b", "lo", "hi")
    two = ends.join(two_of, ends["n"] == two_of["a"]).where("b <> me and (lo <> me or hi <> me)").select("tx_id", F.lit(2).alias("d")).distinct()
    best = zero.union(one).union(two).groupBy("tx_id").agg(F.min("d").alias("fraud_distance"))
    return tx.select("tx_id").join(best, "tx_id", "left")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank of a weighted directed graph (src, dst, w); dangling weight is spread evenly. Ranks sum to 1."""
    edges = materialise(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "pagerank-weights")
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    nodes = materialise(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(out.withColumnRenamed("src", "node"), "node", "left"), "pagerank-nodes")
    n = nodes.count()
    share = materialise(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "pagerank-edges")
    discard(edges)
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"), F.col("total").isNull().alias("dangling"))
    kept = nodes
    for _ in range(rounds):
        # read twice, for what is lost and what is sent: a table a round, or rounds would be made again and again
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = ranks.join(share, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        ranks = ranks.join(sent, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"), "dangling")
        ranks, stale = materialise(ranks, "pagerank"), kept
        discard(stale)
        kept = ranks
    return ranks.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of an undirected graph (a, b), by star contraction until nothing moves."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        fresh = materialise(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "components")
        discard(e)
        e = fresh
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def ring_statistics(tx: DataFrame, owners: DataFrame, labels: DataFrame, flagged: DataFrame, least: int = 3) -> DataFrame:
    """Communities with enough customers that hold a flagged one or move money among themselves: members, internal transfers and total."""
    c = labels.select(F.regexp_replace("node", "^C:", "").alias("cust"), "community").where("node like 'C:%'")
    t = tx.withColumn("cust", F.col("cust").cast("string")).join(owners.withColumn("owner", F.col("owner").cast("string")), "payee")
    inner = t.join(c, "cust").join(c.select(F.col("cust").alias("owner"), F.col("community").alias("other")), "owner").where("community = other and cust <> owner")
    money = inner.groupBy("community").agg(F.count("*").alias("internal_transfers"), F.sum("amount").alias("internal_total"))
    size = c.join(flagged.select(F.regexp_replace("n", "^C:", "").alias("cust"), F.lit(1).alias("f")), "cust", "left").groupBy("community").agg(F.count("*").alias("members"), F.count("f").alias("flagged"))
    return size.join(money, "community", "left").fillna({"internal_transfers": 0, "internal_total": 0.0}).where((F.col("members") >= least) & ((F.col("flagged") > 0) | (F.col("internal_transfers") >= 2)))


def device_mule_scores(tx: DataFrame, window_us: int = fr.HOUR) -> DataFrame:
    """Distinct customers per device and per payee, and payees per customer, in the closed window, ramped and weighed .5, .3, .2."""
    t = tx.select("tx_id", "us", "cust", "payee", "device")
    counts = {}
    for name, key, value in (("per_device", "device", "cust"), ("per_payee", "payee", "cust"), ("per_customer", "cust", "payee")):
        t = fr.distinct_before(t, [key], F.col(value), {name: window_us + 1})
        own = F.when(F.col(f"_here_{name}") | (F.coalesce(F.col(value).cast("string"), F.lit("")) == ""), 0).otherwise(1)
        counts[name] = (F.col(name) + own).cast("int")
    s = t.select("tx_id", *(c.alias(n) for n, c in counts.items()))
    ramp = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - 1) / 4.0))
    return s.withColumn("score", 0.5 * ramp(F.col("per_device")) + 0.3 * ramp(F.col("per_payee")) + 0.2 * ramp(F.col("per_customer")))


def graph_score(known_mule: Column, ratio: Column, fan_in: Column, cycle: Column, shared_device: Column, distance: Column, centrality: Column) -> Column:
    """Noisy-or of the graph's parts."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    near = F.when(distance == 1, 0.5).when(distance == 2, 0.25).otherwise(0.0)
    return F.round(noisy_or(F.array(part(known_mule, 0.9), F.when((ratio >= 0.7) & (fan_in >= 1), 0.6 * ratio).otherwise(0.0), part(cycle, 0.6), part(shared_device, 0.7), near, part(centrality >= 0.8, 0.3))), 4)


def neighbourhood(edges: DataFrame, start: str, hops: int = 2, most: int = 150, hub: int = HUB) -> DataFrame:
    """Nodes within ``hops`` of one node, nearest first: n, distance (the listing itself is limited to ``most``)."""
    spark = edges.sparkSession
    small = edges.groupBy("a").count().where(F.col("count") <= hub).select("a")
    walk = edges.join(small, "a")
    reached = spark.createDataFrame([(start, 0)], "n string, distance int")
    for d in range(1, hops + 1):
        step = walk.join(reached.where(F.col("distance") == d - 1), F.col("a") == F.col("n")).select(F.col("b").alias("n")).distinct().join(reached.select("n"), "n", "left_anti")
        reached = reached.union(step.select("n", F.lit(d).alias("distance")))
    return reached.orderBy("distance", "n").limit(most)


def same_step(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, s: the edges whose ends (node, step) are of one step."""
    e = edges.join(nodes.select(F.col("node").alias("src"), F.col("step").alias("s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("step").alias("t")), "dst")
    return e.where("s = t").select("src", "dst", "s")


def step_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per step: in- and out-degree of each node (node, step) from edges (src, dst) within one step."""
    return step_degrees(nodes, same_step(nodes, edges))


def step_degrees(nodes: DataFrame, same: DataFrame) -> DataFrame:
    """The same from the edges of :func:`same_step`."""
    outs, ins = same.groupBy("src").agg(F.count("*").alias("out_degree")), same.groupBy("dst").agg(F.count("*").alias("in_degree"))
    j = nodes.join(outs, nodes["node"] == outs["src"], "left").join(ins, nodes["node"] == ins["dst"], "left")
    return j.select("node", "step", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def cross_step_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.join(nodes.select(F.col("node").alias("src"), F.col("step").alias("s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("step").alias("t")), "dst")
    return e.agg(F.count_if(F.col("s") != F.col("t")).alias("cross_step_edges"), F.count("*").alias("edges"))

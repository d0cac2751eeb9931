"""Signals beside the rules: address, location, purpose, scam patterns, consortium, network, behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx_
from ..functions.scores import clip, noisy_or
from ..storage import discard, running_sums
from . import frames as fr
from . import graph as gr
from . import matching as mt


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


# --- features ------------------------------------------------------------------------------
def location_features(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """tx_id, is_new_location: the place is known and not among the customer's (cust, locations); 1 also for a customer without record."""
    j = tx.join(customers.select("cust", "locations"), "cust", "left")
    known = F.coalesce(F.array_contains("locations", F.col("location")), F.lit(False))
    return j.select("tx_id", _flag((F.coalesce("location", F.lit("")) != "") & ~known).alias("is_new_location"))


def address_features(tx: DataFrame, ranges: DataFrame) -> DataFrame:
    """tx_id, ip_country_mismatch, is_anonymized_ip, from the narrowest range (cidr, country, vpn, tor) that holds the address."""
    hit = mt.longest_prefix(tx.select("tx_id", "ip", F.upper(F.coalesce("country", F.lit(""))).alias("_country")), mt.cidr_ranges(ranges.withColumnRenamed("country", "ip_country")))
    mismatch = F.col("ip_country").isNotNull() & (F.col("_country") != "") & (F.col("_country") != F.upper("ip_country"))
    return hit.select("tx_id", _flag(mismatch).alias("ip_country_mismatch"), _flag(F.col("vpn") | F.col("tor")).alias("is_anonymized_ip"))


def external_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with every external feature: those that it lacks, and their nulls, are 0."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0) for n in names})


def behaviour_vector(f: dict[str, Column]) -> dict[str, Column]:
    """Ten features scaled to 0..1: of time of day, amount, velocity, typing, login, novelty, sharing."""
    hour = F.lit(2.0) * F.pi() * f["hour"] / 24
    login = f["login_to_transfer_s"]
    return {
        "amount_z": clip((f["amount_zscore"] + 3) / 9),
        "hour_sin": 0.5 + 0.5 * F.sin(hour),
        "hour_cos": 0.5 + 0.5 * F.cos(hour),
        "velocity": clip(f["cnt_1h"] / 20),
        "payees": clip(f["distinct_payees_24h"] / 10),
        "typing": clip(f["typing_deviation"] / 8),
        "login": F.when(login < 0, 0.5).otherwise(clip(F.log1p(F.greatest(login, F.lit(0.0))) / F.log1p(F.lit(3600.0)))),
        "new_device": f["is_new_device"],
        "new_payee": f["is_new_payee"],
        "shared_device": clip((f["device_customers_7d"] - 1) / 4),
    }


# --- scam patterns ---------------------------------------------------------------------------
# Weights of the patterns, and thresholds.
APP_WEIGHTS = {"new_payee_high": 0.30, "first_large": 0.15, "purpose": 0.45, "active_call": 0.45, "remote_access": 0.50, "long_session": 0.15, "vulnerable": 0.20, "cop_no_match": 0.45, "cop_close": 0.10, "young_payee": 0.20, "mule_payee": 0.50}
KNOWN_PAYEE_DAMPING, HIGH_RATIO, LONG_SESSION_S, YOUNG_PAYEE_D, CONFIRM_FROM = 0.3, 3.0, 900.0, 90, 0.5
# Words that choose the warning.
AUTHORITY = ("polis", "savci", "savcı", "güvenli hesap", "guvenli hesap", "güvenli hesab", "masak")
INVESTMENT = ("yatırım", "yatirim", "kripto", "crypto", "getiri", "garantili", "investment")


def scam_parts() -> dict[str, tuple[str, Column]]:
    """Patterns by weight name: code and weight where it holds, 0 elsewhere. Columns are those of :func:`scam_signal`."""
    new, part = F.col("is_new_payee") >= 1, lambda c, w: F.when(F.coalesce(c, F.lit(False)), APP_WEIGHTS[w]).otherwise(0.0)
    return {
        "new_payee_high": ("APP_NEW_PAYEE_HIGH", part(new & (F.col("amount_ratio") >= HIGH_RATIO), "new_payee_high")),
        "first_large": ("APP_FIRST_LARGE", part(new & (F.col("first_large_transfer") >= 1), "first_large")),
        "purpose": ("APP_URGENT_TEXT", F.when(F.col("purpose_risk") > 0, APP_WEIGHTS["purpose"] * F.col("purpose_risk")).otherwise(0.0)),
        "active_call": ("APP_ACTIVE_CALL", part(new & (F.col("active_call") >= 1), "active_call")),
        "remote_access": ("APP_REMOTE_ACCESS", part(F.col("remote_access") >= 1, "remote_access")),
        "long_session": ("APP_LONG_SESSION", part(new & (F.col("session_duration_s") >= LONG_SESSION_S), "long_session")),
        "vulnerable": ("APP_VULNERABLE", part(new & (F.col("vulnerable_customer") >= 1), "vulnerable")),
        "cop_no_match": ("APP_COP_NO_MATCH", part(F.col("cop") == "NO_MATCH", "cop_no_match")),
        "cop_close": ("APP_COP_CLOSE", part(F.col("cop") == "CLOSE", "cop_close")),
        "young_payee": ("APP_YOUNG_PAYEE", part(F.col("payee_account_age_d") < YOUNG_PAYEE_D, "young_payee")),
        "mule_payee": ("APP_MULE_PAYEE", part(F.col("graph_known_mule_payee") >= 1, "mule_payee")),
    }


def scam_warning(purpose: Column, remote_access: Column, active_call: Column, cop: Column) -> Column:
    """Which warning to show: words of the purpose first, then the session, then the payee's name."""
    text = F.lower(F.coalesce(purpose, F.lit("")))
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when(said(AUTHORITY), "authority").when(said(INVESTMENT), "investment").when(remote_access >= 1, "remote").when(active_call >= 1, "call").when(cop == "NO_MATCH", "cop").otherwise("default")


def scam_signal(df: DataFrame) -> DataFrame:
    """Adds app_score, app_patterns, app_warning, cop_no_match and cop_unknown.

    Columns: is_new_payee, amount_ratio, first_large_transfer, purpose_risk,
    active_call, remote_access, session_duration_s, vulnerable_customer, cop,
    payee_account_age_d (null: unknown), graph_known_mule_payee, purpose. A
    known payee whose name matches damps the score; below CONFIRM_FROM no warning is shown.
    """
    parts = scam_parts()
    score = noisy_or(F.array(*(w for _, w in parts.values())))
    damped = F.when((F.col("is_new_payee") < 1) & (F.col("cop") != "NO_MATCH"), score * KNOWN_PAYEE_DAMPING).otherwise(score)
    patterns = F.filter(F.array(*(F.when(w > 0, F.lit(code)) for code, w in parts.values())), lambda x: x.isNotNull())
    out = df.withColumn("app_score", F.round(damped, 4)).withColumn("app_patterns", patterns)
    warning = scam_warning(F.col("purpose"), F.col("remote_access"), F.col("active_call"), F.col("cop"))
    return out.withColumns({"app_warning": F.when(F.col("app_score") >= CONFIRM_FROM, warning), "cop_no_match": _flag(F.col("cop") == "NO_MATCH"), "cop_unknown": _flag(F.col("cop") == "UNKNOWN")})


def payee_account_age(day: Column, opened: Column) -> Column:
    """Days between the payment and the opening of the payee's account; null if that is unknown."""
    return F.datediff(day, opened).cast("double")


def purpose_risk(purpose: Column, keywords: dict[str, float]) -> Column:
    """Sum of the weights of the keywords that the folded purpose holds, 1 at most."""
    return mt.keyword_score(purpose, keywords)


# --- consortium -------------------------------------------------------------------------------
def consortium_signal(tx: DataFrame, reports: DataFrame, salt: str, own_bank: str) -> DataFrame:
    """tx_id, consortium_score (1 for the payee, .7 for the device), banks: other banks that reported either.

    Reports are (digest, bank); only salted digests are compared.
    """
    others = reports.where(F.col("bank") != own_bank).groupBy("digest").agg(F.collect_set("bank").alias("banks"))

    def reported(kind: str, column: str) -> DataFrame:
        keyed = tx.where(F.coalesce(column, F.lit("")) != "").select("tx_id", tx_.digest(kind, F.col(column), salt).alias("digest"))
        return keyed.join(others, "digest").select("tx_id", F.col("banks").alias(kind))

    j = fr.beside(fr.beside(tx.select("tx_id"), reported("iban", "payee"), "left"), reported("device", "device"), "left")
    none = F.array().cast("array<string>")
    banks = F.array_sort(F.array_union(F.coalesce("iban", none), F.coalesce("device", none)))
    return j.select("tx_id", F.when(F.col("iban").isNotNull(), 1.0).when(F.col("device").isNotNull(), 0.7).otherwise(0.0).alias("consortium_score"), banks.alias("banks"))


# --- network ------------------------------------------------------------------------------------
def known_mule(tx: DataFrame, owners: DataFrame, flagged: DataFrame) -> DataFrame:
    """tx_id, graph_known_mule_payee: the payee's account or its owner is flagged (n: A:..., C:...)."""
    f = flagged.select("n").distinct()
    named = owners.select("payee", F.concat(F.lit("C:"), F.col("owner").cast("string")).alias("n")).union(owners.select("payee", F.concat(F.lit("A:"), "payee")))
    unowned = f.where("n like 'A:%'").select(F.substring("n", 3, 1000).alias("payee"))
    bad = named.join(f, "n").select("payee").union(unowned).distinct().withColumn("_bad", F.lit(1.0))
    return tx.select("tx_id", "payee").join(bad, "payee", "left").select("tx_id", F.coalesce("_bad", F.lit(0.0)).alias("graph_known_mule_payee"))


def shared_fraud_device(tx: DataFrame, flagged: DataFrame) -> DataFrame:
    """tx_id, shared_fraud_device: a flagged customer other than the payer has used the device before.

    The least and the greatest of the flagged customers so far tell whether there is another.
    """
    f = flagged.where("n like 'C:%'").select(F.substring("n", 3, 1000).alias("_c")).distinct().withColumn("_f", F.lit(True))
    t = tx.withColumn("_c", F.col("cust").cast("string")).join(f, "_c", "left").withColumn("_c", F.when(F.col("_f"), F.col("cust")))
    past = fr.before(["device"])
    lo, hi = F.min("_c").over(past), F.max("_c").over(past)
    hit = (F.coalesce("device", F.lit("")) != "") & ((lo != F.col("cust")) | (hi != F.col("cust")))
    return t.select("tx_id", _flag(hit).alias("shared_fraud_device"))


def has_inflow(tx: DataFrame, owners: DataFrame, window_us: int) -> DataFrame:
    """tx_id, has_inflow: the payer's own accounts got money from others in the closed window before."""
    paid = tx.select("tx_id", "us", "cust", F.lit(0).alias("got"), F.lit(True).alias("pays"))
    got = tx.join(owners, "payee").where("owner <> cust").select("tx_id", "us", F.col("owner").alias("cust"), F.lit(1).alias("got"), F.lit(False).alias("pays"))
    line = fr.sums_before(paid.union(got), ["cust"], {"n": (window_us + 1, F.col("got"))}).where("pays")
    return line.select("tx_id", (F.col("n") > 0).alias("has_inflow"))


def percentile_ranks(ranks: DataFrame, prefix: str = "A:") -> DataFrame:
    """node, percentile among the nodes of one kind: the share whose rank (to 12 digits) is not greater."""
    r = ranks.where(F.col("node").startswith(prefix)).withColumn("_k", F.round("rank", 12))
    g = running_sums(r.groupBy("_k").agg(F.count("*").alias("_n")), [F.col("_k")], {"_upto": F.col("_n")})
    total = r.agg(F.count("*").alias("_all"))
    return r.join(g, "_k").crossJoin(F.broadcast(total)).select("node", (F.col("_upto") / F.col("_all")).alias("percentile"))


def network_signals(tx: DataFrame, owners: DataFrame, flagged: DataFrame, ranks: DataFrame | None = None, window_us: int = 30 * fr.MINUTE, cycle_us: int = fr.DAY) -> DataFrame:
    """tx_id and all parts of the graph score, and the score."""
    parts = gr.pass_through(tx, owners, window_us).select("tx_id", F.col("fan_in").cast("double").alias("graph_fan_in_30m"), F.col("pass_through").alias("graph_pass_through"))
    parts = fr.beside(fr.beside(parts, known_mule(tx, owners, flagged)), shared_fraud_device(tx, flagged))
    parts = fr.beside(parts, gr.cycles(tx, owners, cycle_us).withColumn("graph_cycle", F.lit(1.0)), "left").fillna({"graph_cycle": 0.0})
    parts = fr.beside(parts, gr.fraud_distance(tx, gr.undirected(tx), flagged))
    if ranks is not None:
        central = percentile_ranks(ranks).select(F.substring("node", 3, 1000).alias("payee"), "percentile")
        parts = parts.join(tx.select("tx_id", "payee").join(central, "payee", "left").select("tx_id", F.coalesce("percentile", F.lit(0.0)).alias("payee_centrality")), "tx_id")
    else:
        parts = parts.withColumn("payee_centrality", F.lit(0.0))
    score = gr.graph_score(F.col("graph_known_mule_payee") > 0, F.col("graph_pass_through"), F.col("graph_fan_in_30m"), F.col("graph_cycle") > 0, F.col("shared_fraud_device") > 0, F.col("fraud_distance"), F.col("payee_centrality"))
    return parts.withColumn("graph_score", score)


def affected(tx: DataFrame, owners: DataFrame, labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """cust, community, affected: members that only pay into their community: not flagged, no shared device there, nothing received from inside."""
    c = labels.where("node like 'C:%'").select(F.substring("node", 3, 1000).alias("cust"), "community")
    t = tx.withColumn("cust", F.col("cust").cast("string"))
    own = owners.select("payee", F.col("owner").cast("string").alias("owner"))
    inside = t.join(own, "payee").join(c, "cust").join(c.select(F.col("cust").alias("owner"), F.col("community").alias("_to")), "owner").where("community = _to and cust <> owner")
    received = inside.select(F.col("owner").alias("cust")).distinct().withColumn("_got", F.lit(True))
    used = t.where("device <> ''").select("cust", "device").distinct()
    common = used.groupBy("device").agg(F.count("*").alias("n")).where("n >= 2").select("device")
    shares = used.join(common, "device").select("cust").distinct().withColumn("_shared", F.lit(True))
    bad = flagged.where("n like 'C:%'").select(F.substring("n", 3, 1000).alias("cust")).distinct().withColumn("_bad", F.lit(True))
    j = c.join(received, "cust", "left").join(shares, "cust", "left").join(bad, "cust", "left")
    return j.select("cust", "community", (F.col("_got").isNull() & F.col("_shared").isNull() & F.col("_bad").isNull()).alias("affected"))


def step_graph(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Per node, within its own step: in- and out-degree, weak component size, and rank times the step's nodes."""
    nodes = gr.materialise(nodes, "step-nodes")
    e = gr.materialise(gr.same_step(nodes, edges), "step-edges")
    degrees = gr.step_degrees(nodes, e)
    weak = gr.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    size = weak.join(weak.groupBy("component").agg(F.count("*").alias("component_size")), "component").select("node", "component_size")
    # ranks of all steps at once: no edge crosses steps, so each step's ranks are its own
    out = e.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("o"))
    links = gr.materialise(e.select("src", "dst").distinct().join(out, "src"), "step-links")
    base = nodes.join(nodes.groupBy("step").agg(F.count("*").alias("n")), "step").join(out, nodes["node"] == out["src"], "left").select("node", "step", "n", F.col("o").isNull().alias("dangling"))
    ranks = gr.materialise(base.withColumn("rank", 1.0 / F.col("n")), "step-ranks")
    for _ in range(rounds):
        stale = ranks
        lost = ranks.groupBy("step").agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        got = ranks.join(links, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("o")).alias("got"))
        ranks = gr.materialise(ranks.join(got, F.col("node") == F.col("dst"), "left").join(lost, "step").select("node", "step", "n", "dangling", (0.15 / F.col("n") + 0.85 * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank")), "step-ranks")
        discard(stale)
    j = degrees.join(size, "node", "left").join(ranks.select("node", (F.col("rank") * F.col("n")).alias("scaled_rank")), "node")
    return j.select("node", "step", "in_degree", "out_degree", F.coalesce("component_size", F.lit(1)).alias("component_size"), "scaled_rank")


#: Modularity that a round of moves, and a level, must gain for another to follow.
LEAST_GAIN = 1e-4
#: Links of a partition.
_LINKS = 150_000


def modularity_communities(edges: DataFrame) -> DataFrame:
    """node, community of a weighted undirected graph (a, b, w) by Louvain's method.

    Nodes move to the neighbouring community of largest modularity gain, ties
    to the smaller name, halves of the nodes in turn so that pairs do not swap
    for ever; moves end when modularity grows by less than LEAST_GAIN. Communities
    then become nodes, and the same begins again, until a level gains less than
    that. There is no limit of rounds: modularity grows in each and is below 1.

    Nodes are numbers in the order of their names. Links stay where they are,
    by one end, for all rounds of a level; a round sends each link's label to
    its other end once, which gives both the moves and the modularity of the
    labels that they start from.
    """
    e = edges.select("a", "b", F.col("w").cast("double").alias("w"))
    named = gr.materialise(e.union(e.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "louvain-named")
    twice = named.agg(F.sum("w")).first()[0]
    names = running_sums(named.select(F.col("a").alias("name")).distinct(), [F.col("name")], {"id": F.lit(1)})
    names = gr.materialise(names.select("name", "id", F.pmod(F.xxhash64("name"), F.lit(2)).alias("half")), "louvain-names")
    if not twice:
        return names.select(F.col("name").alias("node"), F.col("name").alias("community"))
    ends = [names.select(F.col("name").alias(c), F.col("id").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    level = gr.materialise(named.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "w"), "louvain-edges")
    discard(named)
    member = names.select(F.col("id").alias("node"), F.col("id").alias("community"))
    while True:
        kept, start, best = _moved_labels(level, names.select("id", "half"), twice)
        if best <= start + LEAST_GAIN:
            break
        short = kept.select(F.col("node").alias("community"), F.col("community").alias("_c"))
        member = gr.materialise(member.join(short, "community").select("node", F.col("_c").alias("community")), "louvain")
        up = level.join(kept.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(kept.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
        up = gr.materialise(up.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "louvain-edges")
        discard(level, kept)
        level = up
    out = member.join(names.select(F.col("id").alias("node"), "name"), "node")
    return out.join(names.select(F.col("id").alias("community"), F.col("name").alias("_c")), "community").select(F.col("name").alias("node"), F.col("_c").alias("community"))


def _moved_labels(level: DataFrame, halves: DataFrame, twice: float) -> tuple[DataFrame, float, float]:
    """The labels (node, community) of largest modularity after all rounds of one level, the modularity that the level starts from, and theirs."""
    loops, n = level.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0)), F.count("*")).first()
    parts = 1 + n // _LINKS
    links = level.where("a <> b").repartition(parts, "b").persist(StorageLevel.MEMORY_AND_DISK)
    degree = level.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    labels = kept = gr.materialise(degree.join(halves.withColumnRenamed("id", "node"), "node").select("node", F.col("node").alias("community"), "k", "half"), "louvain-labels")
    start = best = None
    idle = turn = 0
    while True:
        own = labels.select("node", "community", "k", "half").join(labels.groupBy("community").agg(F.sum("k").alias("tot")), "community")
        told = links.join(own.select(F.col("node").alias("b"), "community", "tot").hint("shuffle_hash"), "b")
        votes = told.repartition(parts, "a").groupBy("a", "community").agg(F.sum("w").alias("inner"), F.first("tot").alias("of"))
        rows = own.withColumnRenamed("community", "old").join(votes, F.col("node") == F.col("a"), "left")
        mine = F.col("community") == F.col("old")
        gain = F.round(F.col("inner") - F.col("k") * (F.col("of") - F.when(mine, F.col("k")).otherwise(0.0)) / twice, 9)
        # the largest gain, and of its communities the smallest
        top = F.max(F.when(F.col("a").isNotNull(), F.struct(gain.alias("gain"), (-F.col("community")).alias("c"))))
        picked = rows.groupBy("node", "old", "k", "half", "tot").agg(top.alias("top"), F.max(F.when(mine, gain)).alias("here"), F.max(F.when(mine, F.col("inner"))).alias("inside"))
        alone = F.round(-F.col("k") * (F.col("tot") - F.col("k")) / twice, 9)
        better = (F.col("top.gain") > F.coalesce("here", alone)) & (F.col("half") == turn % 2)
        moved = gr.materialise(picked.select("node", F.when(better, -F.col("top.c")).otherwise(F.col("old")).alias("community"), "k", "half", "tot", "inside"), "louvain-labels")
        inside, spread = moved.agg(F.coalesce(F.sum("inside"), F.lit(0.0)), F.sum(F.col("k") * F.col("tot"))).first()
        now = (inside + loops) / twice - spread / twice / twice
        if start is None:
            start = best = now
        else:
            idle = 0 if now > best + LEAST_GAIN else idle + 1
            stale = labels
            if now > best:
                kept, stale, best = labels, kept, now
            discard(stale)
            if idle == 2:
                break
        labels, turn = moved, turn + 1
    links.unpersist()
    discard(moved)
    return kept, start, best


# --- learning across banks --------------------------------------------------------------------------
def federated_average(rows: DataFrame, features: Sequence[str], *, bank: str = "bank", label: str = "y", rounds: int = 20, epochs: int = 5, rate: float = 0.5) -> list[float]:
    """Weights (and an intercept, last) of a logistic model that banks fit together: each trains on its own rows, and only weights leave it.

    Every step is one sum over each bank's rows, so no bank's rows are gathered.
    """
    w0 = [0.0] * (len(features) + 1)
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    for _ in range(rounds):
        local: dict = {}
        for _ in range(epochs):
            z = sum((xi * F.lit(w) for xi, w in zip(x, w0, strict=True)), F.lit(0.0))
            if local:
                cases = None
                for b, w in local.items():
                    term = sum((xi * F.lit(c) for xi, c in zip(x, w, strict=True)), F.lit(0.0))
                    cases = F.when(F.col(bank) == b, term) if cases is None else cases.when(F.col(bank) == b, term)
                z = cases
            miss = 1 / (1 + F.exp(-z)) - F.col(label)
            grads = rows.groupBy(bank).agg(F.count("*").alias("n"), *(F.sum(miss * xi).alias(f"g{i}") for i, xi in enumerate(x))).collect()
            sizes = {r[bank]: r["n"] for r in grads}
            local = {r[bank]: [w - rate * r[f"g{i}"] / r["n"] for i, w in enumerate(local.get(r[bank], w0))] for r in grads}
        total = sum(sizes.values())
        w0 = [sum(local[b][i] * sizes[b] for b in sorted(local)) / total for i in range(len(w0))]
    return w0


# --- challenges ------------------------------------------------------------------------------------
def challenges(events: DataFrame, ttl_us: int) -> DataFrame:
    """One-time challenges from events (tx_id, us, kind: issue or consume): each consumption with ``accepted``.

    A challenge is taken once, within ``ttl_us`` of being issued last.
    """
    w = W.partitionBy("tx_id").orderBy("us", "kind").rowsBetween(W.unboundedPreceding, -1)
    issued = F.max(F.when(F.col("kind") == "issue", F.col("us"))).over(w)
    used = F.max(F.when(F.col("kind") == "consume", F.col("us"))).over(w)
    e = events.withColumn("_i", issued).withColumn("_c", used).where("kind = 'consume'")
    fresh = F.col("_i").isNotNull() & (F.col("us") <= F.col("_i") + ttl_us) & (F.col("_c").isNull() | (F.col("_c") < F.col("_i")))
    return e.select("tx_id", "us", F.coalesce(fresh, F.lit(False)).alias("accepted"))

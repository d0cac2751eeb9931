"""The full pass over payments: features, signals, all rules, stacked scores, policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import logit, sigmoid
from ..storage import materialise
from . import features as ft
from . import frames as fr
from . import graph as gr
from . import matching as mt
from . import profile as pf
from . import rules as rl
from . import signals as sg

# The champion's stacker over the logits of rule, model and anomaly scores.
STACKER, INTERCEPT = (0.100977, 1.147558, 0.0), 1.894
PROFILE = ["amount_ratio", "amount_zscore", "first_large_transfer", "is_new_device", "hour_unusual", "channel_unknown", "typing_deviation"]


@dataclass
class Surroundings:
    """What a pass is given beside the payments."""

    customers: DataFrame  # cust, home_country, birth_year, vulnerable, channels, locations
    owners: DataFrame  # payee, owner
    flagged: DataFrame  # n: C:..., A:...
    ranges: DataFrame  # cidr, country, vpn, tor
    registry: DataFrame  # iban, name
    reports: DataFrame  # digest, bank
    keywords: dict[str, float]
    high_risk: Sequence[str] = ()
    salt: str = "salt"
    own_bank: str = "OWN"


def stacked(rule: Column, ml: Column | None, anomaly: Column | None) -> Column:
    """The stacker's score; a payment without a model's score keeps its rule score."""
    if ml is None:
        return rule
    parts = zip(STACKER, (rule, ml, anomaly if anomaly is not None else F.lit(0.0)), strict=True)
    z = sum((logit(x) * w for w, x in parts), F.lit(INTERCEPT))
    return F.when(ml.isNull(), rule).otherwise(sigmoid(z))


#: What the signals and the policy read of a payment itself.
_KEPT = ("tx_id", "us", "cust", "amount", "payee", "purpose", "session", "payee_opened")


def histories(tx: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Payments with what they and their own past tell, every feature and the profile, and the columns ``keep``.

    What looks back by customer stays beside the payment. What looks back by
    another key is made of narrow rows and keyed by tx_id, as the profile is.
    """
    by = ft.by_key()
    own, *others = sorted(by, key=lambda k: k != tuple(ft.CUST))
    out = ft.features(tx, by[own], keep=dict.fromkeys((*_KEPT, *keep)))
    age = sg.payee_account_age(F.to_date(F.timestamp_micros("us")), F.col("payee_opened"))
    out = out.withColumns(ft.session_columns() | {"payee_account_age_d": age}).drop("session", "payee_opened")
    for p in (*(ft.features(tx, by[k]) for k in others), pf.profile_features(tx).select("tx_id", *PROFILE)):
        out = fr.beside(out, p)
    return out


def observed(tx: DataFrame, s: Surroundings, past: DataFrame | None = None) -> DataFrame:
    """Payments with every feature and signal that the rules and the policy read; ``past``: :func:`histories`, where they are made already.

    Each part is made from the payments alone and keyed by tx_id, so the parts
    are joined on one key and dealt out by it once.
    """
    base = histories(tx) if past is None else past
    parts = [
        ft.static_features(tx, s.customers, list(s.high_risk)).drop("channel_not_kyc"),
        sg.location_features(tx, s.customers),
        sg.address_features(tx, s.ranges),
        sg.network_signals(tx, s.owners, s.flagged),
        gr.edge_burst(tx).select("tx_id", "burst"),
        sg.consortium_signal(tx, s.reports, s.salt, s.own_bank).select("tx_id", "consortium_score"),
        mt.confirm_payee(tx.select(F.col("tx_id").alias("q_id"), F.col("payee").alias("iban"), F.col("payee_name").alias("name")), s.registry).select(F.col("q_id").alias("tx_id"), F.col("result").alias("cop")),
    ]
    for p in parts:
        base = fr.beside(base, p)
    base = base.withColumn("purpose_risk", sg.purpose_risk(F.col("purpose"), s.keywords))
    out = sg.scam_signal(base)
    return out.withColumns({"payee_account_age_d": F.coalesce("payee_account_age_d", F.lit(-1.0)), "consortium_hit": F.when(F.col("consortium_score") > 0, 1.0).otherwise(0.0)})


#: What a payment may have beside what all have.
_EXTRA = ("ml_score", "anomaly_score", "online_score", "account_blocked", "unknown_customer", "sanctions_hit")


def full_pass(tx: DataFrame, s: Surroundings, rules: Sequence[rl.Rule] | None = None, policy: rl.Policy = rl.Policy()) -> DataFrame:
    """One decision a payment, with rule hits, scores and signals.

    tx: tx_id, us, cust, amount, channel, device, payee, payee_name,
    payee_opened, location, country, ip, purpose, session, trusted, avg_amount,
    typing; and, if there are any, ml_score, anomaly_score and online_score,
    account_blocked, unknown_customer and sanctions_hit.
    """
    # each part reads the payments: without a table of their own they would be scored again for every one
    tx = materialise(tx, "payments")
    return decided(observed(tx, s, histories(tx, [c for c in _EXTRA if c in tx.columns])), rules, policy)


def decided(x: DataFrame, rules: Sequence[rl.Rule] | None = None, policy: rl.Policy = rl.Policy()) -> DataFrame:
    """The decisions of a pass over payments that are :func:`observed`, with what they have of scores and gates."""
    have = set(x.columns)
    x = rl.evaluate(x, list(rules or rl.core_rules()))
    for gate in ("account_blocked", "unknown_customer", "sanctions_hit"):
        if gate not in have:
            x = x.withColumn(gate, F.lit(False))
    col = lambda c: F.col(c) if c in have else None
    x = x.withColumn("stacked", stacked(F.col("rule_score"), col("ml_score"), col("anomaly_score")))
    signals = {"graph": F.col("graph_score"), "burst": F.col("burst"), "app": F.col("app_score"), "consortium": F.col("consortium_score")}
    if "online_score" in have:
        signals["online"] = F.coalesce("online_score", F.lit(0.0))
    x = x.withColumn("combined", rl.combine(F.col("stacked"), signals, policy))
    x = x.withColumn("cap", rl.typology_cap(F.col("rule_hits"), F.col("app_score"), F.col("graph_pass_through"), F.col("graph_cycle"), F.col("near_threshold_cnt_24h") - 2))
    return rl.decide(x, policy)

"""Queries of the full pass, and of all core rules over made-up features."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions import text as tx
from ..operators import features as ft
from ..operators import rules as rl
from ..operators import scoring as sc
from .features import _EVERY
from .tables import EVENT_TX, event_tx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Keywords of the made-up purposes.
KEYWORDS = {"acil": 0.6, "polis": 0.7, "kripto": 0.5}


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as complete payments: what the table lacks is made from the key."""
    t = event_tx(spark, sf_dir)
    k, kind = F.col("tx_id"), F.col("channel")
    session = F.struct(*(F.when(k % 3 > 0, (k * 7919 % m == 0)).alias(f) for m, f in zip((41, 43, 47, 53, 19), ft.SESSION_FLAGS.values(), strict=True)), F.when(k % 4 > 0, k * 31 % 400).alias("login_to_transfer_s"), F.when(k % 5 > 0, k * 17 % 1500).alias("session_duration_s"))
    purpose = F.when(k % 61 == 0, "acil odeme").when(k % 67 == 0, "polis istedi").when(k % 71 == 0, "kripto").otherwise("kira")
    name = F.when(k % 37 == 0, "Someone Else").otherwise(F.concat(F.lit("Payee Number "), "payee"))
    return t.select("*", F.concat(F.lit("city"), (k % 23).cast("string")).alias("location"), F.when(k % 29 == 0, "NG").otherwise("TR").alias("country"), F.concat(F.lit("10."), (k % 97).cast("string"), F.lit(".1.7")).alias("ip"), purpose.alias("purpose"), session.alias("session"), (kind != "error").alias("trusted"), F.lit(None).cast("double").alias("avg_amount"), (100 + k % 13).cast("double").alias("typing"), name.alias("payee_name"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("payee").cast("int") * 5)).alias("payee_opened"), (k % 101 == 0).alias("unknown_customer"))


def surroundings(spark: SparkSession, sf_dir: str) -> sc.Surroundings:
    """Records of the customers and payees of :func:`payments`."""
    t = event_tx(spark, sf_dir)
    cust = t.select("cust").distinct()
    customers = cust.select("cust", F.lit("TR").alias("home_country"), (F.lit(1940) + F.col("cust") % 60).cast("int").alias("birth_year"), (F.col("cust") % 21 == 0).alias("vulnerable"), F.array(F.lit("view"), F.lit("click")).alias("channels"), F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: F.concat(F.lit("city"), i.cast("string"))).alias("locations"))
    payee = t.select("payee").where("payee <> ''").distinct()
    owners = payee.select("payee", F.col("payee").cast("long").alias("owner"))
    flagged = cust.where("cust % 50 = 3").select(F.concat(F.lit("C:"), F.col("cust").cast("string")).alias("n"))
    ranges = spark.createDataFrame([("10.0.0.0/8", "TR", False, False), ("10.5.0.0/16", "TR", True, False), ("10.9.0.0/16", "DE", False, False)], "cidr string, country string, vpn boolean, tor boolean")
    registry = payee.select(F.col("payee").alias("iban"), F.concat(F.lit("Payee Number "), "payee").alias("name"))
    reports = payee.where("payee like '%9'").select(tx.digest("iban", F.col("payee"), "salt").alias("digest"), F.lit("BANK_A").alias("bank"))
    return sc.Surroundings(customers, owners, flagged, ranges, registry, reports, KEYWORDS, ("NG",))


def f22_full_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature, signal and core rule, stacked and decided (no SQL: profiles and name similarity are folds and functions)."""
    out = sc.full_pass(payments(spark, sf_dir), surroundings(spark, sf_dir))
    hits = F.array_join(F.transform("rule_hits", lambda h: h["id"]), ",")
    return out.select("tx_id", "decision", F.round("risk_score", 4).alias("risk_score"), hits.alias("hits"), F.round("rule_score", 4).alias("rule_score"), "app_score", "graph_score", F.round("burst", 4).alias("burst"), "consortium_score", "case_required")


QUERIES["f22_full_pass"] = f22_full_pass

_NUMBERS = {"amount_ratio": (7, 80, 10.0), "amount_zscore": (11, 60, 10.0), "cnt_1m": (3, 5, 1.0), "cnt_1h": (5, 12, 1.0), "near_threshold_cnt_24h": (13, 5, 1.0), "amount_try": (17, 300, 1.0), "login_to_transfer_s": (19, 90, 1.0), "purpose_risk": (23, 11, 10.0), "typing_deviation": (29, 7, 1.0), "device_customers_7d": (31, 5, 1.0), "payee_fan_in_24h": (37, 6, 1.0), "distinct_payees_24h": (41, 3, 1.0), "graph_pass_through": (43, 11, 10.0), "cop_no_match": (59, 2, 1.0), "is_new_payee": (7, 11, 1.0), "graph_fan_in_30m": (47, 4, 1.0), "payee_account_age_d": (53, 120, 1.0)}
_NAMES = sorted(_EVERY)


def made_up(t: DataFrame) -> DataFrame:
    k = F.col("tx_id")
    return t.select("tx_id", *(((k * _NUMBERS[n][0] % _NUMBERS[n][1]) / _NUMBERS[n][2] if n in _NUMBERS else (k % (i + 3) == 0).cast("double")).cast("double").alias(n) for i, n in enumerate(_NAMES)))


_MADE = "x AS (SELECT tx_id, " + ", ".join((f"((tx_id * {_NUMBERS[n][0]} % {_NUMBERS[n][1]}) / {_NUMBERS[n][2]}::DOUBLE)" if n in _NUMBERS else f"(tx_id % {i + 3} = 0)::INT::DOUBLE") + f" AS {n}" for i, n in enumerate(_NAMES)) + " FROM t)"
_RULES = [(r, dsl.sql(r.when, _NAMES)) for r in rl.core_rules()]
_ORDER = sorted(_RULES, key=lambda rc: -rc[0].score)


def f11_all_core_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 31 core rules over features made from the key, so that each of them fires somewhere."""
    return rl.evaluate(made_up(event_tx(spark, sf_dir)), rl.core_rules()).select("tx_id", F.array_join(F.transform("rule_hits", lambda h: h["id"]), ",").alias("hits"), F.coalesce("rule_hint", F.lit("")).alias("rule_hint"))


QUERIES["f11_all_core_rules"] = f11_all_core_rules
ORACLES["f11_all_core_rules"] = (
    f"WITH {EVENT_TX}, {_MADE} SELECT tx_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{r.id}' END" for r, c in _ORDER)
    + ") AS hits, CASE "
    + " ".join(f"WHEN {c} THEN '{r.action_hint}'" for a in ("BLOCK", "HOLD", "STEP_UP") for r, c in _RULES if r.action_hint == a)
    + " ELSE '' END AS rule_hint FROM x"
)


def f16_reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason texts of all core rules that hold, strongest first, with their numbers put in."""
    return rl.evaluate(made_up(event_tx(spark, sf_dir)), rl.core_rules()).select("tx_id", F.array_join(F.transform("rule_hits", lambda h: h["text"]), " | ").alias("reasons"))


def _text_sql(source: str) -> str:
    parts = []
    for literal, name, spec, _ in string.Formatter().parse(source):
        parts.append("'" + literal.replace("'", "''") + "'")
        if name:
            parts.append(f"replace(printf('%{spec}', {name}), '.', ',')")
    return " || ".join(parts)


QUERIES["f16_reason_texts"] = f16_reason_texts
ORACLES["f16_reason_texts"] = f"WITH {EVENT_TX}, {_MADE} SELECT tx_id, concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {_text_sql(r.reason)} END" for r, c in _ORDER) + ") AS reasons FROM x"

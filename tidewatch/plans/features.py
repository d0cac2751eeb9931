"""Queries of point-in-time features, profiles and rules."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import features as ft
from ..operators import frames as fr
from ..operators import profile as pf
from ..operators import rules as rl
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

S = fr.SECOND
EARLIER = "(b.us < a.us OR (b.us = a.us AND b.tx_id < a.tx_id))"
HOUR_SQL = "((us // 3600000000) % 24)"


def _selected(source, names: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.features(source(spark, sf_dir), names)
    return out.select("tx_id", *(F.round(n, 6).alias(n) for n in names))


def _windowed(aggs: dict[str, str], key: str = "cust", width: int = fr.WEEK) -> str:
    cols = ", ".join(f"round(({sql})::DOUBLE, 6) AS {n}" for n, sql in aggs.items())
    return f"SELECT a.tx_id, {cols} FROM t a LEFT JOIN t b ON b.{key} = a.{key} AND b.us > a.us - {width} AND {EARLIER} GROUP BY ALL"


def _within(sql: str, width: int, extra: str = "TRUE") -> str:
    return f"{sql} FILTER (WHERE b.us > a.us - {width} AND {extra})"


def _add(name: str, source: str, names: list[str], sql: str) -> None:
    for tag, (make, cte) in {"events": (event_tx, EVENT_TX), "orders": (order_tx, ORDER_TX)}.items():
        if source in (tag, "both"):
            key = f"{name}_{tag}"
            QUERIES[key] = partial(_selected, make, names)
            ORACLES[key] = f"WITH {cte} {sql}"


def _rows(cols: dict[str, str]) -> str:
    return "SELECT tx_id, " + ", ".join(f"round(({s})::DOUBLE, 6) AS {n}" for n, s in cols.items()) + " FROM t"


_LAST = "OVER (PARTITION BY cust ORDER BY us, tx_id)"
_add("e01_amounts", "both", ["amount_try", "amount_log", "near_threshold"], _rows({"amount_try": "amount", "amount_log": "ln(1 + amount)", "near_threshold": "(amount >= 45000 AND amount < 50000)::INT"}))
_near = "(a.amount >= 45000 AND a.amount < 50000)::INT"
_add("e07_near_threshold_count", "both", ["near_threshold_cnt_24h"], f"SELECT a.tx_id, (count(b.tx_id) + {_near})::DOUBLE AS near_threshold_cnt_24h FROM t a LEFT JOIN t b ON b.cust = a.cust AND b.us > a.us - {fr.DAY} AND {EARLIER} AND b.amount >= 45000 AND b.amount < 50000 GROUP BY a.tx_id, a.amount")
_counts = {f"cnt_{t}": _within("count(b.tx_id)", w) for t, w in (("1m", fr.MINUTE), ("1h", fr.HOUR), ("24h", fr.DAY), ("7d", fr.WEEK))}
_add("e08_counts", "both", list(_counts), _windowed(_counts))
_sums = {f"sum_{t}": f"coalesce({_within('sum(b.amount)', w)}, 0)" for t, w in (("1m", fr.MINUTE), ("1h", fr.HOUR), ("24h", fr.DAY), ("7d", fr.WEEK))}
_add("e09_sums", "both", list(_sums), _windowed(_sums).replace(", 6)", ", 6)"))
_gap = f"us - lag(us) {_LAST}"
_add("e10_time_since_last", "both", ["time_since_last_s"], _rows({"time_since_last_s": f"CASE WHEN {_gap} < {fr.WEEK} THEN ({_gap}) / 1e6 ELSE 604800 END"}))
_distinct = {f"distinct_payees_{t}": _within("count(DISTINCT b.payee)", w, "b.payee <> ''") for t, w in (("24h", fr.DAY), ("7d", fr.WEEK))}
_add("e11_distinct_payees", "both", list(_distinct), _windowed(_distinct))
_pair = "min(us) OVER (PARTITION BY cust, payee ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_add("e13_payee_relation", "both", ["is_new_payee", "payee_relation_age_d"], _rows({"is_new_payee": f"(payee <> '' AND {_pair} IS NULL)::INT", "payee_relation_age_d": f"CASE WHEN payee <> '' AND {_pair} IS NOT NULL THEN (us - {_pair}) / 86400e6 ELSE -1 END"}))
_add("e15_payee_fan_in", "both", ["payee_fan_in_24h"], f"SELECT a.tx_id, CASE WHEN a.payee = '' THEN 0 ELSE 1 + count(DISTINCT b.cust) FILTER (WHERE b.cust <> a.cust) END::DOUBLE AS payee_fan_in_24h FROM t a LEFT JOIN t b ON b.payee = a.payee AND b.us > a.us - {fr.DAY} AND {EARLIER} GROUP BY a.tx_id, a.payee")
_seen = "min(us) OVER (PARTITION BY payee ORDER BY us, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_add("e16_payee_age", "both", ["payee_age_d"], _rows({"payee_age_d": f"CASE WHEN payee <> '' AND {_seen} IS NOT NULL THEN (us - {_seen}) / 86400e6 ELSE -1 END"}))
_dev = _seen.replace("payee", "device")
_add("e17_device", "both", ["device_missing", "device_age_d"], _rows({"device_missing": "(device = '')::INT", "device_age_d": f"CASE WHEN device = '' THEN -1 WHEN {_dev} IS NULL THEN 0 ELSE (us - {_dev}) / 86400e6 END"}))
_add("e20_device_customers", "both", ["device_customers_7d"], f"SELECT a.tx_id, CASE WHEN a.device = '' THEN 1 ELSE 1 + count(DISTINCT b.cust) FILTER (WHERE b.cust <> a.cust) END::DOUBLE AS device_customers_7d FROM t a LEFT JOIN t b ON b.device = a.device AND b.us > a.us - {fr.WEEK} AND {EARLIER} GROUP BY a.tx_id, a.device")
_add("e26_hour", "both", ["hour", "is_night"], _rows({"hour": HOUR_SQL, "is_night": f"({HOUR_SQL} < 6)::INT"}))
_add("e28_night_ratio", "both", ["night_ratio_7d"], _windowed({"night_ratio_7d": "CASE WHEN count(b.tx_id) > 0 THEN count(b.tx_id) FILTER (WHERE (b.us // 3600000000) % 24 < 6) / count(b.tx_id) ELSE 0 END"}))
_add("e31_channel", "both", ["is_cash_channel", "channel_change"], _rows({"is_cash_channel": "(lower(channel) IN ('atm', 'cash'))::INT", "channel_change": f"coalesce({_gap} < {fr.WEEK} AND channel <> '' AND lag(channel) {_LAST} <> '' AND lag(channel) {_LAST} <> channel, false)::INT"}))


# --- features against customer records -----------------------------------------
HIGH_RISK = ("NATION_3", "NATION_7")


def e24_static_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's nation is the home, the supplier's nation the country of the payment; the birth year is made up from the key."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    home = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("n_name").alias("home_country"), (F.lit(1920) + F.col("c_custkey") % 80).cast("int").alias("birth_year"), (F.col("c_acctbal") < 0).alias("vulnerable"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("channels"))
    payee = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("payee"), F.col("n_name").alias("country"))
    tx = order_tx(spark, sf_dir).join(payee, "payee", "left")
    return ft.static_features(tx, home, list(HIGH_RISK))


QUERIES["e24_static_orders"] = e24_static_orders
ORACLES["e24_static_orders"] = f"""WITH {ORDER_TX}, h AS (
  SELECT c_custkey AS cust, n_name AS home, 1920 + c_custkey % 80 AS born, c_acctbal < 0 AS weak FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT s_suppkey::VARCHAR AS payee, upper(n_name) AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT tx_id, (coalesce(country, '') <> '' AND home IS NOT NULL AND country <> upper(home))::INT::DOUBLE AS is_foreign,
       (coalesce(country, '') IN {HIGH_RISK})::INT::DOUBLE AS is_high_risk_country,
       (coalesce(weak, false) OR coalesce(year(make_timestamp(us)) - born >= 65, false))::INT::DOUBLE AS vulnerable_customer,
       (home IS NULL OR channel NOT IN ('1-URGENT', '2-HIGH'))::INT::DOUBLE AS channel_not_kyc
FROM t LEFT JOIN h USING (cust) LEFT JOIN p USING (payee)"""


def e33_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session struct made from props and type: the number is k, the flags follow from the type."""
    k, kind = F.col("device").cast("int"), F.col("channel")
    names = ["click", "view", "purchase", "error", "signup"]
    session = F.struct(F.when(k % 7 > 0, k).alias("login_to_transfer_s"), F.when(k % 5 > 0, k * 2).alias("session_duration_s"), *(F.when(k % 3 > 0, kind == n).alias(f) for n, f in zip(names, ft.SESSION_FLAGS.values(), strict=True)))
    return ft.session_features(event_tx(spark, sf_dir).withColumn("session", session))


QUERIES["e33_session_events"] = e33_session_events
ORACLES["e33_session_events"] = f"""WITH {EVENT_TX}, s AS (SELECT *, device::INT AS k FROM t)
SELECT tx_id, coalesce(CASE WHEN k % 7 > 0 THEN k END, -1)::DOUBLE AS login_to_transfer_s, coalesce(CASE WHEN k % 5 > 0 THEN k * 2 END, -1)::DOUBLE AS session_duration_s,
  (k % 3 > 0 AND channel = 'click')::INT::DOUBLE AS paste_used, (k % 3 > 0 AND channel = 'view')::INT::DOUBLE AS is_emulator,
  (k % 3 > 0 AND channel = 'purchase')::INT::DOUBLE AS is_rooted, (k % 3 > 0 AND channel = 'error')::INT::DOUBLE AS remote_access,
  (k % 3 > 0 AND channel = 'signup')::INT::DOUBLE AS active_call FROM s"""


# --- profiles ---------------------------------------------------------------------
def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = event_tx(spark, sf_dir).withColumn("trusted", F.col("channel") != "error").withColumn("avg_amount", F.lit(None).cast("double")).withColumn("typing", F.col("device").cast("double"))
    return pf.profile_features(tx)


def h01_profile_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["amount_ratio", "amount_zscore", "first_large_transfer", "log_mean", "log_var", "max_amount", "n"]
    return _profiled(spark, sf_dir).select("tx_id", *(F.round(n, 6).alias(n) for n in names))


QUERIES["h01_profile_fold"] = h01_profile_fold
ORACLES["h01_profile_fold"] = f"""WITH RECURSIVE {EVENT_TX}, o AS (
  SELECT *, row_number() OVER (PARTITION BY cust ORDER BY us, tx_id) AS r FROM t),
f AS (
  SELECT o.cust, o.r, o.tx_id, o.amount, o.channel, 0::DOUBLE AS n, 0::DOUBLE AS m, 0.05::DOUBLE AS v, 0::DOUBLE AS x FROM o WHERE r = 1
  UNION ALL
  SELECT o.cust, o.r, o.tx_id, o.amount, o.channel,
    CASE WHEN f.channel <> 'error' THEN f.n + 1 ELSE f.n END,
    CASE WHEN f.channel <> 'error' THEN f.m + greatest(0.05, 1 / (f.n + 1)) * (ln(1 + f.amount) - f.m) ELSE f.m END,
    CASE WHEN f.channel <> 'error' THEN greatest(0.05, (1 - greatest(0.05, 1 / (f.n + 1))) * (f.v + greatest(0.05, 1 / (f.n + 1)) * (ln(1 + f.amount) - f.m) ** 2)) ELSE f.v END,
    CASE WHEN f.channel <> 'error' THEN greatest(f.x, f.amount) ELSE f.x END
  FROM f JOIN o ON o.cust = f.cust AND o.r = f.r + 1)
SELECT tx_id, round(amount / greatest(1, exp(m) - 1), 6) AS amount_ratio, round((ln(1 + amount) - m) / sqrt(greatest(v, 1e-6)), 6) AS amount_zscore,
       (amount > x * 1.5)::INT::DOUBLE AS first_large_transfer, round(m, 6) AS log_mean, round(v, 6) AS log_var, round(x, 6) AS max_amount, n FROM f"""


def h03_profile_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["is_new_device", "hour_unusual", "channel_unknown", "typing_deviation"]
    return _profiled(spark, sf_dir).select("tx_id", *(F.round(n, 4).alias(n) for n in names))


QUERIES["h03_profile_shares"] = h03_profile_shares


def h08_welford_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, population variance, and the fullest bucket of 0.05."""
    tx = event_tx(spark, sf_dir)
    bucket = tx.groupBy("channel", F.round(F.bround(F.col("amount") / 0.05) * 0.05, 2).alias("bucket")).count()
    top = bucket.groupBy("channel").agg(F.max_by("bucket", F.struct("count", "bucket")).alias("top_bucket"))
    return tx.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("mean"), F.round(F.var_pop("amount"), 4).alias("variance")).join(top, "channel")


QUERIES["h08_welford_histogram"] = h08_welford_histogram
ORACLES["h08_welford_histogram"] = f"""WITH {EVENT_TX}, b AS (SELECT channel, round(round_even(amount / 0.05, 0) * 0.05, 2) AS bucket, count(*) AS c FROM t GROUP BY ALL),
x AS (SELECT channel, bucket AS top_bucket, row_number() OVER (PARTITION BY channel ORDER BY c DESC, bucket DESC) AS r FROM b)
SELECT channel, count(*)::BIGINT AS n, round(avg(amount), 6) AS mean, round(var_pop(amount), 4) AS variance, any_value(top_bucket) AS top_bucket
FROM t JOIN (SELECT * FROM x WHERE r = 1) USING (channel) GROUP BY channel"""


# --- rules --------------------------------------------------------------------------
RULE_FEATURES = ["amount_try", "cnt_1m", "cnt_1h", "cnt_24h", "cnt_7d", "sum_24h", "time_since_last_s", "is_night", "is_new_payee", "near_threshold_cnt_24h", "payee_fan_in_24h", "device_customers_7d", "channel_change", "distinct_payees_24h"]
_FEATURES_SQL = f"""fw AS (SELECT a.tx_id, count(b.tx_id) AS cnt_7d,
    {_within("count(b.tx_id)", fr.MINUTE)} AS cnt_1m, {_within("count(b.tx_id)", fr.HOUR)} AS cnt_1h, {_within("count(b.tx_id)", fr.DAY)} AS cnt_24h,
    coalesce({_within("sum(b.amount)", fr.DAY)}, 0) AS sum_24h, {_within("count(DISTINCT b.payee)", fr.DAY, "b.payee <> ''")} AS distinct_payees_24h
  FROM t a LEFT JOIN t b ON b.cust = a.cust AND b.us > a.us - {fr.WEEK} AND {EARLIER} GROUP BY a.tx_id),
fg AS (SELECT tx_id, amount AS amount_try, CASE WHEN {_gap} < {fr.WEEK} THEN ({_gap}) / 1e6 ELSE 604800 END AS time_since_last_s,
    ({HOUR_SQL} < 6)::INT AS is_night, ({_pair} IS NULL AND payee <> '')::INT AS is_new_payee,
    coalesce({_gap} < {fr.WEEK} AND lag(channel) {_LAST} <> channel, false)::INT AS channel_change FROM t),
fp AS (SELECT a.tx_id, 1 + count(DISTINCT b.cust) FILTER (WHERE b.cust <> a.cust AND b.us > a.us - {fr.DAY}) AS payee_fan_in_24h,
    1 + count(DISTINCT b.cust) FILTER (WHERE b.cust <> a.cust) AS device_customers_7d
  FROM t a LEFT JOIN t b ON b.payee = a.payee AND b.us > a.us - {fr.WEEK} AND {EARLIER} GROUP BY a.tx_id),
x AS (SELECT * FROM fw JOIN fg USING (tx_id) JOIN fp USING (tx_id))"""

#: Rules for the stand-in events, whose features are those above.
EVENT_RULES = [
    rl.Rule("R_BURST", "cnt_1m >= 1 or cnt_1h >= 2", 0.3, "{cnt_1h:.0f} in an hour", "STEP_UP", "medium", ("velocity",)),
    rl.Rule("R_NEW_PAYEE_HIGH", "is_new_payee and amount_try >= 150", 0.45, "{amount_try:.1f} to a new payee", None, "high", ("app",)),
    rl.Rule("R_NIGHT", "is_night and not is_new_payee and 0 <= time_since_last_s < 7200", 0.2, "at night", None, "low", ("time",)),
    rl.Rule("R_FAN_IN", "payee_fan_in_24h >= 4 and device_customers_7d > payee_fan_in_24h", 0.4, "{payee_fan_in_24h:.0f} senders", "HOLD", "high", ("mule", "aml")),
    rl.Rule("R_RATE", "clamp(sum_24h / max(cnt_24h, 1), 0, 400) > 120 and amount_try % 2 >= 1", 0.25, "", None, "medium", ("amount",)),
    rl.Rule("R_LOG", "log1p(amount_try) // 1 in (4, 5) and (channel_change if cnt_7d > 10 else 1)", 0.15, "", None, "low", ("channel",)),
    rl.Rule("R_BIG", "abs(amount_try - 300) <= 100 and cnt_7d / 0 == 0", 0.7, "", "BLOCK", "critical", ("takeover",)),
]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.evaluate(ft.features(event_tx(spark, sf_dir), RULE_FEATURES), EVENT_RULES)


def f01_rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ft.features(event_tx(spark, sf_dir), RULE_FEATURES)
    return x.select("tx_id", *(dsl.condition(r.when, RULE_FEATURES).alias(r.id.lower()) for r in EVENT_RULES))


def f06_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("tx_id", F.array_join(F.transform("rule_hits", lambda h: h["id"]), ",").alias("hits"), "rule_score", "rule_hint")


def f11_core_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core rules over whatever of their features the events have; the others are 0."""
    tx = event_tx(spark, sf_dir)
    x = ft.features(tx)
    names = sorted({n for r in rl.core_rules() for n in dsl.names(r.when, _EVERY)} - set(x.columns))
    x = x.select("*", *(F.lit(0.0).alias(n) for n in names))
    return rl.evaluate(x, rl.core_rules()).select("tx_id", F.array_join(F.transform("rule_hits", lambda h: h["id"]), ",").alias("hits"), "rule_score", "rule_hint")


_EVERY = {w for _, c, *_ in rl.CORE_RULES for w in re.findall(r"[a-z_][a-z_0-9]*", c)} - {"and", "or", "not", "in"}


def f12_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ft.features(event_tx(spark, sf_dir), RULE_FEATURES)
    label = event_tx(spark, sf_dir).select("tx_id", F.when(F.col("tx_id") % 3 > 0, (F.col("channel") == "error").cast("int")).alias("label"))
    rows = x.join(label, "tx_id")
    out = rl.backtests(rows.drop("tx_id"), EVENT_RULES)
    return out.select("rule_id", "evaluated", "alerts", F.round("alert_rate", 6).alias("alert_rate"), "labelled", "true_positives", "positives", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES |= {"f01_rule_conditions": f01_rule_conditions, "f06_rule_scores": f06_rule_scores, "f11_core_rules": f11_core_rules, "f12_backtest": f12_backtest}
_CONDS = [dsl.sql(r.when, RULE_FEATURES) for r in EVENT_RULES]
ORACLES["f01_rule_conditions"] = f"WITH {EVENT_TX}, {_FEATURES_SQL} SELECT tx_id, " + ", ".join(f"{c} AS {r.id.lower()}" for r, c in zip(EVENT_RULES, _CONDS, strict=True)) + " FROM x"
_BY_SCORE = sorted(zip(EVENT_RULES, _CONDS, strict=True), key=lambda rc: -rc[0].score)
_SCORED_SQL = (
    "SELECT x.*, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{r.id}' END" for r, c in _BY_SCORE)
    + ") AS hits, round(1 - "
    + " * ".join(f"(CASE WHEN {c} THEN {1 - r.score!r} ELSE 1.0 END)::DOUBLE" for r, c in _BY_SCORE)
    + ", 6) AS rule_score, CASE "
    + " ".join(f"WHEN {c} THEN '{r.action_hint}'" for a in ("BLOCK", "HOLD", "STEP_UP") for r, c in zip(EVENT_RULES, _CONDS, strict=True) if r.action_hint == a)
    + " END AS rule_hint FROM x"
)
ORACLES["f06_rule_scores"] = f"WITH {EVENT_TX}, {_FEATURES_SQL} SELECT tx_id, hits, rule_score, rule_hint FROM ({_SCORED_SQL})"
_CORE = {"R_VELOCITY_BURST": "cnt_1m >= 3 OR cnt_1h >= 8", "R_STRUCTURING": "FALSE", "R_CARD_TESTING": "cnt_1h >= 5 AND amount_try <= 100", "R_SHARED_DEVICE": "device_customers_7d >= 3", "R_PAYEE_FAN_IN": "payee_fan_in_24h >= 4"}
_CORE_ORDER = sorted((r for r in rl.core_rules() if r.id in _CORE), key=lambda r: -r.score)
ORACLES["f11_core_rules"] = (
    f"WITH {EVENT_TX}, {_FEATURES_SQL} SELECT tx_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {_CORE[r.id]} THEN '{r.id}' END" for r in _CORE_ORDER)
    + ") AS hits, round(1 - "
    + " * ".join(f"(CASE WHEN {_CORE[r.id]} THEN {1 - r.score!r} ELSE 1.0 END)::DOUBLE" for r in _CORE_ORDER)
    + f", 6) AS rule_score, CASE WHEN {_CORE['R_CARD_TESTING']} THEN 'STEP_UP' END AS rule_hint FROM x"
)
ORACLES["f12_backtest"] = f"WITH {EVENT_TX}, {_FEATURES_SQL}, y AS (SELECT x.*, CASE WHEN tx_id % 3 > 0 THEN (channel = 'error')::INT END AS label FROM x JOIN t USING (tx_id)) " + " UNION ALL ".join(
    f"""SELECT '{r.id}' AS rule_id, count(*)::BIGINT AS evaluated, count(*) FILTER (WHERE {c})::BIGINT AS alerts, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS alert_rate,
  count(label)::BIGINT AS labelled, count(*) FILTER (WHERE {c} AND label = 1)::BIGINT AS true_positives, count(*) FILTER (WHERE label = 1)::BIGINT AS positives,
  coalesce(round(count(*) FILTER (WHERE {c} AND label = 1) / nullif(count(*) FILTER (WHERE {c} AND label IS NOT NULL), 0), 6), 0) AS precision,
  coalesce(round(count(*) FILTER (WHERE {c} AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 6), 0) AS recall FROM y"""
    for r, c in list(zip(EVENT_RULES, _CONDS, strict=True))
)


def f22_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule score and burst through signal weights, floors, caps and gates to an action."""
    x = _scored(spark, sf_dir).withColumn("burst", F.least(F.lit(1.0), F.col("cnt_1h") / 3))
    x = x.withColumn("combined", rl.combine(F.col("rule_score"), {"burst": F.col("burst")})).withColumn("amount", F.col("amount_try") * 100)
    x = x.withColumn("cap", rl.typology_cap(F.col("rule_hits"), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0)))
    x = x.withColumn("account_blocked", F.col("tx_id") % 50 == 0).withColumn("unknown_customer", F.col("tx_id") % 50 == 1).withColumn("sanctions_hit", F.col("tx_id") % 50 == 2)
    return rl.decide(x).select("tx_id", "decision", F.round("risk_score", 6).alias("risk_score"), "base_decision", F.array_join("overrides", ",").alias("overrides"), "case_required", F.coalesce("hold_minutes", F.lit(0)).alias("hold_minutes"))


QUERIES["f22_decisions"] = f22_decisions
ORACLES["f22_decisions"] = f"""WITH {EVENT_TX}, {_FEATURES_SQL}, s AS ({_SCORED_SQL}), c AS (
  SELECT *, amount_try * 100 AS amount, tx_id % 50 = 0 AS blocked, tx_id % 50 = 1 AS unknown, tx_id % 50 = 2 AS listed,
    CASE WHEN hits LIKE '%R_BIG%' THEN NULL WHEN hits LIKE '%R_FAN_IN%' THEN 2 END AS cap,
    1 - (1 - rule_score) * (1 - 0.25 * least(1, cnt_1h / 3)) AS combined FROM s),
r AS (SELECT *, CASE WHEN blocked THEN 1 WHEN unknown THEN 0.6 ELSE round(combined, 6) END AS risk FROM c),
b AS (SELECT *, CASE WHEN blocked OR risk >= 0.85 THEN 3 WHEN risk >= 0.6 THEN 2 WHEN risk >= 0.35 THEN 1 ELSE 0 END AS base,
    NOT (blocked OR unknown) AND coalesce(rule_hint = 'HOLD' AND risk < 0.45 AND amount < 25000, false) AS soft FROM r),
f AS (SELECT *, CASE WHEN soft THEN 1 ELSE coalesce(list_position(['ALLOW', 'STEP_UP', 'HOLD', 'BLOCK'], rule_hint) - 1, -1) END AS floor FROM b),
g AS (SELECT *, NOT (blocked OR unknown) AND floor > base AS raised FROM f),
h AS (SELECT *, CASE WHEN raised THEN floor ELSE base END AS k FROM g),
i AS (SELECT *, coalesce(NOT (blocked OR unknown) AND k > cap, false) AS capped FROM h),
j AS (SELECT *, CASE WHEN blocked THEN 3 WHEN unknown THEN 2 ELSE greatest(CASE WHEN capped THEN cap ELSE k END, CASE WHEN listed THEN 2 ELSE 0 END) END AS fin FROM i)
SELECT tx_id, (['ALLOW', 'STEP_UP', 'HOLD', 'BLOCK'])[fin + 1] AS decision, round(risk::DOUBLE, 6) AS risk_score, (['ALLOW', 'STEP_UP', 'HOLD', 'BLOCK'])[base + 1] AS base_decision,
  concat_ws(',', CASE WHEN blocked THEN 'ACCOUNT_BLOCKED' END, CASE WHEN unknown THEN 'UNKNOWN_CUSTOMER' END, CASE WHEN soft THEN 'RULE_FLOOR_SOFTENED' END,
    CASE WHEN raised THEN 'RULE_FLOOR' END, CASE WHEN capped THEN 'TYPOLOGY_CAP' END, CASE WHEN listed THEN 'SANCTIONS_HIT' END) AS overrides,
  NOT blocked AND fin >= 2 AS case_required, (CASE WHEN fin = 2 AND NOT blocked THEN 30 ELSE 0 END)::INT AS hold_minutes FROM j"""


def f18_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    rules = s.select("tx_id", F.explode("rule_hits").alias("h")).select("tx_id", F.col("h.id").alias("code"), F.lit("rule").alias("source"), F.col("h.score").alias("weight"))
    models = s.select("tx_id", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(o).alias("source"), F.round(w, 6).alias("weight")) for c, o, w in _reasons()))).alias("r")).select("tx_id", "r.*")
    return rl.top_reasons(rules.union(models.where("weight > 0")))


def _reasons() -> list:
    return [("ML_A", "ml", F.col("cnt_7d") / 40), ("ML_B", "ml", F.col("is_night") * 0.3), ("ML_C", "ml", F.col("cnt_24h") / 20), ("SANCTIONS", "policy", F.when(F.col("cnt_7d") % 9 == 0, 1.0).otherwise(0.0)), ("BURST", "signal", F.col("cnt_1h") / 3)]


QUERIES["f18_top_reasons"] = f18_top_reasons
ORACLES["f18_top_reasons"] = f"""WITH {EVENT_TX}, {_FEATURES_SQL}, s AS ({_SCORED_SQL}), q AS (
""" + "\n UNION ALL ".join(
    [f"SELECT tx_id, '{r.id}' AS code, 'rule' AS source, {r.score}::DOUBLE AS weight FROM s WHERE list_contains(string_split(hits, ','), '{r.id}')" for r in EVENT_RULES]
    + [f"SELECT tx_id, '{c}', '{o}', round(({w})::DOUBLE, 6) FROM s" for c, o, w in [("ML_A", "ml", "cnt_7d / 40"), ("ML_B", "ml", "is_night * 0.3"), ("ML_C", "ml", "cnt_24h / 20"), ("SANCTIONS", "policy", "CASE WHEN cnt_7d % 9 = 0 THEN 1 ELSE 0 END"), ("BURST", "signal", "cnt_1h / 3")]]
) + """), n AS (SELECT *, row_number() OVER (PARTITION BY tx_id, source ORDER BY weight DESC, code) AS n FROM q WHERE weight > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY CASE WHEN source = 'policy' THEN 0 WHEN n = 1 THEN 1 ELSE 2 END, weight DESC, code) AS place
  FROM n WHERE source NOT IN ('ml', 'signal') OR n <= 2)
SELECT tx_id, place::INT AS place, code, source, weight FROM p WHERE place <= 5"""

"""Stand-ins of the bank's records, made from orders, customers and suppliers: as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import threshold_action
from ..operators import frames as fr
from .tables import ORDER_TX, order_tx, table

QUARTER = 90 * fr.DAY
TAGS = ("mule", "aml", "ato", "app", "card", "time")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each order: risk and challenger from its key, tags of three rules, gates by modulus."""
    t = order_tx(spark, sf_dir)
    k = F.col("tx_id")
    risk = (k * 7919 % 1000) / 1000.0
    hit = lambda i: F.struct(F.concat(F.lit(f"R{i}_"), (k % 3).cast("string")).alias("id"), ((k * (i + 3) % 10) / 10.0).alias("score"), F.array(F.get(F.array(*map(F.lit, TAGS)), ((k + i) % len(TAGS)).cast("int"))).alias("tags"))
    hits = F.filter(F.array(*(hit(i) for i in range(3))), lambda h: h["score"] > 0.15)
    return t.select("*", risk.alias("risk"), ((k * 104729 % 1000) / 1000.0).alias("challenger"), threshold_action(risk).alias("decision"), (risk >= 0.6).alias("case_required"), (k % 97 == 0).alias("sanctions_hit"), (k % 89 == 0).alias("unknown_customer"), ((k * 31 % 400) / 10.0).alias("latency_ms"), hits.alias("rule_hits"))


_HITS = ", ".join(f"{{'id': 'R{i}_' || (tx_id % 3), 'score': (tx_id * {i + 3} % 10) / 10.0::DOUBLE, 'tag': {list(TAGS)!r}[((tx_id + {i}) % {len(TAGS)} + 1)::INT]}}" for i in range(3))
DECISIONS = f"""{ORDER_TX}, dec AS (SELECT *, list_filter([{_HITS}], lambda h: h.score > 0.15) AS rule_hits,
  CASE WHEN risk >= 0.85 THEN 'BLOCK' WHEN risk >= 0.6 THEN 'HOLD' WHEN risk >= 0.35 THEN 'STEP_UP' ELSE 'ALLOW' END AS decision, risk >= 0.6 AS case_required
  FROM (SELECT *, (tx_id * 7919 % 1000) / 1000.0::DOUBLE AS risk, (tx_id * 104729 % 1000) / 1000.0::DOUBLE AS challenger,
    tx_id % 97 = 0 AS sanctions_hit, tx_id % 89 = 0 AS unknown_customer, (tx_id * 31 % 400) / 10.0::DOUBLE AS latency_ms FROM t))"""


def tx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order is labelled: fraud if it failed."""
    t = order_tx(spark, sf_dir).where("tx_id % 5 = 0")
    return t.select("tx_id", (F.col("status") == "F").cast("int").alias("label"), F.when(F.col("tx_id") % 2 == 0, "analyst").otherwise("chargeback").alias("source"), (F.col("us") + fr.DAY).alias("created_us"))


LABELS = f"lab AS (SELECT tx_id, (status = 'F')::INT AS label, CASE WHEN tx_id % 2 = 0 THEN 'analyst' ELSE 'chargeback' END AS source, us + {fr.DAY} AS created_us FROM t WHERE tx_id % 5 = 0)"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each held or blocked order; its case is the customer's quarter."""
    d = decisions(spark, sf_dir).where("case_required")
    return d.select(F.col("tx_id").alias("alert_id"), "tx_id", "us", "cust", "amount", "risk", "decision", (F.col("cust") * 1000 + F.floor(F.col("us") / F.lit(QUARTER)) % 1000).alias("case_id"))


ALERTS = f"al AS (SELECT tx_id AS alert_id, tx_id, us, cust, amount, risk, decision, cust * 1000 + (us // {QUARTER}) % 1000 AS case_id FROM dec WHERE case_required)"
#: Case states, types and analysts, chosen by the case's number.
STATUS, KINDS = ("YENI", "INCELENIYOR", "KAPALI"), ("AML", "MULE", "APP", "ATO")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    c = a.groupBy("case_id", "cust").agg(F.count("*").alias("alert_count"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"), F.min("us").alias("opened_us"), F.max("us").alias("updated_us"))
    k = F.col("case_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    c = c.withColumn("status", pick(STATUS, k)).withColumn("case_type", pick(KINDS, F.floor(k / 3)))
    c = c.withColumn("assigned_to", F.when(k % 4 > 0, F.concat(F.lit("analyst"), (k % 4).cast("string"))))
    closed = F.col("status") == "KAPALI"
    return c.select("case_id", "cust", "alert_count", F.col("total").cast("double").alias("total"), "opened_us", "updated_us", "status", "case_type", "assigned_to", F.when(closed, F.col("updated_us") + 2 * fr.DAY).alias("closed_us"), F.when(closed, F.when(k % 2 == 0, "FRAUD").otherwise("TEMIZ")).alias("outcome"), (F.floor(F.col("total").cast("double") / 10) / 100.0).alias("priority"), F.lit(None).cast("string").alias("ring_id"))


CASES = f"""cs AS (SELECT *, CASE WHEN status = 'KAPALI' THEN updated_us + {2 * fr.DAY} END AS closed_us, CASE WHEN status = 'KAPALI' THEN CASE WHEN case_id % 2 = 0 THEN 'FRAUD' ELSE 'TEMIZ' END END AS outcome, floor(total / 10) / 100.0::DOUBLE AS priority
  FROM (SELECT case_id, cust, count(*)::BIGINT AS alert_count, sum(amount::DECIMAL(18,2))::DOUBLE AS total, min(us) AS opened_us, max(us) AS updated_us,
    {list(STATUS)!r}[(case_id % 3 + 1)::INT] AS status, {list(KINDS)!r}[(case_id // 3 % 4 + 1)::INT] AS case_type, CASE WHEN case_id % 4 > 0 THEN 'analyst' || (case_id % 4) END AS assigned_to
    FROM al GROUP BY case_id, cust))"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    status = F.when(k % 11 == 0, "BLOKE").when(k % 7 == 0, "INCELENIYOR").otherwise("AKTIF")
    return c.select(k.alias("cust"), F.concat(F.lit("TR"), F.lpad(k.cast("string"), 8, "0")).alias("iban"), status.alias("status"), (k % 5).alias("version"), (F.lit(1_700_000_000_000_000) + k * fr.MINUTE).alias("updated_us"))


ACCOUNTS = f"""ac AS (SELECT c_custkey AS cust, 'TR' || lpad(c_custkey::VARCHAR, 8, '0') AS iban, CASE WHEN c_custkey % 11 = 0 THEN 'BLOKE' WHEN c_custkey % 7 = 0 THEN 'INCELENIYOR' ELSE 'AKTIF' END AS status,
  c_custkey % 5 AS version, 1700000000000000 + c_custkey * {fr.MINUTE} AS updated_us FROM customer)"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, and who tries to decide each in which role."""
    k = F.col("s_suppkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("approval_id"), pick(APPROVAL_KINDS, k).alias("kind"), F.concat(F.lit("T"), (k % 17).cast("string")).alias("target_id"), F.concat(F.lit("User"), (k % 3).cast("string")).alias("requested_by"), F.when(k % 6 == 0, "ONAYLANDI").otherwise("BEKLIYOR").alias("status"), F.concat(F.lit("user"), (k % 4).cast("string")).alias("actor"), pick(ROLES, F.floor(k / 2)).alias("role"), (k % 3 > 0).alias("approve"))


APPROVAL_KINDS = ("UNBLOCK", "SIB", "MODEL_PROMOTE", "RULE_CHANGE", "POLICY_THRESHOLDS", "OTHER")
ROLES = ("service", "analist", "kidemli_analist", "admin")
APPROVALS = f"""ap AS (SELECT s_suppkey AS approval_id, {list(APPROVAL_KINDS)!r}[(s_suppkey % 6 + 1)::INT] AS kind, 'T' || (s_suppkey % 17) AS target_id, 'User' || (s_suppkey % 3) AS requested_by,
  CASE WHEN s_suppkey % 6 = 0 THEN 'ONAYLANDI' ELSE 'BEKLIYOR' END AS status, 'user' || (s_suppkey % 4) AS actor, {list(ROLES)!r}[(s_suppkey // 2 % 4 + 1)::INT] AS role, s_suppkey % 3 > 0 AS approve FROM supplier)"""

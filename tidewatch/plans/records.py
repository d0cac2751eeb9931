"""Queries of the bank's records: decisions, labels, alerts, cases, approvals, accounts, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as cs
from ..operators import frames as fr
from ..operators import records as rc
from .tables import ORDER_TX, order_tx, table
from .world import ACCOUNTS, ALERTS, APPROVALS, CASES, DECISIONS, LABELS, accounts, alerts, approvals, cases, decisions, tx_labels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query(f"WITH {ACCOUNTS} SELECT cust, iban, status, c_name AS name, c_mktsegment AS segment FROM ac JOIN customer ON c_custkey = cust")
def d02_accounts_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.accounts_with_customers(accounts(spark, sf_dir), _customers(spark, sf_dir)).select("cust", "iban", "status", "name", "segment").orderBy("cust")


@query(f"WITH {ACCOUNTS} SELECT cust, iban, status, c_name AS name, c_mktsegment AS segment FROM ac JOIN customer ON c_custkey = cust WHERE cust = 77")
def d03_accounts_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.accounts_with_customers(accounts(spark, sf_dir), _customers(spark, sf_dir), 77).select("cust", "iban", "status", "name", "segment")


@query(f"WITH {DECISIONS} SELECT tx_id, amount, decision, risk FROM dec WHERE tx_id = 123")
def d04_stored_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).select("tx_id", "decision", "risk")
    return rc.stored_result(order_tx(spark, sf_dir).select("tx_id", "amount"), d, 123).select("tx_id", "amount", "decision", "risk")


@query(f"WITH {DECISIONS} SELECT t.tx_id, t.us, t.amount, d.decision FROM (SELECT * FROM t WHERE cust = 7 ORDER BY us DESC, tx_id DESC LIMIT 10) t LEFT JOIN (SELECT * FROM dec WHERE decision <> 'ALLOW') d USING (tx_id)")
def d05_recent_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).where("decision <> 'ALLOW'").select("tx_id", "decision")
    return rc.recent(order_tx(spark, sf_dir), d, 7).select("tx_id", "us", "amount", "decision")


@query(f"WITH {ORDER_TX}, {LABELS}, h AS (SELECT payee, device FROM t JOIN lab USING (tx_id) WHERE label = 1) SELECT 'A:' || payee AS n FROM h WHERE payee <> '' UNION SELECT 'D:' || device FROM h WHERE device <> ''")
def d06_confirmed_fraud_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.confirmed_fraud(order_tx(spark, sf_dir), tx_labels(spark, sf_dir))


@query(f"WITH {DECISIONS}, {LABELS} SELECT d.tx_id, risk, coalesce(label, -1) AS label FROM (SELECT * FROM dec ORDER BY us DESC, tx_id DESC LIMIT 500) d LEFT JOIN lab USING (tx_id)")
def d07_backtest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.backtest_source(decisions(spark, sf_dir), tx_labels(spark, sf_dir), 500).select("tx_id", "risk", F.coalesce("label", F.lit(-1)).alias("label"))


@query(f"""WITH {DECISIONS}, {LABELS}, w AS (SELECT * FROM dec WHERE risk BETWEEN 0.4 AND 0.6 AND tx_id NOT IN (SELECT tx_id FROM lab) ORDER BY us DESC, tx_id DESC LIMIT 2000)
SELECT tx_id, risk FROM w ORDER BY abs(risk - 0.5), us DESC, tx_id DESC LIMIT 20""")
def d08_least_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.active_learning(decisions(spark, sf_dir), tx_labels(spark, sf_dir)).select("tx_id", "risk")


@query(f"""WITH {DECISIONS}, {LABELS} SELECT count(*)::BIGINT AS decisions, round(avg(((risk >= 0.35) = (challenger >= 0.35))::INT), 6) AS agreement, round(avg((risk >= 0.6)::INT), 6) AS champion_alert_rate,
  round(avg((challenger >= 0.6)::INT), 6) AS challenger_alert_rate, count(label)::BIGINT AS labelled,
  sum((CASE WHEN risk >= 0.6 AND label = 0 THEN 50 WHEN risk < 0.6 AND label = 1 THEN amount ELSE 0 END)::DECIMAL(18,2))::DOUBLE AS champion_cost,
  sum((CASE WHEN challenger >= 0.6 AND label = 0 THEN 50 WHEN challenger < 0.6 AND label = 1 THEN amount ELSE 0 END)::DECIMAL(18,2))::DOUBLE AS challenger_cost FROM dec LEFT JOIN lab USING (tx_id)""")
def j37_shadow_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rc.shadow_comparison(decisions(spark, sf_dir), tx_labels(spark, sf_dir))
    return out.select("decisions", "labelled", "champion_cost", "challenger_cost", *(F.round(c, 6).alias(c) for c in ("agreement", "champion_alert_rate", "challenger_alert_rate")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).where("tx_id % 3 = 0").select("case_id", "us", F.lit("NOTE").alias("kind"), F.concat(F.lit("analyst"), (F.col("tx_id") % 4).cast("string")).alias("actor"))


def _case_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).where("tx_id % 4 = 0").select("case_id", F.col("tx_id").alias("approval_id"), F.lit("UNBLOCK").alias("kind"), F.lit("BEKLIYOR").alias("status"))


_ONE = f"one AS (SELECT case_id FROM cs ORDER BY alert_count DESC, case_id LIMIT 1)"


def _largest(spark: SparkSession, sf_dir: str) -> int:
    return cases(spark, sf_dir).orderBy(F.desc("alert_count"), "case_id").first()["case_id"]


@query(f"""WITH {DECISIONS}, {ALERTS}, {CASES}, {_ONE} SELECT case_id, status,
  (SELECT string_agg(alert_id || ':' || dec.decision, ',' ORDER BY dec.us, alert_id) FROM al JOIN dec USING (tx_id) WHERE al.case_id = cs.case_id) AS alerts,
  (SELECT coalesce(string_agg('analyst' || (tx_id % 4), ',' ORDER BY us, 'analyst' || (tx_id % 4)), '') FROM al WHERE al.case_id = cs.case_id AND tx_id % 3 = 0) AS events,
  (SELECT count(*) FROM al WHERE al.case_id = cs.case_id AND tx_id % 4 = 0)::INT AS approvals FROM cs WHERE case_id = (SELECT case_id FROM one)""")
def d11_case_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case with most alerts as a document, here flattened to text."""
    doc = rc.case_document(cases(spark, sf_dir), alerts(spark, sf_dir), decisions(spark, sf_dir), _events(spark, sf_dir), _case_approvals(spark, sf_dir), _largest(spark, sf_dir))
    return doc.select("case_id", "status", F.array_join(F.transform("alerts", lambda a: F.concat_ws(":", a["alert_id"], a["decision"])), ",").alias("alerts"), F.array_join(F.transform("events", lambda e: e["actor"]), ",").alias("events"), F.size("approvals").alias("approvals"))


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES}, {_ONE} SELECT case_id, closed_us FROM cs WHERE outcome = 'FRAUD' AND case_id <> (SELECT case_id FROM one) AND case_type = (SELECT case_type FROM cs WHERE case_id = (SELECT case_id FROM one)) ORDER BY closed_us DESC, case_id LIMIT 3")
def d22_similar_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.similar_closed(cases(spark, sf_dir), _largest(spark, sf_dir)).select("case_id", "closed_us")


# --- alerts -----------------------------------------------------------------------------------
_TAGS = ["mule", "aml", "ato", "app"]
_STRENGTH = ", ".join(f"list_max(list_transform(list_filter(rule_hits, lambda h: h.tag = '{t}'), lambda h: h.score)) AS s_{t}" for t in [*_TAGS, "card"])


@query(f"""WITH {DECISIONS}, s AS (SELECT *, {_STRENGTH} FROM dec), m AS (SELECT *, greatest(coalesce(s_mule, -1), coalesce(s_aml, -1), coalesce(s_ato, -1), coalesce(s_app, -1)) AS top FROM s)
SELECT tx_id, CASE WHEN sanctions_hit THEN 'YAPTIRIM' WHEN unknown_customer THEN 'BILINMEYEN_MUSTERI' WHEN s_card IS NOT NULL THEN 'CARD_TESTING' WHEN top < 0 THEN 'DAVRANIS'
  WHEN s_mule = top THEN 'MULE' WHEN s_aml = top THEN 'AML' WHEN s_ato = top THEN 'ATO' ELSE 'APP' END AS alert_type,
  CASE WHEN sanctions_hit OR decision = 'BLOCK' THEN 'critical' WHEN decision = 'HOLD' THEN 'high' ELSE 'medium' END AS severity FROM m""")
def k02_alert_type_and_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.select("tx_id", rc.alert_type(F.col("rule_hits"), F.col("sanctions_hit"), F.col("unknown_customer")).alias("alert_type"), rc.severity(F.col("decision"), F.col("sanctions_hit")).alias("severity"))


@query(f"WITH {DECISIONS} SELECT tx_id, decision IN ('HOLD', 'BLOCK') AND tx_id % 10 > 0 AS needs_alert, decision IN ('HOLD', 'BLOCK') AS needs_outbox FROM dec")
def k01_needs_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.select("tx_id", cs.needs_alert(F.col("decision"), F.col("case_required"), F.col("tx_id") % 10 == 0).alias("needs_alert"), rc.needs_outbox(F.col("decision"), F.col("case_required")).alias("needs_outbox"))


@query(f"WITH {DECISIONS}, {ALERTS} SELECT alert_id, us, case_id FROM al ORDER BY us DESC, alert_id DESC LIMIT 100")
def k11_newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.newest(alerts(spark, sf_dir), "us", "alert_id", 100).select("alert_id", "us", "case_id")


# --- cases ------------------------------------------------------------------------------------
@query(f"WITH {DECISIONS}, {ALERTS}, {CASES} SELECT case_id, priority FROM cs WHERE status = 'YENI' AND total >= 100000 ORDER BY priority DESC, updated_us DESC, case_id LIMIT 50")
def k06_pressing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.case_list(cases(spark, sf_dir), status="YENI", least_total=100_000).select("case_id", "priority")


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES} SELECT count(*)::BIGINT AS n FROM cs WHERE status = 'INCELENIYOR' AND case_type = 'MULE' AND assigned_to = 'analyst1'")
def k07_case_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.filtered_cases(cases(spark, sf_dir), status="INCELENIYOR", case_type="MULE", assigned_to="analyst1").agg(F.count("*").alias("n"))


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES} SELECT status, count(*)::BIGINT AS n FROM cs GROUP BY status")
def k08_cases_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.by_status(cases(spark, sf_dir))


NOW = 900_000_000_000_000


@query(f"""WITH {DECISIONS}, {ALERTS}, {CASES} SELECT case_id, status, case_type, alert_count, total, opened_us + {4 * fr.HOUR} AS sla_due_us,
  status = 'YENI' AND opened_us + {4 * fr.HOUR} < {NOW} AND assigned_to IS NULL AS sla_breached, floor((opened_us + {4 * fr.HOUR} - {NOW}) / 1e6)::BIGINT AS sla_remaining_s FROM cs""")
def k10_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.case_summary(cases(spark, sf_dir), NOW)


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES} SELECT case_id, (SELECT count(DISTINCT tx_id) FROM al WHERE al.case_id = cs.case_id AND tx_id % 7 > 0)::BIGINT AS alert_count, coalesce((SELECT sum(amount::DECIMAL(18,2)) FROM al WHERE al.case_id = cs.case_id AND tx_id % 7 > 0)::DOUBLE, 0) AS total FROM cs")
def k23_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir).where("tx_id % 7 > 0")
    return rc.recounted(cases(spark, sf_dir), a.union(a.where("tx_id % 2 = 0"))).select("case_id", "alert_count", "total")


@query(f"""WITH {DECISIONS}, {ALERTS}, {CASES}, a AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE tx_id % 3 = 0) AS no FROM al WHERE tx_id % 5 = 0 GROUP BY case_id)
SELECT case_id, round((priority + 1) * 2 ** coalesce(no, 0) - 1, 2) AS priority, CASE WHEN coalesce(no, 0) > 0 AND status = 'YENI' THEN 'INCELENIYOR' ELSE status END AS status, coalesce(n, 0)::BIGINT AS events FROM cs LEFT JOIN a USING (case_id)""")
def k24_customer_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    answers = a.where("tx_id % 5 = 0").select("tx_id", (F.col("tx_id") % 3 > 0).alias("knows_payee"))
    return rc.customer_confirmation(cases(spark, sf_dir), a, answers).select("case_id", "priority", "status", F.col("events").cast("long").alias("events"))


@query(f"WITH {DECISIONS}, {ALERTS} SELECT kind, count(*)::BIGINT AS n, min(event_id) AS first FROM (SELECT tx_id AS event_id, 'NOTE' AS kind FROM al WHERE tx_id % 3 = 0 UNION ALL SELECT tx_id, 'EVIDENCE' FROM al WHERE tx_id % 2 = 0 AND tx_id % 3 <> 0) GROUP BY kind")
def k25_case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    notes, evidence = (a.where(f"tx_id % {m} = 0").select(F.col("tx_id").alias("event_id"), F.lit(k).alias("kind")) for m, k in ((3, "NOTE"), (2, "EVIDENCE")))
    return rc.append_events(notes, evidence).groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES}, r AS (SELECT cust, min('RING-' || (cust % 13)) AS ring FROM cs WHERE cust % 4 = 0 GROUP BY cust) SELECT case_id, CASE WHEN status <> 'KAPALI' THEN ring END AS ring_id FROM cs LEFT JOIN r USING (cust)")
def q04_back_filled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    rings = c.where("cust % 4 = 0").groupBy(F.concat(F.lit("RING-"), (F.col("cust") % 13).cast("string")).alias("ring_id")).agg(F.collect_set("cust").alias("members"))
    return rc.back_filled_rings(c, rings).select("case_id", "ring_id")


@query(f"WITH {DECISIONS}, {ALERTS}, {CASES} SELECT case_id, role IS NULL OR (role IN ('kidemli_analist', 'admin') AND assigned_to IS NOT NULL AND assigned_to <> actor) AS trusted FROM (SELECT *, CASE case_id % 4 WHEN 0 THEN 'analist' WHEN 1 THEN 'kidemli_analist' WHEN 2 THEN 'admin' END AS role, 'analyst' || (case_id % 3) AS actor FROM cs)")
def q29_clean_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id")
    role = F.when(k % 4 == 0, "analist").when(k % 4 == 1, "kidemli_analist").when(k % 4 == 2, "admin")
    return cases(spark, sf_dir).select("case_id", rc.clean_is_trusted(F.col("assigned_to"), F.concat(F.lit("analyst"), (k % 3).cast("string")), role).alias("trusted"))


# --- approvals --------------------------------------------------------------------------------
@query(f"""WITH {APPROVALS}, l AS (SELECT *, list_position(['service', 'analist', 'kidemli_analist', 'admin'], role) - 1 AS mine, CASE WHEN kind IN ('UNBLOCK', 'SIB', 'RULE_CHANGE') THEN 2 ELSE 3 END AS least FROM ap)
SELECT approval_id, CASE WHEN status <> 'BEKLIYOR' THEN 'closed' WHEN lower(requested_by) = lower(actor) THEN 'same_person' WHEN mine < least THEN 'role' WHEN approve THEN 'ONAYLANDI' ELSE 'REDDEDILDI' END AS outcome FROM l""")
def k14_maker_checker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.decided_approvals(approvals(spark, sf_dir)).select("approval_id", "outcome")


@query(f"WITH {APPROVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, target_id ORDER BY approval_id) AS r FROM ap WHERE status = 'BEKLIYOR') SELECT approval_id, kind, target_id FROM r WHERE r = 1 ORDER BY approval_id DESC")
def k15_pending_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.pending_requests(approvals(spark, sf_dir)).select("approval_id", "kind", "target_id").orderBy(F.desc("approval_id"))


# --- outbox, audit ------------------------------------------------------------------------------
_OUTBOX = "ob AS (SELECT tx_id, us AS created_us, tx_id % 6 AS attempts FROM dec WHERE case_required)"


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where(rc.needs_outbox(F.col("decision"), F.col("case_required"))).select("tx_id", F.col("us").alias("created_us"), (F.col("tx_id") % 6).alias("attempts"))


@query(f"WITH {DECISIONS}, {_OUTBOX} SELECT tx_id, created_us, attempts + 1 AS attempts, CASE WHEN tx_id % 3 > 0 THEN 'settled' WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'retry' END AS fate FROM ob WHERE created_us <= {NOW}")
def k16_outbox_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.outbox_replay(_outbox(spark, sf_dir), alerts(spark, sf_dir).where("tx_id % 3 > 0"), NOW)


@query(f"WITH {DECISIONS}, {_OUTBOX} SELECT tx_id FROM ob WHERE NOT (created_us <= {NOW} AND tx_id % 3 > 0)")
def b05_outbox_without_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.without_settled(_outbox(spark, sf_dir), k16_outbox_replay(spark, sf_dir).where("fate = 'settled'")).select("tx_id")


@query("WITH a AS (SELECT event_id AS id, event_type AS chain, epoch_us(ts) AS us, sha256(event_id::VARCHAR) AS hash FROM events) SELECT id, chain FROM a ORDER BY us DESC, id DESC LIMIT 100")
def k17_audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rc.newest(e, "us", "id", 100).select("id", "chain")


@query("SELECT event_type AS chain, sha256(max(event_id)::VARCHAR) AS head FROM events GROUP BY event_type")
def q06_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("chain")).agg(F.max_by(F.sha2(F.col("event_id").cast("string"), 256), "event_id").alias("head"))


# --- accounts -----------------------------------------------------------------------------------
@query(f"WITH {ACCOUNTS} SELECT cust, status, version, updated_us FROM ac WHERE updated_us >= {1_700_000_000_000_000 + 100 * fr.MINUTE - 5 * fr.SECOND}")
def k18_changed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.changed_since(accounts(spark, sf_dir), 1_700_000_000_000_000 + 100 * fr.MINUTE)


@query(f"WITH {ACCOUNTS} SELECT status, count(*)::BIGINT AS n FROM ac GROUP BY status")
def k19_accounts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.by_status(accounts(spark, sf_dir))


@query(f"WITH {ACCOUNTS} SELECT cust, status, version, updated_us FROM ac")
def q02_account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).select("cust", "status", "version", "updated_us")


@query(f"""WITH {ACCOUNTS}, r AS (SELECT o_custkey AS cust, min(o_orderkey) AS request_id FROM orders GROUP BY 1), q AS (SELECT ac.*, request_id, CASE WHEN request_id % 2 = 0 THEN version ELSE version + 1 END AS expected, CASE request_id % 3 WHEN 0 THEN 'AKTIF' WHEN 1 THEN 'INCELENIYOR' ELSE 'BLOKE' END AS requested FROM ac JOIN r USING (cust)),
o AS (SELECT *, CASE WHEN expected <> version THEN 'conflict' WHEN requested = status THEN 'unchanged' ELSE 'changed' END AS outcome FROM q)
SELECT cust, request_id, outcome, CASE WHEN outcome = 'changed' THEN requested ELSE status END AS status, version + (outcome = 'changed')::INT AS version FROM o""")
def h13_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("request_id")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("request_id"))
    r = r.join(accounts(spark, sf_dir).select("cust", F.col("version").alias("v")), "cust").select("cust", "request_id", F.when(k % 2 == 0, F.col("v")).otherwise(F.col("v") + 1).alias("expected_version"), F.when(k % 3 == 0, "AKTIF").when(k % 3 == 1, "INCELENIYOR").otherwise("BLOKE").alias("requested"))
    return rc.transition(accounts(spark, sf_dir), r)


_CONFIG = "cfg AS (SELECT 'key' || (p_partkey % 9) AS key, p_name AS value, p_partkey AS version FROM part)"


@query(f"WITH {_CONFIG} SELECT key, arg_max(value, version) AS value, max(version) AS version FROM cfg GROUP BY key")
def k20_latest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return rc.latest_config(table(spark, sf_dir, "part").select(F.concat(F.lit("key"), (k % 9).cast("string")).alias("key"), F.col("p_name").alias("value"), k.alias("version")))


# --- decisions as events ------------------------------------------------------------------------
@query(f"""WITH {DECISIONS} SELECT tx_id, cust, us, amount, risk AS risk_score, decision, CASE decision WHEN 'ALLOW' THEN 'approve' WHEN 'BLOCK' THEN 'block' ELSE 'review' END AS decision_legacy,
  array_to_string(list_transform(rule_hits, lambda h: h.id), ',') AS rules, sanctions_hit, sanctions_hit OR unknown_customer AS force_review, case_required, (CASE WHEN decision = 'HOLD' THEN 30 ELSE 0 END)::INT AS hold_minutes, latency_ms FROM dec""")
def q13_event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.event_projection(decisions(spark, sf_dir)).fillna({"hold_minutes": 0})


_CONTRIB = "c AS (SELECT tx_id, 'f' || i AS feature, ((tx_id * (i + 11) * 7919) % 2001 - 1000) / 1000.0::DOUBLE AS value FROM t, range(14) r(i))"


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen made-up contributions an order."""
    t = order_tx(spark, sf_dir).select("tx_id", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    return t.select("tx_id", F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), (((F.col("tx_id") * (F.col("i") + 11) * 7919) % 2001 - 1000) / 1000.0).alias("value"))


@query(f"WITH {ORDER_TX}, {_CONTRIB}, r AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY abs(value) DESC, feature) AS r FROM c) SELECT tx_id, string_agg(feature, ',' ORDER BY r) AS features, round(sum(value), 5) AS total FROM r WHERE r <= 10 GROUP BY tx_id")
def q11_top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rc.top_contributions(contributions(spark, sf_dir))
    total = F.aggregate("explanation", F.lit(0.0), lambda a, x: a + x["value"])
    return out.select("tx_id", F.array_join(F.transform("explanation", lambda x: x["feature"]), ",").alias("features"), F.round(total, 5).alias("total"))


@query(f"WITH {DECISIONS} SELECT tx_id, (3 + (tx_id % 2 = 0)::INT)::INT AS n, risk AS rule, CASE WHEN tx_id % 2 = 0 THEN challenger END AS ml FROM dec")
def q12_components_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    m = rc.components_map({"rule": F.col("risk"), "ml": F.when(F.col("tx_id") % 2 == 0, F.col("challenger")), "stacked": F.col("risk") / 2, "graph": F.lit(0.0)})
    return d.select("tx_id", m.alias("m")).select("tx_id", F.size("m").alias("n"), F.element_at("m", "rule").alias("rule"), F.try_element_at("m", F.lit("ml")).alias("ml"))


@query(f"WITH {DECISIONS}, h AS (SELECT payee, device FROM dec WHERE decision = 'BLOCK') SELECT 'A:' || payee AS n FROM h WHERE payee <> '' UNION SELECT 'D:' || device FROM h WHERE device <> ''")
def q05_block_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.block_feedback(decisions(spark, sf_dir))


@query(f"WITH {DECISIONS}, {LABELS} SELECT tx_id, coalesce((CASE WHEN source = 'analyst' THEN label END), (risk > 0.9)::INT) AS label FROM dec LEFT JOIN lab USING (tx_id)")
def q25_override_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(spark, sf_dir).select("tx_id", (F.col("risk") > 0.9).cast("int").alias("label"))
    return rc.override_labels(rows, tx_labels(spark, sf_dir)).select("tx_id", "label")


@query(f"WITH {ORDER_TX}, {LABELS} SELECT count(*)::BIGINT AS fresh, count(*) >= 50 AS due FROM lab WHERE source = 'analyst' AND created_us > {NOW}")
def h19_retrain_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.retrain_due(tx_labels(spark, sf_dir), NOW)


_ARRIVALS = """ar AS (SELECT o_orderkey AS tx_id, epoch_us(o_orderdate) AS us, 0 AS arrival, sha256(o_orderstatus) AS digest FROM orders
  UNION ALL SELECT o_orderkey, epoch_us(o_orderdate), 1, CASE WHEN o_orderkey % 4 = 0 THEN sha256('other') ELSE sha256(o_orderstatus) END FROM orders WHERE o_orderkey % 2 = 0)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.sha2("o_orderstatus", 256).alias("digest"))
    again = o.where("tx_id % 2 = 0").select("tx_id", "us", F.lit(1).alias("arrival"), F.when(F.col("tx_id") % 4 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest")).alias("digest"))
    return o.select("tx_id", "us", F.lit(0).alias("arrival"), "digest").union(again)


@query(f"WITH {_ARRIVALS} SELECT a.tx_id, a.arrival, CASE WHEN a.arrival = 0 THEN 'first' WHEN a.digest = f.digest THEN 'duplicate' ELSE 'conflict' END AS fate FROM ar a JOIN ar f ON f.tx_id = a.tx_id AND f.arrival = 0")
def h17_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.idempotent(_arrivals(spark, sf_dir)).select("tx_id", "arrival", "fate")


# --- rules ----------------------------------------------------------------------------------------
_RULE_ROWS = "h AS (SELECT 'R' || (p_partkey % 40) AS rule_id, 1 AS version, min(p_name) AS definition, 'seed' AS actor FROM part WHERE p_partkey % 40 < 30 GROUP BY 1), s AS (SELECT p_partkey AS save_id, 'R' || (p_partkey % 40) AS rule_id, p_brand AS definition, 'analyst' AS actor FROM part WHERE p_partkey % 3 = 0)"


@query(f"WITH {_RULE_ROWS} SELECT * FROM h UNION ALL SELECT rule_id, coalesce((SELECT max(version) FROM h WHERE h.rule_id = s.rule_id), 0) + row_number() OVER (PARTITION BY rule_id ORDER BY save_id) AS version, definition, actor FROM s")
def f14_rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("rule_id", F.concat(F.lit("R"), (F.col("p_partkey") % 40).cast("string")))
    history = p.where("p_partkey % 40 < 30").groupBy("rule_id").agg(F.lit(1).cast("long").alias("version"), F.min("p_name").alias("definition"), F.lit("seed").alias("actor"))
    saved = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("save_id"), "rule_id", F.col("p_brand").alias("definition"), F.lit("analyst").alias("actor"))
    return rc.rule_versions(history, saved)


@query(f"WITH {_RULE_ROWS}, v AS (SELECT * FROM h UNION ALL SELECT rule_id, coalesce((SELECT max(version) FROM h WHERE h.rule_id = s.rule_id), 0) + row_number() OVER (PARTITION BY rule_id ORDER BY save_id), definition, actor FROM s) SELECT version, definition, actor FROM v WHERE rule_id = 'R6' ORDER BY version DESC")
def f15_rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f14_rule_versions(spark, sf_dir).where("rule_id = 'R6'").select("version", "definition", "actor").orderBy(F.desc("version"))


# --- older scores -----------------------------------------------------------------------------------
@query(f"WITH {DECISIONS} SELECT tx_id, CASE WHEN tx_id % 50 = 0 THEN 'BLOCK' WHEN sanctions_hit AND decision IN ('ALLOW', 'STEP_UP') THEN 'HOLD' ELSE decision END AS decision FROM dec")
def f23_decide_from_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.select("tx_id", rc.decide_from_risk(F.col("risk"), F.col("sanctions_hit"), F.col("tx_id") % 50 == 0).alias("decision"))


def _factors() -> dict:
    k = F.col("tx_id")
    return {"amount": rc.amount_factor(F.col("amount"), F.lit(40_000.0)), "device": (k % 3 == 0).cast("double"), "location": (k % 5 == 0).cast("double"), "time": F.when(k % 4 == 0, rc.OFF_HOURS).otherwise(0.0), "velocity": F.least(F.lit(1.0), (k % 14) / float(rc.HIGH_VELOCITY)), "country": (k % 31 == 0).cast("double"), "purpose": (k % 9) / 10.0, "ip": F.when(k % 17 == 0, 0.8).otherwise(0.0)}


_FACTORS = """f AS (SELECT tx_id, greatest(0, least(1, (amount / 40000 - 1) / 9)) AS amount, (tx_id % 3 = 0)::INT AS device, (tx_id % 5 = 0)::INT AS location, CASE WHEN tx_id % 4 = 0 THEN 0.7 ELSE 0 END::DOUBLE AS time,
  least(1, (tx_id % 14) / 10)::DOUBLE AS velocity, (tx_id % 31 = 0)::INT AS country, (tx_id % 9) / 10.0::DOUBLE AS purpose, CASE WHEN tx_id % 17 = 0 THEN 0.8 ELSE 0 END::DOUBLE AS ip FROM t)"""


@query(f"WITH {ORDER_TX}, {_FACTORS} SELECT tx_id, round(least(1, 0.32 * amount + 0.22 * device + 0.16 * location + 0.08 * time + 0.06 * velocity + 0.07 * country + 0.05 * purpose + 0.02 * ip)::DOUBLE, 6) AS risk FROM f")
def f26_weighted_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tx(spark, sf_dir).select("tx_id", F.round(rc.weighted_risk(_factors()), 6).alias("risk"))


_UNION = " UNION ALL ".join(f"SELECT tx_id, {n}::DOUBLE AS v, {i} AS i, '{rc.RISK_LABELS[n]}' AS label FROM f" for i, n in enumerate(rc.RISK_LABELS) if n != "channel")


@query(f"WITH {ORDER_TX}, {_FACTORS}, u AS ({_UNION}) SELECT t.tx_id, coalesce(string_agg(label, '; ' ORDER BY v DESC, i), '') AS labels FROM t LEFT JOIN (SELECT * FROM u WHERE v > 0) USING (tx_id) GROUP BY t.tx_id")
def f27_explained_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tx(spark, sf_dir).select("tx_id", F.array_join(rc.explained_factors(_factors()), "; ").alias("labels"))


@query(f"""WITH {DECISIONS} SELECT tx_id, CASE WHEN tx_id % 50 = 0 THEN 'account blocked: rejected without a score' ELSE decision || ' (risk ' || printf('%.2f', round(risk::DECIMAL(6,3), 2)) || ')' ||
  coalesce(': ' || nullif(concat_ws('; ', CASE WHEN sanctions_hit THEN 'sanctions or PEP match' END, CASE WHEN unknown_customer THEN 'unknown customer' END, rule_hits[1].id, rule_hits[2].id), ''), '') END AS reason FROM dec""")
def f25_decision_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    texts = F.transform("rule_hits", lambda h: h["id"])
    return d.select("tx_id", rc.decision_reason(F.col("decision"), F.col("risk"), F.col("tx_id") % 50 == 0, F.col("sanctions_hit"), F.col("unknown_customer"), texts).alias("reason"))


# --- figures ----------------------------------------------------------------------------------------
@query(f"WITH {DECISIONS} SELECT count(*) FILTER (WHERE latency_ms <= 5)::BIGINT AS le_5, count(*) FILTER (WHERE latency_ms <= 10)::BIGINT AS le_10, count(*) FILTER (WHERE latency_ms <= 25)::BIGINT AS le_25, count(latency_ms)::BIGINT AS count, sum(latency_ms::DECIMAL(18,3))::DOUBLE AS sum FROM dec")
def k27_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.histogram_metric(decisions(spark, sf_dir), "latency_ms", [5, 10, 25])


@query(f"WITH {DECISIONS}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM dec) " + "SELECT " + ", ".join(f"max(latency_ms) FILTER (WHERE i = least(n - 1, floor(n * {q})::BIGINT)) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM r")
def n15_live_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.latency_percentiles(decisions(spark, sf_dir), "latency_ms")


@query(f"WITH {DECISIONS} SELECT decision AS id, count(*)::BIGINT AS n FROM (SELECT * FROM dec ORDER BY us DESC, tx_id DESC LIMIT 2000) GROUP BY decision")
def b12_live_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the live view's ring of 2,000 events holds."""
    return rc.newest(decisions(spark, sf_dir), "us", "tx_id", 2000).groupBy(F.col("decision").alias("id")).agg(F.count("*").alias("n"))


_REQUEST = "rq AS (SELECT o_orderkey AS tx_id, repeat('x', (o_orderkey % 70)::INT) AS transaction_id, o_totalprice * CASE WHEN o_orderkey % 10 = 0 THEN -1 WHEN o_orderkey % 11 = 0 THEN 1000000 ELSE 1 END AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'try' WHEN 1 THEN 'EURO' WHEN 2 THEN 'US' ELSE 'T1' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN 'tr' WHEN 1 THEN '' ELSE 'TUR' END AS country, repeat('a', (o_orderkey % 200)::INT) AS purpose FROM orders)"


@query(f"""WITH {_REQUEST} SELECT tx_id, concat_ws(',', CASE WHEN length(transaction_id) NOT BETWEEN 1 AND 64 THEN 'transaction_id' END, CASE WHEN NOT (amount > 0 AND amount <= 1e8) THEN 'amount' END,
  CASE WHEN NOT regexp_full_match(upper(currency), '[A-Z]{{2,3}}') THEN 'currency' END, CASE WHEN NOT regexp_full_match(upper(country), '([A-Z]{{2}})?') THEN 'country' END, CASE WHEN length(purpose) > 160 THEN 'purpose' END) AS problems FROM rq""")
def c03_request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import normalize as nz

    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(k.alias("tx_id"), F.repeat(F.lit("x"), (k % 70).cast("int")).alias("transaction_id"), F.col("o_custkey").cast("string").alias("customer_id"), (F.col("o_totalprice") * F.when(k % 10 == 0, -1).when(k % 11 == 0, 1_000_000).otherwise(1)).alias("amount"), F.when(k % 4 == 0, "try").when(k % 4 == 1, "EURO").when(k % 4 == 2, "US").otherwise("T1").alias("currency"), F.when(k % 3 == 0, "tr").when(k % 3 == 1, "").otherwise("TUR").alias("country"), F.repeat(F.lit("a"), (k % 200).cast("int")).alias("purpose"))
    return nz.problems(t, nz.request_checks()).select("tx_id", F.array_join("problems", ",").alias("problems"))

"""Queries of metrics, cases, audit and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as cs
from ..operators import frames as fr
from ..operators import metrics as mx
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored rows: y is toxic, s has ties, the amount is the length."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return l.join(d, "doc_id").select("doc_id", F.col("toxic").alias("y"), (F.pmod(F.col("doc_id") * 7919, F.lit(64)) / 64.0).alias("s"), F.col("n_chars").cast("double").alias("amount"))


SCORED = "r AS (SELECT doc_id, toxic AS y, (doc_id * 7919 % 64) / 64.0::DOUBLE AS s, n_chars::DOUBLE AS amount FROM labels JOIN documents USING (doc_id))"
_BY = "g AS (SELECT s, count(*) AS n, sum(y) AS pos FROM r GROUP BY s), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cum_n, sum(pos) OVER (ORDER BY s DESC) AS cum_pos FROM g), t AS (SELECT count(*) AS all_n, sum(y) AS all_pos FROM r)"


@query(f"WITH {SCORED}, {_BY} SELECT any_value(all_n)::BIGINT AS n, any_value(all_pos)::BIGINT AS positives, round(sum(pos * cum_pos / cum_n) / any_value(all_pos), 6) AS average_precision, round(sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2)) / any_value(all_pos * (all_n - all_pos)), 6) AS roc_auc FROM c, t")
def j16_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.rank_metrics(scored(spark, sf_dir)).select("n", "positives", F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {SCORED}, o AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS m FROM r WHERE y = 0), q AS (SELECT s FROM o WHERE k = ceil((m - 1) * 0.95 - 1e-9) + 1) SELECT round(avg((r.s > q.s)::INT), 6) AS recall, any_value(q.s) AS threshold FROM r, q WHERE y = 1")
def j18_recall_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.recall_at_fpr(scored(spark, sf_dir), 0.05).select(F.round("recall", 6).alias("recall"), "threshold")


@query(f"""WITH {SCORED}, {_BY}, k AS (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT AS k FROM r), a AS (SELECT s AS kth, (k - cum_n + n) / n AS share, k FROM c, k WHERE cum_n >= k AND cum_n - n < k),
w AS (SELECT r.*, k, CASE WHEN s > kth THEN 1 WHEN s = kth THEN share ELSE 0 END AS weight FROM r, a)
SELECT any_value(k)::BIGINT AS alerts, round(sum(weight * y) / any_value(k), 6) AS precision, round(sum(weight * y) / sum(y), 6) AS recall, round(sum(weight * y * amount) / sum(y * amount), 6) AS amount_recall, round(sum(CASE WHEN y = 1 THEN amount * (1 - weight) ELSE 0 END) + 50 * sum(weight * (1 - y)), 2) AS cost FROM w""")
def j20_budget_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mx.budget_metrics(scored(spark, sf_dir), 0.1)
    return m.select("alerts", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "amount_recall")), F.round("cost", 2).alias("cost"))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(s * 10), 9) AS b, count(*) AS n, avg(s) AS p, avg(y) AS q, sum((s - y) ** 2) AS e FROM r GROUP BY 1) SELECT round(sum(e) / sum(n), 6) AS brier, round(sum(n * abs(p - q)) / sum(n), 6) AS ece FROM b")
def j21_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.calibration(scored(spark, sf_dir)).select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


@query(f"""WITH {EVENT_TX}, x AS (SELECT amount FROM t WHERE channel <> 'error'), y AS (SELECT amount FROM t WHERE channel = 'error'),
e AS (SELECT list_distinct(list_transform(quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda v: round(v, 8))) AS ed FROM x),
h AS (SELECT len(list_filter(ed, lambda v: v <= amount)) AS b, 1 AS e, 0 AS a FROM x, e UNION ALL SELECT len(list_filter(ed, lambda v: v <= amount)), 0, 1 FROM y, e),
s AS (SELECT b, sum(e) AS e, sum(a) AS a FROM h GROUP BY b), z AS (SELECT sum(e) AS te, sum(a) AS ta, count(*) AS k FROM s), p AS (SELECT (e / te + 1e-4) / (1 + 1e-4 * k) AS p, (a / ta + 1e-4) / (1 + 1e-4 * k) AS q FROM s, z)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def j24_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_tx(spark, sf_dir)
    return mx.psi(e.where("channel <> 'error'"), e.where("channel = 'error'"), "amount").select(F.round("psi", 6).alias("psi"))


@query(f"""WITH {ORDER_TX}, g AS (SELECT us, count(*) AS n FROM t GROUP BY us), c AS (SELECT us, n, sum(n) OVER (ORDER BY us) AS upto FROM g), z AS (SELECT count(*) AS k FROM t),
p AS (SELECT us, CASE WHEN upto - n < floor(k * 0.7) THEN 'train' WHEN upto - n < floor(k * 0.85) THEN 'valid' ELSE 'test' END AS part FROM c, z)
SELECT part, count(*)::BIGINT AS n, min(us)::BIGINT AS first_us, max(us)::BIGINT AS last_us FROM t JOIN p USING (us) GROUP BY part""")
def j04_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.time_split(order_tx(spark, sf_dir)).groupBy("part").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"WITH {SCORED}, {_BY} SELECT arg_max(s, (2 * cum_pos / (cum_n + all_pos), s)) AS threshold, round(max(2 * cum_pos / (cum_n + all_pos)), 6) AS f1 FROM c, t")
def q19_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.best_f1(scored(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


@query()
def j28_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.bootstrap_recall(scored(spark, sf_dir))


@query(f"""WITH {EVENT_TX}, k AS (SELECT tx_id, amount, device::INT AS k FROM t), l AS (SELECT tx_id, -ln(count(*) OVER (ORDER BY amount) / count(*) OVER ()) AS a, -ln(count(*) OVER (ORDER BY amount DESC) / count(*) OVER ()) AS b, -ln(count(*) OVER (ORDER BY k) / count(*) OVER ()) AS c, -ln(count(*) OVER (ORDER BY k DESC) / count(*) OVER ()) AS d FROM k)
SELECT tx_id, round(greatest(a, b) + greatest(c, d), 6) AS ecod FROM l""")
def j09_ecod(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_tx(spark, sf_dir).select("tx_id", "amount", F.col("device").cast("int").alias("k"))
    return mx.empirical_tails(e, ["amount", "k"]).select("tx_id", F.round("ecod", 6).alias("ecod"))


@query("SELECT s.source, coalesce(sum((lang = 'en')::INT), 0)::BIGINT AS en, coalesce(sum((lang = 'de')::INT), 0)::BIGINT AS de, coalesce(sum((lang = 'fr')::INT), 0)::BIGINT AS fr, coalesce(sum((lang = 'es')::INT), 0)::BIGINT AS es FROM documents s GROUP BY s.source")
def j34_outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM events GROUP BY 1")
def j40_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = mx.quantiles(e, "value", [0.5, 0.95, 0.99], by=["event_type"])
    at = lambda p: F.round(F.max(F.when(F.col("point") == p, F.col("value"))), 6)
    # one row an event type on either side
    q = q.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")).withColumnRenamed("event_type", "_type")
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return top.join(q, F.col("event_type").eqNullSafe(F.col("_type")), "left").select("event_type", "p50", "p95", "p99", "top")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_tx(spark, sf_dir).where("channel in ('error', 'purchase')")
    return e.select("tx_id", "us", "cust", "amount", (F.col("device").cast("int") / 100.0).alias("risk"), F.col("channel").alias("alert_type"), F.when(F.col("channel") == "error", 2).otherwise(1).alias("type_rank"))


_ALERTS = "a AS (SELECT tx_id, us, cust, amount, device::INT / 100.0::DOUBLE AS risk, channel AS alert_type, CASE channel WHEN 'error' THEN 2 ELSE 1 END AS type_rank FROM t WHERE channel IN ('error', 'purchase'))"
_GROUPED = f"n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY cust ORDER BY us, tx_id) <= {fr.DAY} THEN 0 ELSE 1 END AS fresh FROM a), s AS (SELECT *, sum(fresh) OVER (PARTITION BY cust ORDER BY us, tx_id) AS case_no FROM n)"


@query(f"WITH {EVENT_TX}, {_ALERTS}, {_GROUPED} SELECT tx_id, cust, case_no::BIGINT AS case_no FROM s")
def k04_case_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.group_cases(_alerts(spark, sf_dir)).select("tx_id", "cust", "case_no")


@query(f"WITH {EVENT_TX}, {_ALERTS}, {_GROUPED} SELECT cust, case_no::BIGINT AS case_no, count(*)::BIGINT AS alert_count, round(sum(amount), 2) AS total, round(sum(round(risk::DECIMAL(9,6) * amount::DECIMAL(18,2), 2))::DOUBLE, 2) AS priority, arg_max(alert_type, (type_rank, alert_type)) AS case_type, min(us)::BIGINT AS opened_us, max(us)::BIGINT AS updated_us FROM s GROUP BY ALL")
def k05_case_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.roll_up(cs.group_cases(_alerts(spark, sf_dir))).withColumn("total", F.round("total", 2)).withColumn("priority", F.round(F.col("priority").cast("double"), 2))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def k06_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def k08_counts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


_NOW = 1_706_000_000_000_000


@query(f"WITH {EVENT_TX}, {_ALERTS}, {_GROUPED}, c AS (SELECT min(us) AS o, cust % 3 AS st FROM s GROUP BY cust, case_no) SELECT count(*) FILTER (WHERE st <> 0)::BIGINT AS open, count(*) FILTER (WHERE st <> 0 AND o + {4 * fr.HOUR} < {_NOW})::BIGINT AS breached, count(*) FILTER (WHERE st <> 0 AND o + {4 * fr.HOUR} >= {_NOW} AND o + {4 * fr.HOUR} < {_NOW} + {fr.HOUR})::BIGINT AS due_soon FROM c")
def k09_sla_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cs.roll_up(cs.group_cases(_alerts(spark, sf_dir))).withColumn("status", F.when(F.col("cust") % 3 == 0, "CLOSED").otherwise("OPEN"))
    return cs.sla_scan(c, _NOW, 4 * fr.HOUR, fr.HOUR)


HOLIDAYS = ("2024-01-01", "2024-01-15")
_CAL = f"cal AS (SELECT d::DATE AS day, dayofweek(d) NOT IN (0, 6) AND d::DATE::VARCHAR NOT IN {HOLIDAYS} AS is_business FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-04-30', INTERVAL 1 DAY)) AS d)), k AS (SELECT *, sum(is_business::INT) OVER (ORDER BY day) AS n FROM cal)"


@query(f"WITH {_CAL}, e AS (SELECT event_id, ts::DATE AS day FROM events) SELECT event_id, b.day::VARCHAR AS due, (j.n - a.n)::BIGINT AS business_days FROM e JOIN k a USING (day) JOIN k b ON b.n = a.n + 10 AND b.is_business JOIN k j ON j.day = e.day + 20")
def k12_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = cs.calendar(spark, "2023-12-01", "2024-04-30", HOLIDAYS)
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.date_add(F.to_date("ts"), 20).alias("later"))
    out = cs.business_days_between(cs.add_business_days(e, "day", 10, cal), "day", "later", cal)
    return out.select("event_id", F.col("due").cast("string").alias("due"), "business_days")


@query(f"""WITH {EVENT_TX}, e AS (SELECT tx_id, us, cust, CASE WHEN channel = 'signup' THEN 'analyst' ELSE 'system' END AS actor, tx_id % 3 AS want FROM t),
g AS (SELECT *, sum((actor = 'analyst')::INT) OVER (PARTITION BY cust ORDER BY us, tx_id) AS seg FROM e),
s AS (SELECT *, max(want) OVER (PARTITION BY cust, seg ORDER BY us, tx_id) AS st FROM g),
m AS (SELECT *, (st <> coalesce(lag(st) OVER (PARTITION BY cust ORDER BY us, tx_id), 0))::INT AS moved FROM s)
SELECT tx_id, (['AKTIF', 'INCELENIYOR', 'BLOKE'])[st + 1] AS status, (sum(moved) OVER (PARTITION BY cust ORDER BY us, tx_id))::BIGINT AS version FROM m""")
def h12_account_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, cs.STATES))
    e = event_tx(spark, sf_dir).select("tx_id", "us", "cust", F.when(F.col("channel") == "signup", "analyst").otherwise("system").alias("actor"), F.get(states, (F.col("tx_id") % 3).cast("int")).alias("requested"))
    return cs.account_states(e).select("tx_id", "status", "version")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS chain, event_id AS id, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
c AS (SELECT chain, id, r, '' AS prev_hash, sha256('|' || payload) AS hash FROM e WHERE r = 1 UNION ALL SELECT e.chain, e.id, e.r, c.hash, sha256(c.hash || '|' || e.payload) FROM c JOIN e ON e.chain = c.chain AND e.r = c.r + 1)
SELECT chain, id, prev_hash, hash FROM c""")
def h14_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), F.concat_ws(":", "event_type", "event_id").alias("payload"))
    return cs.append_chain(e).select("chain", "id", "prev_hash", "hash")


@query("SELECT user_id::VARCHAR AS chain, event_id AS id FROM events WHERE event_id % 97 = 5")
def h15_verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries tampered with in their payload are found, and no others."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("id"), F.concat_ws(":", "event_type", "event_id").alias("payload"))
    log = cs.append_chain(e).withColumn("payload", F.when(F.col("id") % 97 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return cs.verify_chain(log).select("chain", "id")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0")
def b06_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal") + 1).alias("c_acctbal")).union(c.where("c_custkey % 7 = 0").select(F.col("c_custkey") + 1000000, "c_name", "c_acctbal"))
    return cs.upsert(c, fresh, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def b02_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return cs.insert_missing(c.where("c_custkey % 3 > 0"), c.union(c), ["c_custkey"])


@query("SELECT doc_id AS tx_id, CASE WHEN doc_id % 2 = 0 THEN 'analyst' ELSE 'auto' END AS source, arg_max(quality, quality)::INT AS label FROM labels GROUP BY 1, 2")
def b09_label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("tx_id"), F.when(F.col("doc_id") % 2 == 0, "analyst").otherwise("auto").alias("source"), F.col("quality").alias("label"))
    older = l.select("tx_id", "source", (1 - F.col("label")).alias("label"), F.lit(1).alias("created"))
    return cs.newest_labels(older.union(l.withColumn("created", F.lit(2)))).select("tx_id", "source", F.col("label").cast("int").alias("label"))


@query("SELECT user_id, count(*)::BIGINT AS events, round(sum(value), 2) AS volume, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def k21_live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("volume"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("WITH h AS (SELECT event_type, least(floor(value / 50), 9)::BIGINT AS b, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) AS r FROM c WHERE upto >= 0.95 * total) SELECT event_type, round((b * 50 + 50 * (0.95 * total - (upto - n)) / n)::DOUBLE, 4) AS p95 FROM f WHERE r = 1")
def k26_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantile read off fixed buckets, linear within one."""
    from pyspark.sql.window import Window as W

    h = table(spark, sf_dir, "events").groupBy("event_type", F.least(F.floor(F.col("value") / 50), F.lit(9)).alias("b")).agg(F.count("*").alias("n"))
    w = W.partitionBy("event_type")
    c = h.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("total", F.sum("n").over(w)).where(F.col("upto") >= 0.95 * F.col("total"))
    f = c.withColumn("r", F.row_number().over(w.orderBy("b"))).where("r = 1")
    return f.select("event_type", F.round(F.col("b") * 50 + 50 * (0.95 * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n"), 4).alias("p95"))


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def q01_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_partkey, l_suppkey, l_extendedprice)) > 1")
def q08_payload_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey", "l_extendedprice"), 256)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct(d).alias("n")).where("n > 1").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN l.n IS NULL THEN 'pending' WHEN o_orderstatus = 'F' THEN 'blocked' WHEN l.n > 4 THEN 'warned' ELSE 'passed' END AS outcome FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def q33_console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("n").isNull(), "pending").when(F.col("o_orderstatus") == "F", "blocked").when(F.col("n") > 4, "warned").otherwise("passed").alias("outcome"))


@query(f"WITH {ORDER_TX}, r AS (SELECT *, row_number() OVER (PARTITION BY us ORDER BY tx_id) - 1 AS k, count(*) OVER (PARTITION BY us) AS c FROM t) SELECT tx_id, round(3600 * k / c, 3) AS offset_s FROM r")
def a07_even_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one time step spread evenly over an hour."""
    from ..sources.files import spread_within_step

    return spread_within_step(order_tx(spark, sf_dir), "us", "tx_id").select("tx_id", "offset_s")


@query(f"WITH {ORDER_TX}, f AS (SELECT min(us) AS us, cust FROM t GROUP BY cust) SELECT cust, us::BIGINT AS first_us FROM f")
def a08_distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tx(spark, sf_dir).groupBy("cust").agg(F.min("us").alias("first_us"))


@query(f"WITH {EVENT_TX} SELECT tx_id, (us + ({_NOW} - max(us) OVER ()))::BIGINT AS us FROM t")
def a21_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import rebase

    return rebase(event_tx(spark, sf_dir), _NOW).select("tx_id", "us")

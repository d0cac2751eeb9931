"""Queries of evaluation protocols, drift, samples and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from ..operators import evaluation as ev
from ..operators import frames as fr
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx
from .world import DECISIONS, decisions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {ORDER_TX}, k AS (SELECT * FROM t WHERE tx_id % 10 > 0), r AS (SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) - 1 AS i, count(*) OVER () AS n FROM k) SELECT tx_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'valid' ELSE 'test' END AS part FROM r")
def j03_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tx(spark, sf_dir).withColumn("skip", F.col("tx_id") % 10 == 0)
    return ev.row_split(t, ["us", "tx_id"], exclude="skip").select("tx_id", "part")


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as layered scores: the order failed (y), rule and model scores from the key, anomalies from two percentiles."""
    d = decisions(spark, sf_dir)
    k = F.col("tx_id")
    d = d.select("tx_id", "us", (F.col("status") == "F").cast("int").alias("y"), "amount", F.col("risk").alias("rule_score"), F.col("challenger").alias("ml_score"), ev.ensemble((k * 31 % 100) / 100.0, (k * 17 % 100) / 100.0).alias("anomaly_score"), ((k * 13 % 50) / 50.0).alias("signal"), "decision")
    return ev.layer_scores(d, (0.7, 0.6, 0.1), (0.5, 0.4, 0.3, -0.2), lambda s: noisy_or(F.array(s, 0.25 * F.col("signal"))))


_LOGIT = "ln(greatest(0.001, least(0.999, {x})) / (1 - greatest(0.001, least(0.999, {x}))))"
_R, _M, _A = (_LOGIT.format(x=x) for x in ("rule_score", "ml_score", "anomaly_score"))
LAYERED = f"""{DECISIONS}, l0 AS (SELECT tx_id, us, (status = 'F')::INT AS y, amount, risk AS rule_score, challenger AS ml_score, ((tx_id * 31 % 100) / 100.0::DOUBLE + (tx_id * 17 % 100) / 100.0::DOUBLE) / 2 AS anomaly_score, (tx_id * 13 % 50) / 50.0::DOUBLE AS signal, decision FROM dec),
l1 AS (SELECT *, 1 / (1 + exp(-({_R} * 0.7 + {_M} * 0.6 + 0.1))) AS rules_gbm, 1 / (1 + exp(-({_R} * 0.5 + {_M} * 0.4 + {_A} * 0.3 - 0.2))) AS anomaly FROM l0),
l2 AS (SELECT *, rule_score AS rules, ml_score AS gbm, 1 - (1 - anomaly) * (1 - 0.25 * signal) AS graph FROM l1),
l3 AS (SELECT *, list_position(['ALLOW', 'STEP_UP', 'HOLD', 'BLOCK'], decision) - 1 + graph AS "full" FROM l2)"""


@query(f'WITH {LAYERED} SELECT tx_id, round(rules, 6) AS rules, round(gbm, 6) AS gbm, round(rules_gbm, 6) AS rules_gbm, round(anomaly, 6) AS anomaly, round(graph, 6) AS graph, round("full", 6) AS "full" FROM l3')
def j30_layer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).select("tx_id", *(F.round(n, 6).alias(n) for n in ev.LAYERS))


def _layer_sql(name: str) -> str:
    return f"""SELECT '{name}' AS layer, any_value(all_n)::BIGINT AS n, any_value(all_pos)::BIGINT AS positives, round(sum(pos * cum_pos / cum_n) / any_value(all_pos), 4) AS pr_auc,
  round(sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2)) / any_value(all_pos * (all_n - all_pos)), 4) AS roc_auc FROM (
  SELECT *, sum(n) OVER (ORDER BY s DESC) AS cum_n, sum(pos) OVER (ORDER BY s DESC) AS cum_pos FROM (SELECT round("{name}", 4) AS s, count(*) AS n, sum(y) AS pos FROM l3 GROUP BY 1)), (SELECT count(*) AS all_n, sum(y) AS all_pos FROM l3)"""


@query(f"WITH {LAYERED} " + " UNION ALL ".join(_layer_sql(n) for n in ev.LAYERS))
def j31_layer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics of each layer; scores to 4 digits, so that neighbours do not part by rounding."""
    d = layered(spark, sf_dir)
    d = d.select("tx_id", "y", "amount", *(F.round(n, 4).alias(n) for n in ev.LAYERS))
    return ev.layer_metrics(d).select("layer", "n", "positives", "pr_auc", "roc_auc")


_DRAW = "((({i} * 48271 + r * 69621 + 12345) % 2147483647) ** 2)::HUGEINT"


def _resample_sql(rounds: int) -> str:
    x = "((i * 48271 + r * 69621 + 12345) % 2147483647)"
    return f"""st AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY tx_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM b0),
dr AS (SELECT y, r, (((({x} * {x}) % 2147483647) * 16807 + r) % 2147483647) % n AS i, count(*) AS times FROM st, range(1, {rounds + 1}) g(r) GROUP BY ALL),
sm AS (SELECT st.*, r, times FROM dr JOIN st USING (y, i))"""


def _ap_sql(score: str, name: str) -> str:
    return f"""{name} AS (SELECT r, sum(pos * cp / cn) / sum(pos) AS ap FROM (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY r ORDER BY s DESC) AS cp
  FROM (SELECT r, {score} AS s, sum(times) AS n, sum(times * y) AS pos FROM sm GROUP BY ALL)) GROUP BY r)"""


def _whole_ap(score: str) -> str:
    return f"(SELECT sum(pos * cp / cn) / sum(pos) FROM (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp FROM (SELECT {score} AS s, count(*) AS n, sum(y) AS pos FROM b0 GROUP BY ALL)))"


@query(f"""WITH {DECISIONS}, b0 AS (SELECT tx_id, (status = 'F')::INT AS y, risk, challenger FROM dec), {_resample_sql(20)}, {_ap_sql("challenger", "ca")}, {_ap_sql("risk", "ra")},
d AS (SELECT ca.ap - ra.ap AS d FROM ca JOIN ra USING (r)), o AS (SELECT round({_whole_ap("challenger")} - {_whole_ap("risk")}, 4) AS delta, round(quantile_cont(d, 0.025), 4) AS low, round(quantile_cont(d, 0.975), 4) AS high FROM d)
SELECT delta, low, high, CASE WHEN low <= 0 AND high >= 0 THEN 'none' WHEN delta > 0 THEN 'gain' ELSE 'harm' END AS verdict FROM o""")
def j32_layer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of two scores on the same stratified resamples (20 rounds here), and the verdict."""
    d = decisions(spark, sf_dir).select("tx_id", (F.col("status") == "F").cast("int").alias("y"), "risk", "challenger")
    return ev.paired_difference(d, ["tx_id"], "challenger", "risk", rounds=20)


@query(f"""WITH {DECISIONS}, b0 AS (SELECT tx_id, (status = 'F')::INT AS y, risk FROM dec WHERE tx_id % 4 = 0), {_resample_sql(20)},
f AS (SELECT r, 2 * sum(times * y) FILTER (WHERE risk >= 0.5) / greatest(1, sum(times) FILTER (WHERE risk >= 0.5) + sum(times * y)) AS f1 FROM sm GROUP BY r)
SELECT round(quantile_cont(f1, 0.025), 4) AS low, round(quantile_cont(f1, 0.975), 4) AS high FROM f""")
def q21_f1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir).where("tx_id % 4 = 0").select("tx_id", (F.col("status") == "F").cast("int").alias("y"), "risk")
    return ev.interval(ev.f1_by_round(ev.drawn(d, ["tx_id"], 20), "risk", 0.5), "f1")


_VARIANTS = {"nonneg": ((0.6, 0.5, 0.1), -0.3), "nonneg_no_anomaly": ((0.6, 0.5, 0.0), -0.3), "unconstrained": ((0.6, 0.5, -0.2), -0.3)}


def _variant_sql(name: str, coef: tuple, b: float) -> str:
    z = f"({_R} * {coef[0]} + {_M} * {coef[1]} + {_A} * {coef[2]} + {b})"
    return f"SELECT '{name}' AS variant, round(avg(greatest({z}, 0) + ln(1 + exp(-abs({z}))) - y * {z}), 6) AS log_loss, round(avg((1 / (1 + exp(-{z})) - y) ** 2), 6) AS brier FROM l0"


@query(f"WITH {LAYERED}, v AS ({' UNION ALL '.join(_variant_sql(n, c, b) for n, (c, b) in _VARIANTS.items())}) SELECT *, (SELECT log_loss FROM v WHERE variant = 'nonneg') < (SELECT log_loss FROM v WHERE variant = 'nonneg_no_anomaly') - 1e-5 AS anomaly_kept FROM v")
def j14_input_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores of three stacker variants (q22), and the choice between them."""
    return ev.input_ablation(layered(spark, sf_dir), _VARIANTS, ["rule_score", "ml_score", "anomaly_score"])


@query(f"WITH {LAYERED}, c AS (SELECT 'v' || (tx_id % 5) AS version, round(sum(amount * (y = 1 AND ml_score < 0.5)::INT) / sum(amount * y), 3) AS missed_share, round(avg(ml_score), 3) AS pr_auc FROM l0 GROUP BY 1) SELECT version FROM c ORDER BY missed_share, pr_auc DESC, version LIMIT 1")
def j38_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layered(spark, sf_dir)
    missed = F.sum(F.when((F.col("y") == 1) & (F.col("ml_score") < 0.5), F.col("amount")).otherwise(0.0)) / F.sum(F.col("amount") * F.col("y"))
    c = d.groupBy(F.concat(F.lit("v"), (F.col("tx_id") % 5).cast("string")).alias("version")).agg(F.round(missed, 3).alias("missed_share"), F.round(F.avg("ml_score"), 3).alias("pr_auc"))
    return ev.champion(c).select("version")


_EDGES = [20.0, 50.0, 80.0, 120.0, 200.0]
_BIN = "len(list_filter([20.0, 50.0, 80.0, 120.0, 200.0], lambda e: e <= amount))"


@query(f"WITH {EVENT_TX}, g AS (SELECT bin, coalesce(n, 0) AS n FROM range(6) r(bin) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM t GROUP BY 1) USING (bin)) SELECT bin::INT AS bin, round(n / (SELECT count(*) FROM t), 9) AS share FROM g")
def q15_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.distribution(event_tx(spark, sf_dir), "amount", _EDGES).select("bin", F.round("share", 9).alias("share"))


@query(f"""WITH {EVENT_TX}, ref AS (SELECT bin, coalesce(n, 0) / (SELECT count(*) FROM t WHERE channel = 'view') AS share FROM range(6) r(bin) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM t WHERE channel = 'view' GROUP BY 1) USING (bin)),
p AS (SELECT {_BIN} AS bin, row_number() OVER (ORDER BY us, tx_id) AS nth FROM t), e AS (SELECT k * 500 AS seen FROM range(1, (SELECT max(nth) // 500 + 1 FROM p)) r(k)),
w AS (SELECT seen, bin, count(nth) AS n FROM e CROSS JOIN ref LEFT JOIN p USING (bin) WHERE nth IS NULL OR (nth <= seen AND nth > seen - 5000) GROUP BY seen, bin),
x AS (SELECT e.seen, ref.bin, share, coalesce(n, 0) AS n, least(5000, e.seen) AS total FROM e CROSS JOIN ref LEFT JOIN w ON w.seen = e.seen AND w.bin = ref.bin),
y AS (SELECT seen, (n / total + 1e-4) / (1 + 6e-4) AS q, (share + 1e-4) / (1 + 6e-4) AS p FROM x)
SELECT seen::BIGINT AS seen, round(sum((q - p) * ln(q / p)), 4) AS psi FROM y GROUP BY seen""")
def h16_drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stability of the last 5,000 amounts after each 500, against those of one channel."""
    t = event_tx(spark, sf_dir)
    return ev.drift_windows(t, ["us", "tx_id"], "amount", ev.distribution(t.where("channel = 'view'"), "amount", _EDGES), _EDGES).select(F.col("seen").cast("long").alias("seen"), "psi")


_LCG = "(((tx_id * 48271 + 42) % 2147483647) * ((tx_id * 48271 + 42) % 2147483647)) % 2147483647"


@query(f"WITH {EVENT_TX}, r AS (SELECT tx_id, channel, row_number() OVER (PARTITION BY channel ORDER BY {_LCG}, tx_id) AS r FROM t) SELECT tx_id, channel FROM r WHERE r <= 40")
def q23_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified_sample(event_tx(spark, sf_dir).select("tx_id", "channel"), ["channel"], 40, "tx_id")


_STEPS = "nd AS (SELECT c_custkey AS node, c_custkey % 6 AS step FROM customer), el AS (SELECT DISTINCT o_custkey AS a, (o_orderkey * 7 % (SELECT count(*) FROM customer)) AS b FROM orders), eb AS (SELECT a, b FROM el UNION SELECT b, a FROM el), ei AS (SELECT a, b FROM eb JOIN nd x ON x.node = a JOIN nd y ON y.node = b WHERE x.step = y.step), s0 AS (SELECT step, min(node) AS node FROM nd GROUP BY step)"


def _step_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .tables import table

    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 6).alias("step"))
    edges = table(spark, sf_dir, "orders").crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % F.col("n")).alias("b")).distinct()
    return nodes, edges


@query(f"""WITH {_STEPS}, d1 AS (SELECT DISTINCT step, b AS node FROM s0 JOIN ei ON a = node WHERE b <> node), d2 AS (SELECT DISTINCT step, b AS node FROM d1 JOIN ei ON a = node WHERE (step, b) NOT IN (SELECT (step, node) FROM d1) AND (step, b) NOT IN (SELECT (step, node) FROM s0)),
u AS (SELECT step, node, 0 AS distance FROM s0 UNION ALL SELECT step, node, 1 FROM d1 UNION ALL SELECT step, node, 2 FROM d2), r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY distance, node) AS r FROM u) SELECT step, node, distance FROM r WHERE r <= 25""")
def q24_connected_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _step_graph(spark, sf_dir)
    starts = nodes.groupBy("step").agg(F.min("node").alias("node"))
    return ev.connected_sample(nodes, edges, starts, 25, 2)


_U = "(((tx_id * 48271 + 42) % 2147483647) / 2147483647.0::DOUBLE)"


@query(f"""WITH {DECISIONS}, u AS (SELECT tx_id, decision, {_U} AS u, ((status = 'F')::INT + (tx_id % 11 = 0)::INT) % 2 AS fraud, CASE WHEN tx_id % 3 = 0 THEN 0.6 END AS rate FROM dec)
SELECT tx_id, CASE WHEN decision = 'STEP_UP' THEN CASE WHEN CASE WHEN fraud = 1 THEN u < coalesce(rate, 0.3) ELSE u >= 0.05 END THEN 'step_up_passed' ELSE 'step_up_failed' END END AS outcome FROM u""")
def h05_step_up_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    u = F.pmod(F.col("tx_id") * 48271 + 42, F.lit(2**31 - 1)) / F.lit(float(2**31 - 1))
    return d.select("tx_id", ev.step_up_outcome(F.col("decision"), F.col("status") == "F", F.col("tx_id") % 11 == 0, u, F.when(F.col("tx_id") % 3 == 0, 0.6)).alias("outcome"))


_SEEN = "sn AS (SELECT 'customer' AS kind, cust::VARCHAR AS key, us FROM t UNION ALL SELECT 'device', device, us FROM t UNION ALL SELECT 'pair', cust || '|' || payee, us FROM t)"
_NOW, _TTL = 1_706_700_000_000_000, {"customer": fr.DAY // 2, "device": fr.HOUR * 3, "pair": 5 * fr.DAY}


@query(f"WITH {EVENT_TX}, {_SEEN}, l AS (SELECT kind, key, max(us) AS us FROM sn GROUP BY ALL) SELECT kind, count(*)::BIGINT AS n FROM l WHERE us > {_NOW} - CASE kind WHEN 'customer' THEN {_TTL['customer']} WHEN 'device' THEN {_TTL['device']} ELSE {_TTL['pair']} END GROUP BY kind")
def n12_live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyed store holds at a time, by kind (q28)."""
    t = event_tx(spark, sf_dir)
    pair = F.concat_ws("|", F.col("cust").cast("string"), "payee")
    seen = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key"), F.col("us").alias("us")) for k, v in (("customer", F.col("cust").cast("string")), ("device", F.col("device")), ("pair", pair))))).alias("s")).select("s.*")
    return ev.live_keys(seen, _NOW, _TTL)


@query(f"WITH {EVENT_TX}, a AS (SELECT tx_id, cust, us, tx_id * 7919 % 10007 AS seq FROM t), p AS (SELECT *, max(us) OVER (PARTITION BY cust ORDER BY seq, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM a) SELECT tx_id FROM p WHERE us < past")
def n11_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_tx(spark, sf_dir).select("tx_id", "cust", "us", F.struct((F.col("tx_id") * 7919 % 10007), "tx_id").alias("seq"))
    return ev.late_arrivals(a).select("tx_id")

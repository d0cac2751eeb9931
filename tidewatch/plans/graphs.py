"""Queries of graph signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import graph as gr
from ..operators import signals as sg
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MONTH = 30 * fr.DAY


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier n's account is that of customer n."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("payee"), F.col("s_suppkey").alias("owner"))


OWNERS = "own AS (SELECT s_suppkey::VARCHAR AS payee, s_suppkey AS owner FROM supplier)"
BEFORE = "(b.us < a.us OR (b.us = a.us AND b.tx_id < a.tx_id))"


@query(f"WITH {EVENT_TX} SELECT a.tx_id, (count(b.tx_id) + 1)::BIGINT AS n, least(1, (count(b.tx_id) + 1) / 3) AS burst FROM t a LEFT JOIN t b ON b.cust = a.cust AND b.payee = a.payee AND b.us >= a.us - {6 * fr.HOUR} AND {BEFORE} GROUP BY a.tx_id")
def g20_edge_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.edge_burst(event_tx(spark, sf_dir), 6 * fr.HOUR)


@query(f"""WITH {ORDER_TX}, {OWNERS}, i AS (SELECT a.tx_id, sum(b.amount) AS inflow, count(DISTINCT b.cust) AS fan_in FROM t a JOIN own o ON o.owner = a.cust JOIN t b ON b.payee = o.payee AND b.cust <> a.cust AND b.us >= a.us - {MONTH} AND {BEFORE} GROUP BY a.tx_id),
u AS (SELECT a.tx_id, coalesce(sum(b.amount) FILTER (WHERE b.payee <> ''), 0) AS outflow FROM t a LEFT JOIN t b ON b.cust = a.cust AND b.us >= a.us - {MONTH} AND {BEFORE} GROUP BY a.tx_id)
SELECT t.tx_id, round(coalesce(inflow, 0), 2) AS inflow, coalesce(fan_in, 0)::BIGINT AS fan_in, round(CASE WHEN inflow > 0 AND amount > 0 AND (fan_in >= 2 OR inflow >= 10000) THEN least(1, (outflow + amount) / inflow) ELSE 0 END, 6) AS pass_through
FROM t LEFT JOIN i USING (tx_id) JOIN u USING (tx_id)""")
def g02_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gr.pass_through(order_tx(spark, sf_dir), owners(spark, sf_dir), MONTH)
    return out.select("tx_id", F.round("inflow", 2).alias("inflow"), "fan_in", F.round("pass_through", 6).alias("pass_through"))


_MOVES = "m AS (SELECT t.tx_id, us, cust AS src, owner AS dst, amount FROM t JOIN own USING (payee))"


@query(f"""WITH {ORDER_TX}, {OWNERS}, {_MOVES}, s0 AS (SELECT tx_id, us, src AS cust, amount, dst AS at FROM m WHERE dst <> src),
s1 AS (SELECT DISTINCT a.tx_id, a.us, a.cust, a.amount, b.dst AS at FROM s0 a JOIN m b ON b.src = a.at AND b.us >= a.us - {20 * MONTH} AND {BEFORE} AND b.amount BETWEEN a.amount * 0.5 AND a.amount * 2),
s2 AS (SELECT DISTINCT a.tx_id, a.us, a.cust, a.amount, b.dst AS at FROM s1 a JOIN m b ON a.at <> a.cust AND b.src = a.at AND b.us >= a.us - {20 * MONTH} AND {BEFORE} AND b.amount BETWEEN a.amount * 0.5 AND a.amount * 2),
s3 AS (SELECT DISTINCT a.tx_id, a.us, a.cust, a.amount, b.dst AS at FROM s2 a JOIN m b ON a.at <> a.cust AND b.src = a.at AND b.us >= a.us - {20 * MONTH} AND {BEFORE} AND b.amount BETWEEN a.amount * 0.5 AND a.amount * 2)
SELECT DISTINCT tx_id FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE at = cust""".replace(" AS at", " AS pos").replace("a.at", "a.pos").replace(" at = cust", " pos = cust"))
def g03_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.cycles(order_tx(spark, sf_dir), owners(spark, sf_dir), 20 * MONTH)


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < -950").select(F.concat(F.lit("C:"), "c_custkey").alias("n"))


@query(f"""WITH {ORDER_TX}, e AS (SELECT DISTINCT 'C:' || cust AS a, 'A:' || payee AS b FROM t WHERE payee <> ''), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
k AS (SELECT g.* FROM g JOIN (SELECT a FROM g GROUP BY a HAVING count(*) <= 200) USING (a)), f AS (SELECT 'C:' || c_custkey AS n FROM customer WHERE c_acctbal < -950),
s AS (SELECT tx_id, 'C:' || cust AS me, 'C:' || cust AS n FROM t UNION ALL SELECT tx_id, 'C:' || cust, 'A:' || payee FROM t WHERE payee <> ''),
o AS (SELECT tx_id, 1 AS d FROM s JOIN k ON s.n = k.a JOIN f ON f.n = k.b WHERE k.b <> me),
w AS (SELECT tx_id, 2 AS d FROM s JOIN k ON s.n = k.a JOIN k j ON j.a = k.b JOIN f ON f.n = j.b WHERE j.b <> me AND k.b <> me)
SELECT t.tx_id, min(coalesce(d, -1))::INT AS fraud_distance FROM t LEFT JOIN (SELECT * FROM o UNION ALL SELECT * FROM w) USING (tx_id) GROUP BY t.tx_id""")
def g04_fraud_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = order_tx(spark, sf_dir)
    return gr.fraud_distance(tx, gr.undirected(tx), _flagged(spark, sf_dir)).select("tx_id", F.coalesce("fraud_distance", F.lit(-1)).alias("fraud_distance"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tx(spark, sf_dir).where("payee <> ''").select(F.concat(F.lit("C:"), "cust").alias("a"), F.concat(F.lit("A:"), "payee").alias("b"), F.col("amount"))


_LINKS = "l AS (SELECT 'C:' || cust AS a, 'A:' || payee AS b, amount FROM t WHERE payee <> '')"


@query(f"""WITH RECURSIVE {ORDER_TX}, {_LINKS}, g AS (SELECT DISTINCT a, b FROM l UNION SELECT DISTINCT b, a FROM l), r AS (SELECT a AS node, a AS reach FROM g UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def g09_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.components(_links(spark, sf_dir))


ROUNDS = 20
_PR = f"""{ORDER_TX}, ed AS (SELECT 'C:' || cust AS src, 'A:' || payee AS dst, sum(ln(1 + amount)) AS w FROM t WHERE payee <> '' GROUP BY ALL UNION ALL SELECT 'A:' || s_suppkey, 'C:' || s_suppkey, 2 FROM supplier),
ot AS (SELECT src, sum(w) AS total FROM ed GROUP BY src), nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed), nn AS (SELECT count(*) AS n FROM nd),
r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank, node NOT IN (SELECT src FROM ot) AS dangling FROM nd, nn)"""
for _i in range(ROUNDS):
    _PR += f""", r{_i + 1} AS MATERIALIZED (SELECT q.node, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank) FILTER (WHERE dangling), 0) FROM r{_i}) / n) AS rank, dangling
  FROM r{_i} q CROSS JOIN nn LEFT JOIN (SELECT dst, sum(rank * w / total) AS got FROM r{_i} JOIN ed ON node = src JOIN ot USING (src) GROUP BY dst) ON dst = q.node)"""


@query(f"WITH {_PR} SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}")
def g11_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tx(spark, sf_dir).where("payee <> ''").groupBy(F.concat(F.lit("C:"), "cust").alias("src"), F.concat(F.lit("A:"), "payee").alias("dst")).agg(F.sum(F.log1p("amount")).alias("w"))
    own = owners(spark, sf_dir).select(F.concat(F.lit("A:"), "payee").alias("src"), F.concat(F.lit("C:"), "owner").alias("dst"), F.lit(2.0).alias("w"))
    return gr.pagerank(t.union(own), ROUNDS).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH {ORDER_TX}, p AS (SELECT 'C:' || cust AS c, coalesce('C:' || s_suppkey, 'A:' || payee) AS d, ln(1 + sum(amount)) + count(*) AS w FROM t LEFT JOIN supplier ON s_suppkey::VARCHAR = payee WHERE payee <> '' GROUP BY ALL)
SELECT least(c, d) AS a, greatest(c, d) AS b, round(sum(w), 6) AS w FROM p WHERE c <> d GROUP BY ALL""")
def g12_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts collapsed to their owners; weight ln(1 + sum) + n of each direction."""
    t = order_tx(spark, sf_dir).where("payee <> ''").join(owners(spark, sf_dir), "payee", "left")
    node = F.when(F.col("owner").isNotNull(), F.concat(F.lit("C:"), "owner")).otherwise(F.concat(F.lit("A:"), "payee"))
    p = t.groupBy(F.concat(F.lit("C:"), "cust").alias("c"), node.alias("d")).agg((F.log1p(F.sum("amount")) + F.count("*")).alias("w")).where("c <> d")
    return p.groupBy(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).agg(F.round(F.sum("w"), 6).alias("w"))


@query()
def g13_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By modularity, of the undirected projection."""
    return sg.modularity_communities(g12_projection(spark, sf_dir))


@query()
def g14_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.ring_statistics(order_tx(spark, sf_dir), owners(spark, sf_dir), g13_communities(spark, sf_dir), _flagged(spark, sf_dir))


@query(f"""WITH {ORDER_TX}, e AS (SELECT DISTINCT 'C:' || cust AS a, 'A:' || payee AS b FROM t WHERE payee <> ''), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), k AS (SELECT g.* FROM g JOIN (SELECT a FROM g GROUP BY a HAVING count(*) <= 200) USING (a)),
n1 AS (SELECT DISTINCT b AS n FROM k WHERE a = 'C:5'), n2 AS (SELECT DISTINCT k.b AS n FROM n1 JOIN k ON k.a = n1.n WHERE k.b <> 'C:5' AND k.b NOT IN (SELECT n FROM n1))
SELECT n, distance FROM (SELECT 'C:5' AS n, 0 AS distance UNION ALL SELECT n, 1 FROM n1 UNION ALL SELECT n, 2 FROM n2) ORDER BY distance, n LIMIT 150""")
def g16_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbourhood(gr.undirected(order_tx(spark, sf_dir)), "C:5")


@query(f"WITH {ORDER_TX} SELECT tx_id FROM t WHERE us >= (SELECT max(us) FROM t) - {7 * fr.DAY}")
def g17_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a seven-day graph keeps."""
    tx = order_tx(spark, sf_dir)
    last = tx.agg(F.max("us").alias("last"))
    return tx.crossJoin(F.broadcast(last)).where(F.col("us") >= F.col("last") - 7 * fr.DAY).select("tx_id")


@query(f"WITH {ORDER_TX} SELECT count(DISTINCT cust)::BIGINT AS customers, count(DISTINCT nullif(payee, ''))::BIGINT AS accounts, count(DISTINCT (cust, payee)) FILTER (WHERE payee <> '')::BIGINT AS edges, (SELECT count(*) FROM customer WHERE c_acctbal < -950)::BIGINT AS flagged FROM t")
def g19_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tx(spark, sf_dir).withColumn("payee", F.nullif("payee", F.lit("")))
    a = t.agg(F.countDistinct("cust").alias("customers"), F.countDistinct("payee").alias("accounts"), F.countDistinct("cust", "payee").alias("edges"))
    return a.crossJoin(F.broadcast(_flagged(spark, sf_dir).agg(F.count("*").alias("flagged"))))


_W = f"b.us >= a.us - {fr.HOUR} AND (b.us < a.us OR (b.us = a.us AND b.tx_id <= a.tx_id))"


@query(f"""WITH {EVENT_TX}, d AS (SELECT a.tx_id, count(DISTINCT b.cust) AS n FROM t a JOIN t b ON b.device = a.device AND {_W} GROUP BY 1), c AS (SELECT a.tx_id, count(DISTINCT b.payee) AS n FROM t a JOIN t b ON b.cust = a.cust AND {_W} GROUP BY 1)
SELECT tx_id, d.n::INT AS per_device, d.n::INT AS per_payee, c.n::INT AS per_customer, round(0.8 * least(1, greatest(0, (d.n - 1) / 4)) + 0.2 * least(1, greatest(0, (c.n - 1) / 4)), 6) AS score FROM d JOIN c USING (tx_id)""")
def g21_device_mule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gr.device_mule_scores(event_tx(spark, sf_dir))
    return s.withColumn("score", F.round("score", 6))


_STEPS = "n AS (SELECT o_custkey AS node, (min(epoch_us(o_orderdate)) // 2592000000000)::BIGINT AS step FROM orders GROUP BY 1), e AS (SELECT o_custkey AS src, o_orderkey % 1000 AS dst FROM orders)"


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    nodes = o.groupBy(F.col("o_custkey").alias("node")).agg(F.floor(F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(2592000000000)).alias("step"))
    return nodes, o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"))


@query(f"WITH {_STEPS}, s AS (SELECT e.* FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.step = b.step) SELECT node, step, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM n LEFT JOIN (SELECT src AS node, count(*) AS o FROM s GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM s GROUP BY 1) USING (node)")
def g22_step_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.step_features(*_steps(spark, sf_dir))


@query(f"WITH {_STEPS} SELECT count(*) FILTER (WHERE a.step <> b.step)::BIGINT AS cross_step_edges, count(*)::BIGINT AS edges FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst")
def g23_cross_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.cross_step_edges(*_steps(spark, sf_dir))

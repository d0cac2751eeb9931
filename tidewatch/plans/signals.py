"""Queries of the signals beside the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import graph as gr
from ..operators import rules as rl
from ..operators import signals as sg
from .graphs import OWNERS, owners
from .records import _CONTRIB, contributions
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


_RANGES = [("10.0.0.0/8", "AA", False, False), ("10.1.0.0/16", "BB", True, False), ("10.2.0.0/15", "CC", False, True), ("172.16.0.0/12", "AA", False, False)]
_IP = "'10.' || (tx_id % 5) || '.' || (tx_id % 200) || '.7'"


@query(f"""WITH {EVENT_TX}, i AS (SELECT tx_id, tx_id % 5 AS second, CASE tx_id % 4 WHEN 0 THEN 'aa' WHEN 1 THEN 'BB' WHEN 2 THEN '' END AS country FROM t),
r AS (SELECT *, CASE WHEN second = 1 THEN 'BB' WHEN second IN (2, 3) THEN 'CC' ELSE 'AA' END AS there FROM i)
SELECT tx_id, (coalesce(country, '') <> '' AND upper(country) <> there)::INT::DOUBLE AS ip_country_mismatch, (second IN (1, 2, 3))::INT::DOUBLE AS is_anonymized_ip FROM r""")
def e22_address_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tx_id")
    t = event_tx(spark, sf_dir).select("tx_id", F.concat(F.lit("10."), (k % 5).cast("string"), F.lit("."), (k % 200).cast("string"), F.lit(".7")).alias("ip"), F.when(k % 4 == 0, "aa").when(k % 4 == 1, "BB").when(k % 4 == 2, "").alias("country"))
    return sg.address_features(t, spark.createDataFrame(_RANGES, "cidr string, country string, vpn boolean, tor boolean"))


@query(f"WITH {EVENT_TX} SELECT tx_id, (tx_id % 4 > 0 AND NOT coalesce(cust % 3 > 0 AND 'city' || (tx_id % 4) IN ('city1', 'city' || (cust % 5)), false))::INT::DOUBLE AS is_new_location FROM t")
def e21_new_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_tx(spark, sf_dir).withColumn("location", F.when(F.col("tx_id") % 4 > 0, F.concat(F.lit("city"), (F.col("tx_id") % 4).cast("string"))).otherwise(""))
    c = t.select("cust").distinct().where("cust % 3 > 0").select("cust", F.array(F.lit("city1"), F.concat(F.lit("city"), (F.col("cust") % 5).cast("string"))).alias("locations"))
    return sg.location_features(t, c)


_FOLDED = "replace(strip_accents(lower(translate(text, 'Iİ', 'ıi'))), 'ı', 'i')"


@query(f"SELECT conv_id, turn, round(least(1, (contains(f, 'acil'))::INT * 0.6 + (contains(f, 'the'))::INT * 0.3 + (contains(f, 'con'))::INT * 0.25), 6)::DOUBLE AS purpose_risk FROM (SELECT conv_id, turn, coalesce({_FOLDED}, '') AS f FROM conversations)")
def e41_purpose_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole of every text."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(F.coalesce(sg.purpose_risk(F.col("text"), {"acil": 0.6, "the": 0.3, "con": 0.25}), F.lit(0.0)), 6).alias("purpose_risk"))


@query(f"WITH {EVENT_TX} SELECT tx_id, coalesce(CASE WHEN tx_id % 2 = 0 THEN amount END, 0) AS app_score, 0::DOUBLE AS graph_score FROM t")
def e43_external_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_tx(spark, sf_dir).select("tx_id", F.when(F.col("tx_id") % 2 == 0, F.col("amount")).alias("app_score"))
    return sg.external_features(t, ["app_score", "graph_score"])


def scam_inputs(t: DataFrame) -> DataFrame:
    """Inputs of the scam signal, made from the key."""
    k = F.col("tx_id")
    flag = lambda m, r=0: (k % m == r).cast("double")
    purpose = F.when(k % 13 == 0, "POLIS geldi").when(k % 13 == 1, "kripto firsati").otherwise("kira")
    cop = F.when(k % 5 == 0, "NO_MATCH").when(k % 5 == 1, "CLOSE").when(k % 5 == 2, "UNKNOWN").otherwise("MATCH")
    return t.withColumns({"is_new_payee": flag(2), "amount_ratio": (k % 7).cast("double"), "first_large_transfer": flag(3), "purpose_risk": (k % 4) / 4.0, "active_call": flag(11), "remote_access": flag(17), "session_duration_s": F.when(k % 6 == 0, -1.0).otherwise((k % 2000).cast("double")), "vulnerable_customer": flag(9, 4), "cop": cop, "payee_account_age_d": F.when(k % 8 > 0, sg.payee_account_age(F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")), F.lit("2024-01-01").cast("date"))), "graph_known_mule_payee": flag(23), "purpose": purpose})


_W = sg.APP_WEIGHTS
_SCAM = f"""si AS (SELECT tx_id, (tx_id % 2 = 0) AS nw, tx_id % 7 AS ratio, tx_id % 3 = 0 AS first, (tx_id % 4) / 4.0::DOUBLE AS purpose_risk, tx_id % 11 = 0 AS call, tx_id % 17 = 0 AS remote, CASE WHEN tx_id % 6 = 0 THEN -1 ELSE tx_id % 2000 END AS sess,
  tx_id % 9 = 4 AS weak, CASE tx_id % 5 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'CLOSE' WHEN 2 THEN 'UNKNOWN' ELSE 'MATCH' END AS cop, CASE WHEN tx_id % 8 > 0 THEN tx_id % 200 END AS age, tx_id % 23 = 0 AS mule FROM t),
sp AS (SELECT *, CASE WHEN nw AND ratio >= 3 THEN {_W['new_payee_high']} ELSE 0 END AS p1, CASE WHEN nw AND first THEN {_W['first_large']} ELSE 0 END AS p2, {_W['purpose']} * purpose_risk AS p3, CASE WHEN nw AND call THEN {_W['active_call']} ELSE 0 END AS p4,
  CASE WHEN remote THEN {_W['remote_access']} ELSE 0 END AS p5, CASE WHEN nw AND sess >= 900 THEN {_W['long_session']} ELSE 0 END AS p6, CASE WHEN nw AND weak THEN {_W['vulnerable']} ELSE 0 END AS p7, CASE WHEN cop = 'NO_MATCH' THEN {_W['cop_no_match']} ELSE 0 END AS p8,
  CASE WHEN cop = 'CLOSE' THEN {_W['cop_close']} ELSE 0 END AS p9, CASE WHEN age < 90 THEN {_W['young_payee']} ELSE 0 END AS p10, CASE WHEN mule THEN {_W['mule_payee']} ELSE 0 END AS p11 FROM si),
ss AS (SELECT *, (1 - {" * ".join(f"(1 - p{i}::DOUBLE)" for i in range(1, 12))}) * CASE WHEN NOT nw AND cop <> 'NO_MATCH' THEN 0.3 ELSE 1 END AS raw FROM sp)"""
_CODES = ["NEW_PAYEE_HIGH", "FIRST_LARGE", "URGENT_TEXT", "ACTIVE_CALL", "REMOTE_ACCESS", "LONG_SESSION", "VULNERABLE", "COP_NO_MATCH", "COP_CLOSE", "YOUNG_PAYEE", "MULE_PAYEE"]


@query(f"""WITH {ORDER_TX}, {_SCAM} SELECT tx_id, round(round(raw, 4), 3) AS app_score, concat_ws(',', {", ".join(f"CASE WHEN p{i + 1} > 0 THEN 'APP_{c}' END" for i, c in enumerate(_CODES))}) AS patterns,
  CASE WHEN round(raw, 4) >= 0.5 THEN CASE WHEN tx_id % 13 = 0 THEN 'authority' WHEN tx_id % 13 = 1 THEN 'investment' WHEN remote THEN 'remote' WHEN call THEN 'call' WHEN cop = 'NO_MATCH' THEN 'cop' ELSE 'default' END END AS warning FROM ss""")
def i03_scam_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, score and warning (i04), with the age of the payee's account (i05)."""
    s = sg.scam_signal(scam_inputs(order_tx(spark, sf_dir)))
    return s.select("tx_id", F.round("app_score", 3).alias("app_score"), F.array_join("app_patterns", ",").alias("patterns"), F.col("app_warning").alias("warning"))


_REPORTS = "rp AS (SELECT 'iban' AS kind, s_suppkey::VARCHAR AS v, 'bank' || (s_suppkey % 3) AS bank FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'device', p_partkey::VARCHAR, 'bank' || (p_partkey % 4) FROM part WHERE p_partkey % 50 = 0)"


@query(f"""WITH {ORDER_TX}, {_REPORTS}, h AS (SELECT t.tx_id, kind, bank FROM t JOIN rp ON (kind = 'iban' AND v = payee) OR (kind = 'device' AND v = device) WHERE bank <> 'bank0')
SELECT t.tx_id, CASE WHEN count(*) FILTER (WHERE kind = 'iban') > 0 THEN 1.0 WHEN count(kind) > 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS consortium_score, coalesce(string_agg(DISTINCT bank, ',' ORDER BY bank), '') AS banks FROM t LEFT JOIN h USING (tx_id) GROUP BY t.tx_id""")
def i07_consortium(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as tx

    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    key = lambda kind, c: tx.digest(kind, F.col(c).cast("string"), "salt").alias("digest")
    reports = s.where("s_suppkey % 7 = 0").select(key("iban", "s_suppkey"), F.concat(F.lit("bank"), (F.col("s_suppkey") % 3).cast("string")).alias("bank")).union(p.where("p_partkey % 50 = 0").select(key("device", "p_partkey"), F.concat(F.lit("bank"), (F.col("p_partkey") % 4).cast("string")).alias("bank")))
    out = sg.consortium_signal(order_tx(spark, sf_dir), reports, "salt", "bank0")
    return out.select("tx_id", "consortium_score", F.array_join("banks", ",").alias("banks"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40th customer and every 15th account."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 40 = 0").select(F.concat(F.lit("C:"), "c_custkey").alias("n"))
    return c.union(table(spark, sf_dir, "supplier").where("s_suppkey % 15 = 0").select(F.concat(F.lit("A:"), "s_suppkey")))


@query(f"WITH {ORDER_TX} SELECT tx_id, coalesce(payee <> '' AND (payee::BIGINT % 15 = 0 OR payee::BIGINT % 40 = 0), false)::INT::DOUBLE AS graph_known_mule_payee FROM (SELECT tx_id, payee, nullif(payee, '') AS p FROM t) WHERE payee = '' UNION ALL SELECT tx_id, (payee::BIGINT % 15 = 0 OR payee::BIGINT % 40 = 0)::INT::DOUBLE FROM t WHERE payee <> ''".replace("payee <> '' AND (payee::BIGINT % 15 = 0 OR payee::BIGINT % 40 = 0)", "FALSE", 1))
def g05_known_mule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.known_mule(order_tx(spark, sf_dir), owners(spark, sf_dir), flagged(spark, sf_dir))


@query(f"WITH {EVENT_TX} SELECT a.tx_id, (count(b.tx_id) > 0)::INT::DOUBLE AS shared_fraud_device FROM t a LEFT JOIN t b ON b.device = a.device AND b.cust <> a.cust AND b.cust % 40 = 0 AND (b.us < a.us OR (b.us = a.us AND b.tx_id < a.tx_id)) GROUP BY a.tx_id")
def g06_shared_fraud_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_tx(spark, sf_dir)
    f = t.select("cust").distinct().where("cust % 40 = 0").select(F.concat(F.lit("C:"), F.col("cust").cast("string")).alias("n"))
    return sg.shared_fraud_device(t, f)


_MONTH = 30 * fr.DAY
_BEFORE = "(b.us < a.us OR (b.us = a.us AND b.tx_id < a.tx_id))"


@query(f"WITH {ORDER_TX}, {OWNERS} SELECT a.tx_id, count(b.tx_id) > 0 AS has_inflow FROM t a LEFT JOIN own ON own.owner = a.cust LEFT JOIN t b ON b.payee = own.payee AND b.cust <> a.cust AND b.us >= a.us - {_MONTH} AND {_BEFORE} GROUP BY a.tx_id")
def g10_has_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.has_inflow(order_tx(spark, sf_dir), owners(spark, sf_dir), _MONTH)


@query("WITH r AS (SELECT s_suppkey AS k, round(s_suppkey * 37 % 91 / 1000.0::DOUBLE, 12) AS rank FROM supplier) SELECT 'A:' || k AS node, round((SELECT count(*) FROM r b WHERE b.rank <= r.rank) / (SELECT count(*) FROM r), 9) AS percentile FROM r")
def g07_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of ranks among accounts (g11's second half)."""
    k = F.col("s_suppkey")
    ranks = table(spark, sf_dir, "supplier").select(F.concat(F.lit("A:"), k).alias("node"), (k * 37 % 91 / 1000.0).alias("rank"))
    ranks = ranks.union(table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey"), F.lit(0.5)))
    return sg.percentile_ranks(ranks).select("node", F.round("percentile", 9).alias("percentile"))


@query(f"""WITH {ORDER_TX}, s AS (SELECT tx_id, tx_id % 7 = 0 AS mule, (tx_id % 11) / 10.0::DOUBLE AS ratio, tx_id % 4 AS fan_in, tx_id % 13 = 0 AS cyc, tx_id % 17 = 0 AS shared, CASE tx_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS dist, (tx_id % 10) / 10.0::DOUBLE AS central FROM t)
SELECT tx_id, round(round(1 - (1 - CASE WHEN mule THEN 0.9 ELSE 0 END::DOUBLE) * (1 - CASE WHEN ratio >= 0.7 AND fan_in >= 1 THEN 0.6 * least(1, ratio) ELSE 0 END) * (1 - CASE WHEN cyc THEN 0.6 ELSE 0 END::DOUBLE) * (1 - CASE WHEN shared THEN 0.7 ELSE 0 END::DOUBLE)
  * (1 - CASE dist WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END::DOUBLE) * (1 - CASE WHEN central >= 0.8 THEN 0.3 ELSE 0 END::DOUBLE), 4), 3) AS graph_score FROM s""")
def g08_graph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tx_id")
    score = gr.graph_score(k % 7 == 0, F.least(F.lit(1.0), (k % 11) / 10.0), k % 4, k % 13 == 0, k % 17 == 0, F.when(k % 5 == 0, 1).when(k % 5 == 1, 2), (k % 10) / 10.0)
    return order_tx(spark, sf_dir).select("tx_id", F.round(score, 3).alias("graph_score"))


@query(f"""WITH {ORDER_TX}, {OWNERS}, m AS (SELECT DISTINCT cust, cust % 50 AS community FROM t), i AS (SELECT DISTINCT own.owner AS cust FROM t JOIN own USING (payee) JOIN m a ON a.cust = t.cust JOIN m b ON b.cust = own.owner WHERE a.community = b.community AND t.cust <> own.owner),
d AS (SELECT device FROM (SELECT DISTINCT cust, device FROM t WHERE device <> '') GROUP BY device HAVING count(*) >= 2), s AS (SELECT DISTINCT cust FROM t JOIN d USING (device))
SELECT m.cust::VARCHAR AS cust, community::VARCHAR AS community, m.cust NOT IN (SELECT cust FROM i) AND m.cust NOT IN (SELECT cust FROM s) AND m.cust % 40 <> 0 AS affected FROM m""")
def g15_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_tx(spark, sf_dir)
    labels = t.select("cust").distinct().select(F.concat(F.lit("C:"), F.col("cust").cast("string")).alias("node"), (F.col("cust") % 50).cast("string").alias("community"))
    return sg.affected(t, owners(spark, sf_dir), labels, flagged(spark, sf_dir))


@query(f"WITH {ORDER_TX} SELECT cust, payee, count(*)::BIGINT AS n, round(sum(amount), 2) AS total FROM (SELECT * FROM t WHERE payee <> '' AND us >= (SELECT max(us) FROM t) - {200 * fr.DAY} ORDER BY us, tx_id LIMIT 200000) GROUP BY ALL")
def g18_rebuilt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph as rebuilt from the newest days of the table, oldest first, 200,000 payments at most."""
    t = order_tx(spark, sf_dir)
    last = t.agg(F.max("us").alias("last"))
    few = t.crossJoin(F.broadcast(last)).where((F.col("payee") != "") & (F.col("us") >= F.col("last") - 200 * fr.DAY)).orderBy("us", "tx_id").limit(200_000)
    return few.groupBy("cust", "payee").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


_VEC = ["amount_z", "hour_sin", "hour_cos", "velocity", "payees", "typing", "login", "new_device", "new_payee", "shared_device"]


@query(f"""WITH {ORDER_TX}, f AS (SELECT tx_id, tx_id % 24 AS hour, (tx_id % 130) / 10.0::DOUBLE - 4 AS z, tx_id % 30 AS c, tx_id % 12 AS p, (tx_id % 100) / 10.0::DOUBLE AS ty, CASE WHEN tx_id % 5 = 0 THEN -1 ELSE tx_id % 4000 END AS login, tx_id % 2 AS nd, tx_id % 3 % 2 AS np, tx_id % 7 AS du FROM t)
SELECT tx_id, round(greatest(0, least(1, (z + 3) / 9)), 9) AS amount_z, round(0.5 + 0.5 * sin(2 * pi() * hour / 24), 9) AS hour_sin, round(0.5 + 0.5 * cos(2 * pi() * hour / 24), 9) AS hour_cos, round(least(1, c / 20), 9) AS velocity, round(least(1, p / 10), 9) AS payees,
  round(least(1, ty / 8), 9) AS typing, round(CASE WHEN login < 0 THEN 0.5 ELSE least(1, ln(1 + login) / ln(3601)) END, 9) AS login, nd::DOUBLE AS new_device, np::DOUBLE AS new_payee, round(greatest(0, least(1, (du - 1) / 4)), 9) AS shared_device FROM f""")
def h11_behaviour_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("tx_id")
    f = {"hour": k % 24, "amount_zscore": (k % 130) / 10.0 - 4, "cnt_1h": k % 30, "distinct_payees_24h": k % 12, "typing_deviation": (k % 100) / 10.0, "login_to_transfer_s": F.when(k % 5 == 0, -1).otherwise(k % 4000), "is_new_device": (k % 2).cast("double"), "is_new_payee": (k % 3 % 2).cast("double"), "device_customers_7d": k % 7}
    return order_tx(spark, sf_dir).select("tx_id", *(F.round(c.cast("double"), 9).alias(n) for n, c in sg.behaviour_vector(f).items()))


_GROUPS = {f"f{i}": ("amount", "velocity", "device", "network")[i % 4] for i in range(12)}


@query(f"""WITH {ORDER_TX}, {_CONTRIB}, g AS (SELECT *, CASE WHEN feature IN ('f12', 'f13') THEN 'external' ELSE ['amount', 'velocity', 'device', 'network'][(substr(feature, 2)::INT % 4 + 1)] END AS grp FROM c WHERE value > 0),
s AS (SELECT tx_id, grp, sum(value) AS s, arg_max(feature, (value, feature)) AS top_feature FROM g GROUP BY ALL) SELECT tx_id, grp AS "group", round(1 - exp(-s), 6) AS weight, top_feature FROM s WHERE s >= 0.05""")
def f17_ml_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rl.ml_reasons(contributions(spark, sf_dir), _GROUPS)
    return out.select("tx_id", "group", F.round("weight", 6).alias("weight"), "top_feature")


_ROUNDS, _EPOCHS = 2, 2
_FED = "x0 AS (SELECT tx_id % 3 AS bank, (status = 'F')::INT AS y, amount / 500000 AS a, (tx_id % 10) / 10.0::DOUBLE AS b FROM t), w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc)"
for _r in range(_ROUNDS):
    _FED += f", l{_r}_0 AS (SELECT DISTINCT bank, wa, wb, wc FROM x0, w{_r})"
    for _e in range(_EPOCHS):
        _FED += f", l{_r}_{_e + 1} AS (SELECT bank, any_value(wa) - 0.5 * avg(m * a) AS wa, any_value(wb) - 0.5 * avg(m * b) AS wb, any_value(wc) - 0.5 * avg(m) AS wc FROM (SELECT x0.*, wa, wb, wc, 1 / (1 + exp(-(a * wa + b * wb + wc))) - y AS m FROM x0 JOIN l{_r}_{_e} USING (bank)) GROUP BY bank)"
    _FED += f", w{_r + 1} AS (SELECT sum(wa * n) / sum(n) AS wa, sum(wb * n) / sum(n) AS wb, sum(wc * n) / sum(n) AS wc FROM l{_r}_{_EPOCHS} JOIN (SELECT bank, count(*) AS n FROM x0 GROUP BY bank) USING (bank))"


@query(f"WITH {ORDER_TX}, {_FED} SELECT round(wa, 6) AS a, round(wb, 6) AS b, round(wc, 6) AS intercept FROM w{_ROUNDS}")
def i08_federated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_tx(spark, sf_dir).select((F.col("tx_id") % 3).alias("bank"), (F.col("status") == "F").cast("int").alias("y"), (F.col("amount") / 500_000).alias("a"), ((F.col("tx_id") % 10) / 10.0).alias("b"))
    w = sg.federated_average(rows, ["a", "b"], rounds=_ROUNDS, epochs=_EPOCHS)
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "a double, b double, intercept double")


@query(f"""WITH {EVENT_TX}, e AS (SELECT cust AS tx_id, us, CASE WHEN tx_id % 3 = 0 THEN 'consume' ELSE 'issue' END AS kind FROM t), w AS (SELECT *, max(us) FILTER (WHERE kind = 'issue') OVER p AS i, max(us) FILTER (WHERE kind = 'consume') OVER p AS c FROM e WINDOW p AS (PARTITION BY tx_id ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT tx_id, us, coalesce(i IS NOT NULL AND us <= i + {fr.DAY // 2} AND (c IS NULL OR c < i), false) AS accepted FROM w WHERE kind = 'consume'""")
def n16_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_tx(spark, sf_dir).select(F.col("cust").alias("tx_id"), "us", F.when(F.col("tx_id") % 3 == 0, "consume").otherwise("issue").alias("kind"))
    return sg.challenges(e, fr.DAY // 2)


@query()
def g22_step_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graphs import _steps

    return sg.step_graph(*_steps(spark, sf_dir)).withColumn("scaled_rank", F.round("scaled_rank", 6))

"""Queries of learned scores with their reasons, and of the online signal, over the features of the pass itself."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import frames as fr
from ..operators import known as kn
from ..operators import livegraph as lg
from ..operators import models as md
from ..operators import online as on
from ..operators import profile as pf
from ..operators import protocols as pr
from ..operators import registry as rg
from ..operators import rules as rl
from ..operators import scoring as sc
from ..operators import signals as sg
from ..operators import sketch as sk
from ..operators import trees as tr
from ..storage import materialise, shared_dir
from ..streaming import monitor as mo
from ..streaming import stateful as sf
from ..streaming import streams as st
from .features import ORACLES as FEATURE_SQL
from .features import f22_decisions
from .full import payments, surroundings
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DECISIONS_SQL = FEATURE_SQL["f22_decisions"]

#: What the model sees: nothing of the channel, which is the label.
COLUMNS = {
    "amount_try": "amount", "near_threshold": "amount", "amount_ratio": "amount", "amount_zscore": "amount",
    "cnt_1h": "velocity", "cnt_24h": "velocity", "sum_24h": "velocity", "time_since_last_s": "velocity",
    "distinct_payees_24h": "payee", "is_new_payee": "payee", "payee_fan_in_24h": "payee",
    "device_customers_7d": "device", "is_new_device": "device",
    "hour": "time", "is_night": "time",
}
_OF_PROFILE = ("amount_ratio", "amount_zscore", "is_new_device", "typing_deviation")
_READ = ("tx_id", "us", "cust", "amount", "channel", "payee", "device", "trusted", "avg_amount", "typing")


def query(f):
    QUERIES[f.__name__] = f
    return f


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, us, the model's features, what the online signal reads, trusted, and y: the event is an error."""
    plain = [c for c in (*COLUMNS, "distinct_payees_24h") if c not in _OF_PROFILE]
    t = materialise(payments(spark, sf_dir).select(*_READ, ft.session_number("login_to_transfer_s").alias("login_to_transfer_s")), "payments")
    # a customer's profile is the last of the histories and goes beside them, so that nothing is joined
    x = ft.features(t, list(dict.fromkeys(plain)), keep=(*_READ, "login_to_transfer_s"))
    kept = ["tx_id", "us", "trusted", *dict.fromkeys(plain), "login_to_transfer_s"]
    x = pf.profile_features(x, _OF_PROFILE, keep=(*kept, "channel"))
    return materialise(x.withColumn("y", (F.col("channel") == "error").cast("int")).drop("channel"), "model-rows")


def fitted(x: DataFrame):
    """A model fitted on the first 70 % by time, its paths and its scores."""
    split = ev.row_split(x, ["us", "tx_id"])
    train = split.where("part = 'train'")
    model = md.boosted_model(train, list(COLUMNS), rounds=10, depth=4)
    return model, tr.paths(tr.nodes(model)), split


@query
def j06_tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the log-odds of every event."""
    x = rows(spark, sf_dir)
    _, of, _ = fitted(x)
    return tr.contributions(x, of, list(COLUMNS)).select("tx_id", "feature", F.round("value", 9).alias("value"))


@query
def f17_model_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the fitted model, by group of features."""
    x = rows(spark, sf_dir)
    _, of, _ = fitted(x)
    out = rl.row_reasons(tr.attributed(x, of, list(COLUMNS)), list(COLUMNS), COLUMNS)
    return out.select("tx_id", "group", F.round("weight", 6).alias("weight"), "top_feature")


def online(x: DataFrame) -> DataFrame:
    vector = sg.behaviour_vector({c: F.col(c) for c in ("hour", "amount_zscore", "cnt_1h", "distinct_payees_24h", "typing_deviation", "login_to_transfer_s", "is_new_device", "is_new_payee", "device_customers_7d")})
    v = x.select("tx_id", "us", "trusted", *(c.alias(n) for n, c in vector.items()))
    return on.half_space_scores(v, list(vector), trusted=F.col("trusted"))


@query
def i06_online_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online anomaly of every event, learned from trusted events before it."""
    return online(rows(spark, sf_dir)).select("tx_id", F.round("raw", 9).alias("raw"), F.round("online_score", 9).alias("online_score"), "ready")


@query
def f22_learned_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full pass with a fitted model's score, a calibrated anomaly and the online signal, each with its reasons."""
    columns = list(COLUMNS)
    t = materialise(payments(spark, sf_dir), "payments")
    # the histories serve the model, the online signal and the pass, so they are made once
    x = materialise(sc.histories(t, ["channel", "trusted", "unknown_customer"]).withColumn("y", (F.col("channel") == "error").cast("int")).drop("channel"), "histories")
    model, of, split = fitted(x.select("tx_id", "us", "y", *columns))
    train = split.where("part = 'train'")
    forest = md.grown_forest(train, columns, trees=50)
    points = md.quantile_points(md.forest_scores(train.select("tx_id", *columns), forest, columns), "anomaly")
    seen = online(x).select("tx_id", "online_score")
    every = sc.observed(t, surroundings(spark, sf_dir), fr.beside(x.drop("y", "trusted"), seen))
    # what a model says of a payment is told beside it, after the joins
    every = md.boosted_scores(model, every, columns).withColumnRenamed("p", "ml_score").withColumns({"_anomaly": md.forest_column(forest, columns), "_phi": tr.attribution(of, columns)})
    out = sc.decided(every.withColumn("anomaly_score", md.calibrated(F.col("_anomaly"), points)))
    shown = rl.shown_reasons(out.withColumn("reasons", _reasons()))
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    return shown.select("tx_id", "decision", F.round("risk_score", 4).alias("risk_score"), F.round("ml_score", 6).alias("ml_score"), F.round("anomaly_score", 4).alias("anomaly_score"), F.round("online_score", 4).alias("online_score"), codes.alias("reasons"), "case_required")


def _reasons() -> Column:
    """All reasons of a decided payment: of rules, of the model by group, of the policy, and of the online signal from 0.5 on."""
    reason = lambda code, source, weight: F.struct(code.alias("code"), F.lit(source).alias("source"), weight.alias("weight"))
    rules = F.transform("rule_hits", lambda h: reason(h["id"], "rule", h["score"]))
    model = F.transform(rl.group_reasons("_phi", list(COLUMNS), COLUMNS), lambda r: reason(F.concat(F.lit("ML_"), F.upper(r["group"])), "ml", r["weight"]))
    policy = F.transform(F.filter("overrides", lambda c: ~c.isin("RULE_FLOOR", "RULE_FLOOR_SOFTENED")), lambda c: reason(c, "policy", F.lit(1.0)))
    signal = F.filter(F.array(reason(F.lit("ONLINE_ANOMALY"), "signal", F.col("online_score") * on.REASON_WEIGHT)), lambda _: F.col("online_score") >= 0.5)
    return F.concat(rules, model, policy, signal)


#: The model's features by part, for protocols that compare sets of them.
_SETS = {"amount": [c for c, g in COLUMNS.items() if g == "amount"], "velocity": [c for c, g in COLUMNS.items() if g == "velocity"], "all": list(COLUMNS)}


@query
def j35_temporal_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of features over days: fitted on the first twenty, thresholds from expanding windows inside them, told on the rest."""
    x = rows(spark, sf_dir)
    start = x.agg(F.min("us")).first()[0] or 0
    x = x.withColumn("step", F.expr(f"(us - {start}) div {fr.DAY} + 1").cast("int"))
    return pr.temporal_protocol(x, _SETS, "step", 20, [(9, 12), (13, 16), (17, 20)], pr.boosted(rounds=5, depth=3), order=["us", "tx_id"])


@query
def q20_expanding_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rows(spark, sf_dir)
    start = x.agg(F.min("us")).first()[0] or 0
    x = x.withColumn("step", F.expr(f"(us - {start}) div {fr.DAY} + 1").cast("int"))
    return pr.expanding_predictions(x, list(COLUMNS), "step", [(9, 16), (17, 24), (25, 31)], pr.boosted(rounds=5, depth=3)).select("tx_id", "step", "fitted_to", F.round("p", 6).alias("p"))


@query
def j33_feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model refitted without each group of features."""
    split = ev.row_split(rows(spark, sf_dir), ["us", "tx_id"])
    groups = {g: [c for c, k in COLUMNS.items() if k == g] for g in dict.fromkeys(COLUMNS.values())}
    return pr.feature_ablation(split.where("part = 'train'"), split.where("part = 'test'"), list(COLUMNS), groups, pr.boosted(rounds=5, depth=3))


@query
def j36_learned_only_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned scores alone on the last part of all events: boosted trees, anomaly and both stacked, told with intervals."""
    x = rows(spark, sf_dir).withColumn("amount", F.col("amount_try").cast("double"))
    return pr.learned_only_protocol(pr.learned_layers(x, list(COLUMNS), ["us", "tx_id"], trees=5, depth=3), ["us", "tx_id"])


def _feedback(decisions: DataFrame) -> DataFrame:
    """Of decisions other than ALLOW two in three hear of their outcome, up to ten days later: a failed event was fraud."""
    k = F.col("tx_id")
    return decisions.where("decision <> 'ALLOW' and tx_id % 3 > 0").select("tx_id", (F.col("us") + k % 11 * fr.DAY + 1).alias("us"), "cust", F.when(F.col("channel") == "error", "fraud").otherwise("trusted").alias("label"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f22_decisions(spark, sf_dir).select("tx_id", "decision")
    return materialise(event_tx(spark, sf_dir).join(d, "tx_id").select("tx_id", "us", "cust", "amount", "channel", "device", F.lit(None).cast("double").alias("typing"), "decision"), "decided")


_OUTCOMES = f"""SELECT t.tx_id, 'event' AS kind, CASE WHEN d.decision = 'ALLOW' THEN 'learned' ELSE 'pending' END AS outcome FROM t JOIN d USING (tx_id)
UNION ALL SELECT t.tx_id, 'feedback', CASE WHEN t.tx_id % 11 * {fr.DAY} + 1 > {sf.PENDING_US} THEN 'refused' WHEN channel = 'error' THEN 'forgotten' ELSE 'taught' END FROM t JOIN d USING (tx_id) WHERE d.decision <> 'ALLOW' AND t.tx_id % 3 > 0"""


@query
def h06_late_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles that learn allowed events at once and others when feedback confirms them."""
    d = _decided(spark, sf_dir)
    out = sf.late_learning(d, _feedback(d))
    return out.select("tx_id", "kind", "outcome", F.round("amount_ratio", 6).alias("amount_ratio"), F.round("amount_zscore", 6).alias("amount_zscore"), "is_new_device", "n")


@query
def h07_pending_feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event and each feedback came to, kept as keyed state of a stream."""
    d = _decided(spark, sf_dir)
    f = materialise(_feedback(d), "feedback")

    def stream(df: DataFrame) -> DataFrame:
        folder = df.inputFiles()[0].rsplit("/", 1)[0]
        return spark.readStream.schema(df.schema).parquet(folder).withColumn("ts", F.timestamp_micros("us"))

    if d.isEmpty() or f.isEmpty():
        return sf.late_learning(d, f).select("tx_id", "kind", "outcome")
    return sf.drained(lambda: sf.late_learning_stream(stream(d), stream(f)), spark).select("tx_id", "kind", "outcome")


ORACLES["h07_pending_feedback_stream"] = f"WITH {EVENT_TX}, d AS (SELECT tx_id, decision FROM ({DECISIONS_SQL})) {_OUTCOMES}"


@query
def j02_sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity and payee features of the events that the watermark has passed, from a stream."""
    t = st.event_stream(spark, sf_dir).select("ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("tx_id"), F.col("user_id").alias("cust"), F.col("value").alias("amount"), F.get_json_object("props", "$.k").alias("payee"))
    out = sf.drained(lambda: sf.sliding_features_stream(t), spark)
    return out.select("tx_id", *(f"cnt_{w}" for w in sf.WIDTHS), *(F.round(f"sum_{w}", 4).alias(f"sum_{w}") for w in sf.WIDTHS), "distinct_payees_24h", "distinct_payees_7d", "time_since_last_s")


_PAST = "p.cust = t.cust AND (p.us < t.us OR (p.us = t.us AND p.tx_id < t.tx_id))"
ORACLES["j02_sliding_stream"] = (
    f"WITH {EVENT_TX} SELECT t.tx_id, "
    + ", ".join(f"count(p.tx_id) FILTER (WHERE p.us > t.us - {w})::DOUBLE AS cnt_{n}, round(coalesce(sum(p.amount) FILTER (WHERE p.us > t.us - {w}), 0), 4) AS sum_{n}" for n, w in sf.WIDTHS.items())
    + ", "
    + ", ".join(f"count(DISTINCT p.payee) FILTER (WHERE p.us > t.us - {w} AND p.payee <> '')::DOUBLE AS distinct_payees_{n}" for n, w in (("24h", fr.DAY), ("7d", fr.WEEK)))
    + f", coalesce((t.us - max(p.us)) / 1e6, 604800.0) AS time_since_last_s FROM t LEFT JOIN t p ON {_PAST} AND p.us > t.us - {fr.WEEK}"
    + f" WHERE t.us <= (SELECT max(us) FROM t) // 1000 * 1000 - {fr.HOUR} GROUP BY t.tx_id, t.us"
)


@query
def h17_known_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half arrive, some for the second time and some of those changed; a filter for each day goes before the exact check."""
    t = event_tx(spark, sf_dir).select("tx_id", "us", "amount")
    digest = lambda amount: F.sha2(F.concat_ws("|", F.col("tx_id").cast("string"), amount.cast("decimal(18,2)").cast("string")), 256).alias("digest")
    known = materialise(t.where("tx_id % 10 < 7").select("tx_id", "us", digest(F.col("amount"))), "known")
    filters = materialise(kn.bloom_filters(known, "tx_id", F.expr(f"us div {fr.WEEK}")), "known-filters")
    arrivals = t.where("tx_id % 10 > 4").select("tx_id", digest(F.col("amount") + F.when(F.col("tx_id") % 17 == 0, 1).otherwise(0)))
    return kn.fates(arrivals, known, filters).select("tx_id", "fate")


ORACLES["h17_known_arrivals"] = f"WITH {EVENT_TX} SELECT tx_id, CASE WHEN tx_id % 10 >= 7 THEN 'new' WHEN tx_id % 17 = 0 THEN 'conflict' ELSE 'duplicate' END AS fate FROM t WHERE tx_id % 10 > 4"


@query
def g01_observed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph after three increments of payments that came out of order, over the newest two hundred days."""
    t = order_tx(spark, sf_dir)
    state = lg.empty(spark)
    for k in (1, 2, 0):
        state = lg.observe(state, t.where(F.col("tx_id") % 3 == k), 200)
    return state.edges().select("a", "b", "n", F.round(F.col("total").cast("double"), 2).alias("total"), "last_us")


ORACLES["g01_observed_graph"] = f"""WITH {ORDER_TX}, e AS (
  SELECT 'C:' || cust AS a, 'A:' || payee AS b, amount, us FROM t WHERE payee <> '' UNION ALL SELECT 'C:' || cust, 'D:' || device, 0, us FROM t WHERE device IS NOT NULL AND device::VARCHAR <> '')
SELECT a, b, count(*)::BIGINT AS n, round(sum(amount::DECIMAL(28,8))::DOUBLE, 2) AS total, max(us) AS last_us FROM e WHERE us // {fr.DAY} >= (SELECT max(us // {fr.DAY}) FROM e) - 200 GROUP BY a, b"""


@query
def g09_mended_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of events' customers, accounts and devices, mended after each of four increments with a window of five days."""
    t = event_tx(spark, sf_dir)
    state = lg.empty(spark)
    for k in (2, 0, 3, 1):
        state = lg.observe(state, t.where(F.col("tx_id") % 4 == k), 5)
    return state.labels


@query
def j39_population_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each feature of a day differs from the population of the first twenty, by sketches of days that are added up."""
    x = rows(spark, sf_dir)
    start = x.agg(F.min("us")).first()[0] or 0
    days = materialise(sk.sketches(x.withColumn("day", F.expr(f"(us - {start}) div {fr.DAY}")), list(COLUMNS), ["day"]), "sketches")
    reference = sk.merged(days.where("day < 20"))
    return sk.drift(reference, days.where("day >= 20"), ["day"]).select("day", "name", F.round("psi", 6).alias("psi"))


@query
def j39_day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the amounts of each day."""
    return sk.sketches(event_tx(spark, sf_dir).withColumn("day", F.expr(f"us div {fr.DAY}")), ["amount"], ["day"])


ORACLES["j39_day_sketches"] = f"WITH {EVENT_TX} SELECT us // {fr.DAY} AS day, 'amount' AS name, CASE WHEN abs(amount) < {sk.LEAST} THEN 0 ELSE sign(amount)::BIGINT * (ceil(round(ln(greatest(abs(amount), {sk.LEAST})) / {math.log(sk._G)!r}, 9))::BIGINT + {sk._OFFSET}) END AS bucket, count(*)::BIGINT AS n FROM t WHERE amount IS NOT NULL AND NOT isnan(amount) GROUP BY ALL"


@query
def j15_champion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the champion as the registry gives it back: fitted on the first 70 % by time, registered and promoted."""
    x = rows(spark, sf_dir)
    model, _, split = fitted(x)
    train = split.where("part = 'train'").select("tx_id", *COLUMNS)
    forest = md.grown_forest(train, list(COLUMNS), trees=20)
    knots = md.quantile_points(md.forest_scores(train, forest, list(COLUMNS)), "anomaly")
    registry = rg.Registry(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}")
    registry.register("v1", rg.Bundle(model, list(COLUMNS), forest, knots, dict(zip(("ml_score", "anomaly_score"), sc.STACKER[1:], strict=True)), sc.INTERCEPT, {}), {"rows": train.count()})
    registry.promote("v1")
    champion = registry.load_role("champion")
    return champion.stacked(champion.scores(x)).select("tx_id", F.round("ml_score", 6).alias("ml_score"), F.round("anomaly_score", 6).alias("anomaly_score"), F.round("stacked", 6).alias("stacked"))


@query
def q28_state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers the state of a stopped stream holds, read from its store, and the files it has not taken."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = st.running_profiles(st.event_stream(spark, sf_dir))
    s.writeStream.outputMode("update").option("checkpointLocation", base).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.format("noop").mode("overwrite").save()).start().awaitTermination()
    return mo.state_keys(spark, base).agg(F.sum("keys").alias("keys"))


ORACLES["q28_state_keys"] = "SELECT count(DISTINCT user_id)::BIGINT AS keys FROM events"

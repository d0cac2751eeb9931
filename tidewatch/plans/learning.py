"""Queries of learned scores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import models as md
from ..streaming import streams as st
from .tables import EVENT_TX, event_tx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COLUMNS = ["amount_try", "cnt_24h", "sum_24h", "is_night", "payee_fan_in_24h"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, none of which tells the channel, and y: the event is an error."""
    e = event_tx(spark, sf_dir)
    return ft.features(e, COLUMNS, keep=("tx_id", "us")).join(e.select("tx_id", (F.col("channel") == "error").cast("int").alias("y")), "tx_id")


@query()
def j05_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the first 70 % by time; scores of the events after those."""
    split = ev.row_split(_rows(spark, sf_dir), ["us", "tx_id"])
    score, _ = md.boosted_trees(split.where("part = 'train'"), COLUMNS, rounds=5, depth=3)
    return score(split.where("part <> 'train'")).select("tx_id", "part", "y", F.round("p", 6).alias("p"))


@query()
def j07_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the gain each feature of the fitted model has."""
    split = ev.row_split(_rows(spark, sf_dir), ["us", "tx_id"])
    _, gain = md.boosted_trees(split.where("part = 'train'"), COLUMNS, rounds=5, depth=3)
    return spark.createDataFrame([(k, round(v, 5)) for k, v in gain.items()], "feature string, gain double")


@query()
def j08_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return md.isolation_forest(rows, COLUMNS)(rows.select("tx_id", *COLUMNS)).select("tx_id", F.round("anomaly", 6).alias("anomaly"))


@query(f"""WITH {EVENT_TX}, s AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS i, count(*) OVER () AS n FROM t), p AS (SELECT k, (n - 1) * (k / 200::DOUBLE) AS pos FROM (SELECT unnest(range(201)) AS k), (SELECT DISTINCT n FROM s)),
q AS (SELECT k, CASE WHEN a.amount = b.amount THEN a.amount ELSE (ceil(pos) - pos) * a.amount + (pos - floor(pos)) * b.amount END AS v FROM p JOIN s a ON a.i = floor(pos) JOIN s b ON b.i = ceil(pos)), l AS (SELECT list(v ORDER BY k) AS knots FROM q),
b AS (SELECT tx_id, amount, knots, len(list_filter(knots, lambda x: x <= amount)) AS below FROM t, l)
SELECT tx_id, round(CASE WHEN below = 0 THEN 0 WHEN below > 200 THEN 1 ELSE (below - 1 + CASE WHEN knots[below + 1] > knots[below] THEN (amount - knots[below]) / (knots[below + 1] - knots[below]) ELSE 0 END) / 200 END, 6) AS percentile FROM b""")
def j10_calibrated_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_tx(spark, sf_dir)
    return rows.select("tx_id", F.round(md.calibrated(F.col("amount"), md.quantile_points(rows, "amount")), 6).alias("percentile"))


@query()
def j12_stacker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("y", (F.col("amount_try") / 500).alias("rule"), (F.col("cnt_24h") / 10).alias("ml"), F.col("is_night").alias("anomaly"))
    weights, intercept = md.stacker(rows, ["rule", "ml", "anomaly"])
    return spark.createDataFrame([(k, round(v, 4)) for k, v in {**weights, "intercept": intercept}.items()], "input string, weight double")


@query("SELECT event_id, user_id, event_type FROM events")
def n03_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice and is kept once."""
    e = st.event_stream(spark, sf_dir)
    return st.drain(st.deduplicated(e.union(st.event_stream(spark, sf_dir)), "40 days")).select("event_id", "user_id", "event_type")


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 1 HOUR AS b, count(*) AS n, sum(value) AS v FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a)::BIGINT AS start_us, n::BIGINT AS events, round(v, 2) AS volume FROM w WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query(_SESSIONS)
def n13_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    s = st.drain(st.session_counts(st.event_stream(spark, sf_dir)))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "events", F.round("volume", 2).alias("volume"))


@query("SELECT epoch_us(date_trunc('hour', ts))::BIGINT AS start_us, event_type, count(*)::BIGINT AS events FROM events GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def k22_stream_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.drain(st.tumbling_counts(st.event_stream(spark, sf_dir)))
    return s.select(F.unix_micros("start").alias("start_us"), "event_type", "events")


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 2) AS volume, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def n07_stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.drain(st.running_profiles(st.event_stream(spark, sf_dir)), "update")
    best = out.groupBy("user_id").agg(F.max_by(F.struct("n", "volume", "last_id"), "batch").alias("s"))
    return best.select("user_id", "s.n", F.round("s.volume", 2).alias("volume"), "s.last_id")

"""Alerts, cases, clocks, account states, audit chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import frames as fr

CASE_GAP = fr.DAY
#: Account states from mildest to strictest.
STATES = ("AKTIF", "INCELENIYOR", "BLOKE")


def needs_alert(decision: Column, case_required: Column, was_blocked: Column) -> Column:
    return ~F.coalesce(was_blocked, F.lit(False)) & (F.coalesce(case_required, F.lit(False)) | F.coalesce(decision.isin("HOLD", "BLOCK"), F.lit(False)))


def group_cases(alerts: DataFrame, key: str = "cust", gap_us: int = CASE_GAP) -> DataFrame:
    """Adds case_no (from 1 in each key): an alert joins the open case if that was updated at most ``gap_us`` ago."""
    w = fr.ordered([key])
    fresh = F.when(F.col("us") - F.lag("us").over(w) <= gap_us, 0).otherwise(1)
    return alerts.withColumn("_new", fresh).withColumn("case_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def roll_up(alerts: DataFrame, key: str = "cust") -> DataFrame:
    """One row a case: alerts, total amount, priority (sum of risk times amount to cents), strictest type, span."""
    return alerts.groupBy(key, "case_no").agg(F.count("*").alias("alert_count"), F.sum("amount").alias("total"), F.sum(F.round(F.col("risk").cast("decimal(9,6)") * F.col("amount").cast("decimal(18,2)"), 2)).alias("priority"), F.max_by("alert_type", F.struct("type_rank", "alert_type")).alias("case_type"), F.min("us").alias("opened_us"), F.max("us").alias("updated_us"))


def sla_scan(cases: DataFrame, now_us: int, sla_us: int, soon_us: int) -> DataFrame:
    """Open cases, those past their clock, and those about to be."""
    due = F.col("opened_us") + sla_us
    is_open = F.col("status") != "CLOSED"
    return cases.agg(F.count_if(is_open).alias("open"), F.count_if(is_open & (due < now_us)).alias("breached"), F.count_if(is_open & (due >= now_us) & (due < now_us + soon_us)).alias("due_soon"))


def calendar(spark, start: str, end: str, holidays: Sequence[str] = ()) -> DataFrame:
    """day, is_business, n (business days up to and with the day)."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS day")
    free = F.weekday("day").isin(5, 6) | F.col("day").cast("string").isin(*holidays) if holidays else F.weekday("day").isin(5, 6)
    return days.withColumn("is_business", ~free).withColumn("n", F.sum(F.col("is_business").cast("int")).over(W.orderBy("day")))


def add_business_days(df: DataFrame, day: str, days: int, cal: DataFrame) -> DataFrame:
    """Adds ``due``: the business day that many business days after ``day``."""
    at = cal.select(F.col("day").alias(day), (F.col("n") + days).alias("_n"))
    to = cal.where("is_business").select(F.col("n").alias("_n"), F.col("day").alias("due"))
    return df.join(F.broadcast(at), day, "left").join(F.broadcast(to), "_n", "left").drop("_n")


def business_days_between(df: DataFrame, start: str, end: str, cal: DataFrame) -> DataFrame:
    """Adds ``business_days``: those in (start, end]."""
    a, b = cal.select(F.col("day").alias(start), F.col("n").alias("_a")), cal.select(F.col("day").alias(end), F.col("n").alias("_b"))
    return df.join(F.broadcast(a), start, "left").join(F.broadcast(b), end, "left").withColumn("business_days", F.col("_b") - F.col("_a")).drop("_a", "_b")


def account_states(events: DataFrame) -> DataFrame:
    """State after each event (cust, us, tx_id, actor, requested): the system only raises it, an analyst sets it freely.

    An analyst's row begins a segment with its own state; within a segment the
    state is the running maximum.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("requested")) - 1
    w = fr.ordered(["cust"])
    e = events.withColumn("_rank", rank).withColumn("_seg", F.sum((F.col("actor") == "analyst").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    state = F.max("_rank").over(W.partitionBy("cust", "_seg").orderBy("us", "tx_id").rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("_state", state.cast("int"))
    before = F.coalesce(F.lag("_state").over(w), F.lit(0))
    e = e.withColumn("_moved", (F.col("_state") != before).cast("int"))
    return e.withColumn("version", F.sum("_moved").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("status", F.get(F.array(*map(F.lit, STATES)), F.col("_state"))).drop("_rank", "_seg", "_state", "_moved")


def chain_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, payload), 256)


def verify_chain(log: DataFrame, order: str = "id") -> DataFrame:
    """Entries of an audit chain (chain, id, payload, prev_hash, hash) that break it: wrong link or wrong hash.

    Each entry is checked on its own against the one before, so a chain of any
    length is checked in parallel by stretches of its order.
    """
    before = F.lag("hash").over(W.partitionBy("chain").orderBy(order))
    good = (F.col("prev_hash") == F.coalesce(before, F.lit(""))) & (F.col("hash") == chain_hash(F.col("prev_hash"), F.col("payload")))
    return log.withColumn("_good", good).where(~F.coalesce(F.col("_good"), F.lit(False))).drop("_good")


def append_chain(entries: DataFrame, *, chain: str = "chain", order: str = "id") -> DataFrame:
    """Chains of sha256 links over entries (chain, id, payload), streamed one after the other."""
    import hashlib

    from .profile import fold_sorted

    def step(last: str, row: dict) -> tuple[str, dict]:
        h = hashlib.sha256(f"{last}|{row['payload']}".encode()).hexdigest()
        return h, {"chain": row["chain"], "id": row["id"], "payload": row["payload"], "prev_hash": last, "hash": h}

    rows = entries.select(F.col(chain).cast("string").alias("chain"), F.col(order).alias("id"), F.coalesce("payload", F.lit("")).alias("payload"))
    return fold_sorted(rows, "chain", ["id"], lambda row: "", step, "chain string, id long, payload string, prev_hash string, hash string")


def upsert(target: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the fresh values that are not null."""
    t, f = target.alias("t"), fresh.alias("f")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    cols = [F.coalesce(F.col(f"f.{c}"), F.col(f"t.{c}")).alias(c) if c in fresh.columns else F.col(f"t.{c}") for c in target.columns]
    return t.join(f, cond, "full").select(*cols)


def insert_missing(target: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The fresh rows whose key the target lacks, one of each key."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*fresh.columns))
    return fresh.withColumn("_r", first).where("_r = 1").drop("_r").join(target.select(*key), key, "left_anti")


def newest_labels(labels: DataFrame) -> DataFrame:
    """The newest label of each (tx_id, source)."""
    w = W.partitionBy("tx_id", "source").orderBy(F.desc("created"), F.desc("label"))
    return labels.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

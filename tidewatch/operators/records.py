"""Reads and writes of the bank's records: decisions, labels, alerts, cases, approvals, accounts, configuration.

Times are microseconds. Reads return the reference's own lists, so a limit is
theirs. Ties in an order are settled by the record's number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ACTIONS, action_rank
from . import frames as fr


def newest(df: DataFrame, order: str, number: str, n: int) -> DataFrame:
    """The n newest rows: a bounded list, taken with one heap a task."""
    return df.orderBy(F.desc(order), F.desc(number)).limit(n)


# --- accounts ---------------------------------------------------------------------------
def accounts_with_customers(accounts: DataFrame, customers: DataFrame, cust: int | None = None) -> DataFrame:
    """Accounts with their customer's columns, of all customers or of one; the filter reaches both scans."""
    if cust is not None:
        accounts = accounts.where(F.col("cust") == cust)
    return accounts.join(customers, "cust")


def changed_since(accounts: DataFrame, since_us: int, overlap_us: int = 5 * fr.SECOND) -> DataFrame:
    """Accounts updated from a little before ``since_us`` on, so that a commit that overtook the last scan is not missed."""
    return accounts.where(F.col("updated_us") >= since_us - overlap_us).select("cust", "status", "version", "updated_us")


def by_status(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("status").agg(F.count("*").alias("n"))


def transition(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """One step of compare-and-set: requests (cust, expected_version, requested) against accounts.

    Of several requests for one account the least numbered wins. Adds
    ``outcome``: changed, unchanged (it has that status already) or conflict (another version).
    """
    first = requests.groupBy("cust").agg(F.min(F.struct("request_id", "expected_version", "requested")).alias("r")).select("cust", "r.*")
    j = accounts.join(first, "cust")
    outcome = F.when(F.col("expected_version") != F.col("version"), "conflict").when(F.col("requested") == F.col("status"), "unchanged").otherwise("changed")
    moved = outcome == "changed"
    return j.select("cust", "request_id", outcome.alias("outcome"), F.when(moved, F.col("requested")).otherwise(F.col("status")).alias("status"), (F.col("version") + moved.cast("int")).alias("version"))


def latest_config(config: DataFrame) -> DataFrame:
    """The newest version of each key: key, value, version."""
    return config.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


# --- decisions and labels -------------------------------------------------------------------
def stored_result(tx: DataFrame, decisions: DataFrame, tx_id: int) -> DataFrame:
    return tx.where(F.col("tx_id") == tx_id).join(decisions.where(F.col("tx_id") == tx_id), "tx_id").limit(1)


def recent(tx: DataFrame, decisions: DataFrame, cust: int, n: int = 10) -> DataFrame:
    """A customer's n newest payments, with their decisions where there are any."""
    few = newest(tx.where(F.col("cust") == cust), "us", "tx_id", n)
    return few.join(decisions, "tx_id", "left")


def confirmed_fraud(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes that a fraud label confirms: payees A:..., and devices D:... of labelled payments."""
    hit = tx.join(labels.where("label = 1").select("tx_id").distinct(), "tx_id")
    nodes = F.array(F.when(F.col("payee") != "", F.concat(F.lit("A:"), "payee")), F.when(F.col("device") != "", F.concat(F.lit("D:"), "device")))
    return hit.select(F.explode(nodes).alias("n")).where("n is not null").distinct()


def block_feedback(decisions: DataFrame) -> DataFrame:
    """Nodes that a BLOCK flags: payee and device, never the customer."""
    return confirmed_fraud(decisions, decisions.where("decision = 'BLOCK'").select("tx_id", F.lit(1).alias("label")))


def backtest_source(decisions: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The n newest decisions with their newest label, null where there is none."""
    one = labels.groupBy("tx_id").agg(F.max_by("label", F.struct("created_us", "label")).alias("label"))
    return newest(decisions, "us", "tx_id", n).join(one, "tx_id", "left")


def active_learning(decisions: DataFrame, labels: DataFrame, low: float = 0.4, high: float = 0.6, n: int = 20, window: int = 2000) -> DataFrame:
    """The n least certain of the newest unlabelled decisions whose risk lies between the bounds."""
    open_ = decisions.where(F.col("risk").between(low, high)).join(labels.select("tx_id"), "tx_id", "left_anti")
    return newest(open_, "us", "tx_id", window).orderBy(F.abs(F.col("risk") - 0.5), F.desc("us"), F.desc("tx_id")).limit(n)


def override_labels(rows: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with an analyst's newest label in place of their own."""
    own = labels.where("source = 'analyst'").groupBy("tx_id").agg(F.max_by("label", F.struct("created_us", "label")).alias("_analyst"))
    return rows.join(own, "tx_id", "left").withColumn(label, F.coalesce("_analyst", label)).drop("_analyst")


def retrain_due(labels: DataFrame, champion_us: int, least: int = 50) -> DataFrame:
    """How many analyst labels are newer than the champion, and whether that is enough to train again."""
    return labels.where((F.col("source") == "analyst") & (F.col("created_us") > champion_us)).agg(F.count("*").alias("fresh")).withColumn("due", F.col("fresh") >= least)


def shadow_comparison(decisions: DataFrame, labels: DataFrame, *, step_up: float = 0.35, hold: float = 0.60, fp_cost: float = 50.0) -> DataFrame:
    """Champion and challenger over the same decisions: agreement, alert rates, and the labelled ones' costs."""
    j = decisions.join(labels.groupBy("tx_id").agg(F.max("label").alias("label")), "tx_id", "left")
    agree = (F.col("risk") >= step_up) == (F.col("challenger") >= step_up)
    rate = lambda c: F.avg((F.col(c) >= hold).cast("double"))
    cost = lambda c: F.sum(F.when((F.col(c) >= hold) & (F.col("label") == 0), F.lit(fp_cost)).when((F.col(c) < hold) & (F.col("label") == 1), F.col("amount")).otherwise(0.0).cast("decimal(18,2)"))
    return j.agg(F.count("*").alias("decisions"), F.avg(agree.cast("double")).alias("agreement"), rate("risk").alias("champion_alert_rate"), rate("challenger").alias("challenger_alert_rate"), F.count("label").alias("labelled"), cost("risk").cast("double").alias("champion_cost"), cost("challenger").cast("double").alias("challenger_cost"))


def components_map(columns: dict[str, Column]) -> Column:
    """Score components of a decision by name, without those that are null."""
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")) for n, c in columns.items())), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def top_contributions(contributions: DataFrame, n: int = 10) -> DataFrame:
    """The n contributions (tx_id, feature, value) of each event with the largest absolute value, as a list."""
    largest = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("value")).alias("o"), "feature", "value"))), 1, n)
    return contributions.groupBy("tx_id").agg(F.transform(largest, lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"], 5).alias("value"))).alias("explanation"))


def event_projection(decisions: DataFrame) -> DataFrame:
    """The fields of a decision event, with the older action names and what follows from the flags."""
    legacy = F.when(F.col("decision") == "ALLOW", "approve").when(F.col("decision") == "BLOCK", "block").otherwise("review")
    names = F.transform("rule_hits", lambda h: h["id"])
    review = F.col("sanctions_hit") | F.col("unknown_customer")
    return decisions.select("tx_id", "cust", "us", "amount", F.col("risk").alias("risk_score"), "decision", legacy.alias("decision_legacy"), F.array_join(names, ",").alias("rules"), "sanctions_hit", review.alias("force_review"), "case_required", F.when(F.col("decision") == "HOLD", 30).alias("hold_minutes"), "latency_ms")


def needs_outbox(decision: Column, case_required: Column) -> Column:
    """A superset of what needs an alert: a row too many is dropped later, a row too few is lost."""
    return F.coalesce(case_required, F.lit(False)) | F.coalesce(decision.isin("HOLD", "BLOCK"), F.lit(False))


# --- alerts ---------------------------------------------------------------------------------
# Alert types by rule tag, in order of preference, and tags that win over all others.
TYPE_BY_TAG = {"mule": "MULE", "aml": "AML", "ato": "ATO", "app": "APP", "card": "CARD_TESTING"}
SPECIFIC_TAGS = ("card",)


def alert_type(hits: Column, sanctions_hit: Column, unknown_customer: Column) -> Column:
    """The alert's type from its rules' tags and scores: gates first, then specific tags, then the strongest tag."""

    def strength(tag: str) -> Column:
        return F.array_max(F.transform(F.filter(hits, lambda h: F.array_contains(h["tags"], tag)), lambda h: h["score"]))

    ranked = F.array(*(F.struct(strength(t).alias("s"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (t, kind) in enumerate(TYPE_BY_TAG.items())))
    best = F.array_max(F.filter(ranked, lambda x: x["s"].isNotNull()))
    out = F.when(F.coalesce(sanctions_hit, F.lit(False)), "YAPTIRIM").when(F.coalesce(unknown_customer, F.lit(False)), "BILINMEYEN_MUSTERI")
    for t in SPECIFIC_TAGS:
        out = out.when(strength(t).isNotNull(), TYPE_BY_TAG[t])
    return out.otherwise(F.coalesce(best["kind"], F.lit("DAVRANIS")))


def severity(decision: Column, sanctions_hit: Column) -> Column:
    return F.when(F.coalesce(sanctions_hit, F.lit(False)) | (decision == "BLOCK"), "critical").when(decision == "HOLD", "high").otherwise("medium")


# --- cases ----------------------------------------------------------------------------------
def filtered_cases(cases: DataFrame, **wanted: object) -> DataFrame:
    """Cases that match every given column; ``least_total`` bounds the amount. Absent filters do not restrict."""
    conds = [F.col(c) == v for c, v in wanted.items() if v is not None and c != "least_total"]
    if wanted.get("least_total") is not None:
        conds.append(F.col("total") >= wanted["least_total"])
    return cases.where(reduce(lambda a, b: a & b, conds)) if conds else cases


def case_list(cases: DataFrame, n: int = 50, **wanted: object) -> DataFrame:
    """The n most pressing cases: by priority, then the latest update."""
    return filtered_cases(cases, **wanted).orderBy(F.desc("priority"), F.desc("updated_us"), "case_id").limit(n)


def case_summary(cases: DataFrame, now_us: int, sla_us: int = 4 * fr.HOUR) -> DataFrame:
    """Cases with their clock: due time, seconds left, and whether an unassigned new case is past it."""
    due = F.col("opened_us") + sla_us
    late = (F.col("status") == "YENI") & (due < now_us) & F.col("assigned_to").isNull()
    return cases.select("case_id", "status", "case_type", "alert_count", "total", due.alias("sla_due_us"), late.alias("sla_breached"), F.floor((due - now_us) / F.lit(float(fr.SECOND))).alias("sla_remaining_s"))


def recounted(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases with count and total taken from their distinct alerts again; a case without alerts has none."""
    one = alerts.dropDuplicates(["tx_id"]).groupBy("case_id").agg(F.count("*").alias("_n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("_t"))
    return cases.join(one, "case_id", "left").withColumns({"alert_count": F.coalesce("_n", F.lit(0)), "total": F.coalesce("_t", F.lit(0.0))}).drop("_n", "_t")


def customer_confirmation(cases: DataFrame, alerts: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases after customers' answers (tx_id, knows_payee): a payee that is not known doubles the priority and opens the case.

    An answer belongs to the case of the payment's newest alert; several for one case count one after the other.
    """
    of = alerts.groupBy("tx_id").agg(F.max_by("case_id", "alert_id").alias("case_id"))
    no = answers.join(of, "tx_id").groupBy("case_id").agg(F.count("*").alias("_answers"), F.count_if(~F.col("knows_payee")).alias("_no"))
    j = cases.join(no, "case_id", "left").fillna({"_answers": 0, "_no": 0})
    # p -> 2 p + 1 applied n times
    grown = F.round(F.pow(F.lit(2.0), F.col("_no")) * (F.col("priority") + 1) - 1, 2)
    return j.withColumns({"priority": grown, "status": F.when((F.col("_no") > 0) & (F.col("status") == "YENI"), "INCELENIYOR").otherwise(F.col("status")), "events": F.col("_answers")}).drop("_answers", "_no")


def similar_closed(cases: DataFrame, case_id: int, n: int = 3) -> DataFrame:
    """The n most recently closed fraud cases of the same type."""
    me = cases.where(F.col("case_id") == case_id).select(F.col("case_type").alias("_t"))
    like = cases.where((F.col("outcome") == "FRAUD") & (F.col("case_id") != case_id)).join(F.broadcast(me.limit(1)), F.col("case_type") == F.col("_t"))
    return like.drop("_t").orderBy(F.desc("closed_us"), "case_id").limit(n)


def case_document(cases: DataFrame, alerts: DataFrame, decisions: DataFrame, events: DataFrame, approvals: DataFrame, case_id: int) -> DataFrame:
    """One case as a nested document: its alerts with their decisions, its events and its approvals, each oldest first."""
    mine = alerts.where(F.col("case_id") == case_id)
    with_decision = mine.select("case_id", "alert_id", "tx_id").join(decisions.select("tx_id", "us", "amount", "decision", "risk"), "tx_id", "left")
    gathered = lambda df, fields: df.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("list"))
    out = cases.where(F.col("case_id") == case_id)
    parts = {"alerts": gathered(with_decision, ["us", "alert_id", "tx_id", "amount", "decision", "risk"]), "events": gathered(events.where(F.col("case_id") == case_id), ["us", "kind", "actor"]), "approvals": gathered(approvals.where(F.col("case_id") == case_id), ["approval_id", "kind", "status"])}
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("list", name), "case_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def append_events(events: DataFrame, fresh: DataFrame) -> DataFrame:
    """Case events with new ones; a number that is there already is not written again."""
    return events.unionByName(fresh.join(events.select("event_id"), "event_id", "left_anti"))


def back_filled_rings(cases: DataFrame, rings: DataFrame) -> DataFrame:
    """Open cases of ring members (ring_id, members) get the ring's number where they have none; of several rings the least."""
    of = rings.select("ring_id", F.explode("members").alias("cust")).groupBy("cust").agg(F.min("ring_id").alias("_ring"))
    fits = F.when(F.col("status") != "KAPALI", F.col("_ring"))
    return cases.join(of, "cust", "left").withColumn("ring_id", F.coalesce("ring_id", fits)).drop("_ring")


def clean_is_trusted(assignee: Column, actor: Column, role: Column) -> Column:
    """Whether a case closed as clean teaches the profile: an internal caller, or a senior who did not investigate it."""
    senior = F.coalesce(role.isin("kidemli_analist", "admin"), F.lit(False))
    return role.isNull() | (senior & (F.coalesce(assignee, F.lit("")) != "") & (assignee != actor))


# --- approvals --------------------------------------------------------------------------------
# Ranks of roles, and the least role that decides each kind of request.
ROLE_RANK = {"service": 0, "analist": 1, "kidemli_analist": 2, "admin": 3}
LEAST_ROLE = {"UNBLOCK": "kidemli_analist", "SIB": "kidemli_analist", "MODEL_PROMOTE": "admin", "RULE_CHANGE": "kidemli_analist", "POLICY_THRESHOLDS": "admin"}


def _lookup(values: dict[str, int], key: Column, default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def decided_approvals(attempts: DataFrame) -> DataFrame:
    """Attempts to decide requests (approval_id, kind, requested_by, status, actor, role, approve) and what comes of each.

    Four eyes: who asked does not decide, whatever the case of the name; each
    kind has a least role, an admin for kinds not listed; a null role is an
    internal caller; the break-glass token never decides.
    """
    least = _lookup({k: ROLE_RANK[r] for k, r in LEAST_ROLE.items()}, F.col("kind"), ROLE_RANK["admin"])
    weak = F.col("role").isNotNull() & (_lookup(ROLE_RANK, F.col("role"), -1) < least)
    outcome = F.when(F.col("actor") == "admin_token", "token").when(F.col("status") != "BEKLIYOR", "closed").when(F.lower("requested_by") == F.lower("actor"), "same_person").when(weak, "role").when(F.col("approve"), "ONAYLANDI").otherwise("REDDEDILDI")
    return attempts.withColumn("outcome", outcome)


def pending_requests(requests: DataFrame) -> DataFrame:
    """Requests that may be opened: the first of each pending (kind, target)."""
    first = requests.where("status = 'BEKLIYOR'").groupBy("kind", "target_id").agg(F.min("approval_id").alias("approval_id"))
    return requests.join(first.select("approval_id"), "approval_id", "left_semi")


# --- outbox -----------------------------------------------------------------------------------
def outbox_replay(outbox: DataFrame, alerts: DataFrame, cutoff_us: int, most_attempts: int = 5) -> DataFrame:
    """What becomes of each stale outbox row (tx_id, created_us, attempts): settled (its alert is there), retry, or dead_letter."""
    due = outbox.where(F.col("created_us") <= cutoff_us).join(alerts.select("tx_id").distinct().withColumn("_there", F.lit(True)), "tx_id", "left")
    fate = F.when(F.col("_there"), "settled").when(F.col("attempts") + 1 >= most_attempts, "dead_letter").otherwise("retry")
    return due.select("tx_id", "created_us", (F.col("attempts") + 1).alias("attempts"), fate.alias("fate"))


def without_settled(outbox: DataFrame, settled: DataFrame) -> DataFrame:
    return outbox.join(settled.select("tx_id"), "tx_id", "left_anti")


# --- idempotency --------------------------------------------------------------------------------
def idempotent(arrivals: DataFrame, key: str = "tx_id", order: Sequence[str] = ("us", "arrival")) -> DataFrame:
    """Adds ``fate`` to each arrival of a key (with a ``digest`` of its payload): first, duplicate (equal payload) or conflict.

    The first arrival's digest is taken by one aggregate, so a key that arrives
    without end is not gathered.
    """
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order, "digest")).alias("_first"))
    j = arrivals.join(first, key)
    here = F.struct(*order, "digest")
    return j.withColumn("fate", F.when(here == F.col("_first"), "first").when(F.col("digest") == F.col("_first.digest"), "duplicate").otherwise("conflict")).drop("_first")


# --- rules ------------------------------------------------------------------------------------
def rule_versions(history: DataFrame, saved: DataFrame) -> DataFrame:
    """``history`` (rule_id, version, definition, actor) with saved definitions (save_id, rule_id, definition, actor), each a version more."""
    last = history.groupBy("rule_id").agg(F.max("version").alias("_last"))
    from pyspark.sql.window import Window as W

    nth = F.row_number().over(W.partitionBy("rule_id").orderBy("save_id"))
    fresh = saved.withColumn("_n", nth).join(last, "rule_id", "left").select("rule_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("version"), "definition", "actor")
    return history.select("rule_id", "version", "definition", "actor").union(fresh)


def seeded(history: DataFrame, seed: DataFrame) -> DataFrame:
    """Version 1 of rules that the history lacks; rules that are there are not overwritten."""
    fresh = seed.join(history.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", F.lit(1).cast("long").alias("version"), "definition", F.lit("seed").alias("actor"))
    return history.select("rule_id", "version", "definition", "actor").union(fresh)


# --- older scores -------------------------------------------------------------------------------
def decide_from_risk(risk: Column, force_review: Column, account_blocked: Column) -> Column:
    """The action of a producer that sends a final risk only."""
    from ..functions.scores import threshold_action

    blocked, review = F.coalesce(account_blocked, F.lit(False)), F.coalesce(force_review, F.lit(False))
    base = threshold_action(risk)
    held = review & (action_rank(base) < ACTIONS.index("HOLD"))
    return F.when(blocked, "BLOCK").when(held, "HOLD").otherwise(base)


# Weights of the older score's factors and what each is called, strongest wording first.
RISK_WEIGHTS = {"amount": 0.32, "device": 0.22, "location": 0.16, "time": 0.08, "velocity": 0.06, "country": 0.07, "purpose": 0.05, "ip": 0.02, "channel": 0.02}
RISK_LABELS = {
    "amount": "tutar ortalamanın üzerinde",
    "device": "bilinmeyen cihaz",
    "location": "alışılmadık lokasyon",
    "time": "alışılmadık saat",
    "velocity": "yüksek işlem sıklığı",
    "country": "yüksek riskli ülke",
    "purpose": "açıklamada aciliyet/sosyal mühendislik ifadesi",
    "ip": "IP ülke uyumsuzluğu veya VPN/Tor",
    "channel": "müşterinin kullanmadığı kanal",
}
AMOUNT_SATURATION, OFF_HOURS, HIGH_VELOCITY = 10.0, 0.7, 10


def amount_factor(amount: Column, average: Column) -> Column:
    """0 up to the average, 1 from AMOUNT_SATURATION times it on."""
    ramp = (amount / average - 1) / (AMOUNT_SATURATION - 1)
    return F.when(average > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ramp))).otherwise(0.0)


def weighted_risk(factors: dict[str, Column]) -> Column:
    """The older score: a weighted sum of factors from 0 to 1, at most 1; factors that are missing are 0."""
    terms = [F.lit(w) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(factors[n], F.lit(0.0)))) for n, w in RISK_WEIGHTS.items() if n in factors]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, terms))


def explained_factors(factors: dict[str, Column]) -> Column:
    """Labels of the factors above 0, strongest first, equal ones in order of the weights."""
    named = F.array(*(F.struct((-F.coalesce(factors[n], F.lit(0.0))).alias("o"), F.lit(i).alias("i"), F.lit(RISK_LABELS[n]).alias("label")) for i, n in enumerate(RISK_LABELS) if n in factors))
    return F.transform(F.array_sort(F.filter(named, lambda x: x["o"] < 0)), lambda x: x["label"])


def decision_reason(decision: Column, risk: Column, account_blocked: Column, sanctions_hit: Column, unknown_customer: Column, texts: Column) -> Column:
    """The text of a decision: action and risk, gates, and the first two reason texts that are not the policy's."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    gates = F.filter(F.array(F.when(flag(sanctions_hit), "sanctions or PEP match"), F.when(flag(unknown_customer), "unknown customer")), lambda x: x.isNotNull())
    extras = F.concat(gates, F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, 2))
    head = F.concat(decision, F.lit(" (risk "), F.format_string("%.2f", risk), F.lit(")"))
    said = F.when(F.size(extras) > 0, F.concat(head, F.lit(": "), F.array_join(extras, "; "))).otherwise(head)
    return F.when(flag(account_blocked), "account blocked: rejected without a score").otherwise(said)


# --- figures ------------------------------------------------------------------------------------
def histogram_metric(values: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """A registered histogram: cumulative counts up to each bound, the count and the sum."""
    upto = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return values.agg(*upto, F.count(value).alias("count"), F.sum(F.col(value).cast("decimal(18,3)")).cast("double").alias("sum"))


def latency_percentiles(values: DataFrame, value: str, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Order statistics floor(q n) of a list of numbers, as the live view shows them."""
    n = values.agg(F.count(value).alias("_n"))
    from ..storage import running_sums

    g = running_sums(values.groupBy(value).agg(F.count("*").alias("_c")), [F.col(value)], {"_upto": F.col("_c")})
    j = g.crossJoin(F.broadcast(n))
    places = {f"p{int(q * 100)}": F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)) + 1 for q in quantiles}
    return j.agg(*(F.min(F.when(F.col("_upto") >= p, F.col(value))).alias(name) for name, p in places.items()))

"""Rule sets, back-tests, policy and reasons."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dsl
from ..functions import text as tx
from ..functions.scores import action_rank, clip, noisy_or, ranked_action, threshold_action

SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    id: str
    when: str
    score: float
    reason: str = ""
    action_hint: str | None = None
    severity: str = "medium"
    tags: tuple[str, ...] = field(default=())

    def checked(self, known: Iterable[str]) -> Rule:
        if not 0 < self.score <= 1:
            raise ValueError(f"{self.id}: the score must be in (0, 1]")
        if self.severity not in SEVERITIES or not self.id.replace("_", "").isalnum():
            raise ValueError(f"{self.id}: bad severity or id")
        dsl.names(self.when, set(known))
        return self


def ruleset_version(rules: Sequence[Rule]) -> str:
    """Twelve hex digits of a canonical form; the order of rules is no part of it."""
    canonical = json.dumps(sorted((asdict(r) for r in rules), key=lambda r: r["id"]), sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(canonical.encode()).hexdigest()[:12]


def with_overrides(rule: Rule, **changes) -> Rule:
    return replace(rule, **changes)


def hits(rules: Sequence[Rule], known: Iterable[str]) -> Column:
    """Array of the rules that hold, strongest first (equal scores in rule order)."""
    known = set(known)
    every = [
        F.when(
            dsl.condition(r.when, known),
            F.struct(F.lit(-r.score).alias("order"), F.lit(i).alias("i"), F.lit(r.id).alias("id"), F.lit(r.score).alias("score"), F.lit(r.action_hint).cast("string").alias("hint"), F.lit(r.severity).alias("severity"), F.array(*map(F.lit, r.tags)).cast("array<string>").alias("tags"), tx.template(r.reason, known).alias("text")),
        )
        for i, r in enumerate(rules)
    ]
    return F.array_sort(F.filter(F.array(*every), lambda h: h.isNotNull()))


def evaluate(features: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds rule_hits, rule_score (noisy-or, 6 digits) and rule_hint (the strictest)."""
    known = [c for c, k in features.dtypes if k in ("double", "float", "int", "bigint", "boolean", "smallint", "tinyint") or k.startswith("decimal")]
    out = features.withColumn("rule_hits", hits(rules, known))
    hint = F.array_max(F.transform("rule_hits", lambda h: action_rank(h["hint"])))
    return out.withColumn("rule_score", F.round(noisy_or(F.transform("rule_hits", lambda h: h["score"])), 6)).withColumn("rule_hint", F.when(hint >= 0, ranked_action(hint)))


def backtest(rows: DataFrame, rule: Rule, label: str = "label") -> DataFrame:
    """One row: volume, alerts, precision and recall of a rule. Rows without a label count as volume only."""
    return backtests(rows, [rule], label).drop("rule_id")


def backtests(rows: DataFrame, rules: Sequence[Rule], label: str = "label") -> DataFrame:
    """One row a rule, all counted in one pass over the rows."""
    known = [c for c in rows.columns if c != label]
    positive, labelled = F.col(label) == 1, F.col(label).isNotNull()

    def counts(rule: Rule) -> Column:
        hit = dsl.condition(rule.when, known)
        return F.struct(F.lit(rule.id).alias("rule_id"), F.count("*").alias("evaluated"), F.count_if(hit).alias("alerts"), F.count_if(labelled).alias("labelled"), F.count_if(hit & labelled).alias("labelled_alerts"), F.count_if(hit & positive).alias("true_positives"), F.count_if(positive).alias("positives"))

    a = rows.agg(F.array(*map(counts, rules)).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return a.select("rule_id", "evaluated", "alerts", ratio("alerts", "evaluated").alias("alert_rate"), "labelled", "true_positives", "positives", ratio("true_positives", "labelled_alerts").alias("precision"), ratio("true_positives", "positives").alias("recall"))


@dataclass(frozen=True)
class Policy:
    step_up: float = 0.35
    hold: float = 0.60
    block: float = 0.85
    soft_risk: float = 0.45
    soft_amount: float = 25_000.0
    unknown_risk: float = 0.60
    hold_minutes: int = 30
    weights: tuple[tuple[str, float], ...] = (("graph", 0.60), ("burst", 0.25), ("app", 0.55), ("online", 0.15), ("consortium", 0.60))


def combine(stacked: Column, signals: dict[str, Column], policy: Policy = Policy()) -> Column:
    weights = dict(policy.weights)
    return noisy_or(F.array(stacked, *(F.lit(weights.get(k, 0.0)) * clip(v) for k, v in signals.items())))


def decide(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds decision, risk_score, base_decision, overrides, case_required, hold_minutes.

    Columns: stacked, combined (risk before rounding), rule_hint, cap, amount,
    account_blocked, unknown_customer, sanctions_hit; nulls are false or none.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    blocked, unknown = flag("account_blocked"), flag("unknown_customer")
    gated = blocked | unknown
    risk = F.when(blocked, 1.0).when(unknown, policy.unknown_risk).otherwise(F.round("combined", 6))
    d = df.withColumn("risk_score", risk)
    base = threshold_action(F.col("risk_score"), policy.step_up, policy.hold, policy.block)
    d = d.withColumn("base_decision", F.when(blocked, "BLOCK").otherwise(base))
    soft = (F.col("rule_hint") == "HOLD") & (F.col("risk_score") < policy.soft_risk) & (F.col("amount") < policy.soft_amount)
    d = d.withColumn("_soft", F.coalesce(soft, F.lit(False)) & ~gated)
    d = d.withColumn("_floor", F.when(F.col("_soft"), "STEP_UP").otherwise(F.col("rule_hint")))
    d = d.withColumn("_rank", action_rank(F.col("base_decision")))
    d = d.withColumn("_raised", (action_rank(F.col("_floor")) > F.col("_rank")) & ~gated).withColumn("_rank", F.when(F.col("_raised"), action_rank(F.col("_floor"))).otherwise(F.col("_rank")))
    cap = action_rank(F.col("cap"))
    d = d.withColumn("_capped", (cap >= 0) & (F.col("_rank") > cap) & ~gated).withColumn("_rank", F.when(F.col("_capped"), cap).otherwise(F.col("_rank")))
    listed = flag("sanctions_hit") & ~gated
    d = d.withColumn("_rank", F.when(blocked, 3).when(unknown, 2).when(listed, F.greatest(F.col("_rank"), F.lit(2))).otherwise(F.col("_rank")))
    notes = F.array(F.when(blocked, "ACCOUNT_BLOCKED"), F.when(unknown & ~blocked, "UNKNOWN_CUSTOMER"), F.when(F.col("_soft"), "RULE_FLOOR_SOFTENED"), F.when(F.col("_raised"), "RULE_FLOOR"), F.when(F.col("_capped"), "TYPOLOGY_CAP"), F.when(listed, "SANCTIONS_HIT"))
    d = d.withColumn("decision", ranked_action(F.col("_rank"))).withColumn("overrides", F.filter(notes, lambda x: x.isNotNull()))
    d = d.withColumn("case_required", F.when(blocked, False).otherwise(F.col("_rank") >= 2)).withColumn("hold_minutes", F.when((F.col("decision") == "HOLD"), policy.hold_minutes))
    return d.drop("_soft", "_floor", "_rank", "_raised", "_capped")


def typology_cap(rule_hits: Column, app: Column, pass_through: Column, cycle: Column, near_threshold: Column) -> Column:
    """HOLD for scam, mule and laundering patterns, so that a victim is not blocked; none for takeovers."""
    tagged = lambda t: F.exists(rule_hits, lambda h: F.array_contains(h["tags"], t))
    return F.when(tagged("takeover"), F.lit(None).cast("string")).when((app >= 0.5) | (pass_through >= 0.7) | (cycle > 0) | tagged("aml") | (near_threshold > 0), "HOLD")


MAX_PER_SOURCE = {"ml": 2, "signal": 2}


def top_reasons(reasons: DataFrame, k: int = 5) -> DataFrame:
    """The k reasons to show of each tx_id: tx_id, place, code, source, weight.

    One reason a code, its heaviest. Policy reasons come first, then the
    heaviest of every other source, then the rest by weight, of model and signal
    reasons two at most. Equal weights go by code.
    """
    one = reasons.withColumn("_r", F.row_number().over(W.partitionBy("tx_id", "code").orderBy(F.desc("weight"), "source"))).where("_r = 1")
    nth = F.row_number().over(W.partitionBy("tx_id", "source").orderBy(F.desc("weight"), "code"))
    one = one.withColumn("_n", nth)
    limits = F.create_map(*(F.lit(x) for kv in MAX_PER_SOURCE.items() for x in kv))
    one = one.where(F.col("_n") <= F.coalesce(F.element_at(limits, F.col("source")), F.lit(2**31 - 1)))
    stage = F.when(F.col("source") == "policy", 0).when(F.col("_n") == 1, 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("tx_id").orderBy(stage, F.desc("weight"), "code"))
    return one.withColumn("place", place).where(F.col("place") <= k).select("tx_id", "place", "code", "source", "weight")


def shown_reasons(rows: DataFrame, reasons: str = "reasons", k: int = 5) -> DataFrame:
    """:func:`top_reasons` of rows that hold all their reasons, an array of (code, source, weight): the column becomes those to show, in their order.

    No row meets another, so nothing is shuffled. Weights are not null.
    """
    heavier = lambda o, r, name: (o["weight"] > r["weight"]) | ((o["weight"] == r["weight"]) & (o[name] < r[name]))
    every, one, told = F.col("_every"), F.col("_one"), F.col("_told")
    rows = rows.withColumn("_every", F.array_distinct(reasons))
    rows = rows.withColumn("_one", F.filter(every, lambda r: ~F.exists(every, lambda o: (o["code"] == r["code"]) & heavier(o, r, "source"))))

    def placed(r: Column) -> Column:
        n = F.size(F.filter(one, lambda o: (o["source"] == r["source"]) & heavier(o, r, "code")))
        stage = F.when(r["source"] == "policy", 0).when(n == 0, 1).otherwise(2)
        return F.struct(stage.alias("stage"), (-r["weight"]).alias("order"), r["code"].alias("code"), r["source"].alias("source"), r["weight"].alias("weight"), n.alias("n"))

    most = lambda source: F.coalesce(*(F.when(source == s, m) for s, m in MAX_PER_SOURCE.items()), F.lit(2**31 - 1))
    rows = rows.withColumn("_told", F.transform(one, placed))
    rows = rows.withColumn("_told", F.slice(F.array_sort(F.filter(told, lambda r: r["n"] < most(r["source"]))), 1, k))
    return rows.withColumn(reasons, F.transform(told, lambda r: F.struct(r["code"].alias("code"), r["source"].alias("source"), r["weight"].alias("weight")))).drop("_every", "_one", "_told")


def ml_reasons(contributions: DataFrame, groups: dict[str, str], least: float = 0.05) -> DataFrame:
    """Positive contributions (tx_id, feature, value) by feature group: tx_id, group, weight 1 - e^-sum, top_feature."""
    lookup = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    c = contributions.where("value > 0").withColumn("group", F.coalesce(F.element_at(lookup, F.col("feature")), F.lit("external")))
    c = c.groupBy("tx_id", "group").agg(F.sum("value").alias("s"), F.max_by("feature", F.struct("value", "feature")).alias("top_feature")).where(F.col("s") >= least)
    return c.select("tx_id", "group", (1 - F.exp(-F.col("s"))).alias("weight"), "top_feature")


def row_reasons(values: DataFrame, columns: Sequence[str], groups: dict[str, str], least: float = 0.05) -> DataFrame:
    """:func:`ml_reasons` of rows that hold all their contributions (tx_id, ``_phi`` in the order of ``columns``): no row meets another, so nothing is shuffled."""
    return values.select("tx_id", F.explode(group_reasons("_phi", columns, groups, least)).alias("r")).select("tx_id", "r.*")


def group_reasons(contributions: str, columns: Sequence[str], groups: dict[str, str], least: float = 0.05) -> Column:
    """The same as an array of (group, weight, top_feature), from a row's contributions in the order of ``columns``."""
    parts: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        parts.setdefault(groups.get(c, "external"), []).append(i)

    def told(group: str, places: list[int]) -> Column:
        here = [F.struct(F.get(contributions, i).alias("value"), F.lit(columns[i]).alias("feature")) for i in places]
        some = F.filter(F.array(*here), lambda c: c["value"] > 0)
        weight = F.aggregate(some, F.lit(0.0), lambda a, c: a + c["value"])
        return F.struct(F.lit(group).alias("group"), weight.alias("s"), F.array_max(some)["feature"].alias("top_feature"))

    some = F.filter(F.array(*(told(g, p) for g, p in parts.items())), lambda r: r["top_feature"].isNotNull() & (r["s"] >= least))
    return F.transform(some, lambda r: F.struct(r["group"].alias("group"), (1 - F.exp(-r["s"])).alias("weight"), r["top_feature"].alias("top_feature")))


# The core rules (id, condition, score, strictest action, severity, tags).
CORE_RULES = [
    ("R_NEW_PAYEE_HIGH_AMT", "is_new_payee and amount_ratio >= 5", 0.45, None, "high", "app ato"),
    ("R_NEW_DEVICE_HIGH_AMT", "is_new_device and amount_ratio >= 5", 0.5, "STEP_UP", "high", "ato"),
    ("R_ATO_FAST_LOGIN", "is_new_device and 0 <= login_to_transfer_s < 30", 0.5, None, "high", "ato takeover"),
    ("R_ATO_TAKEOVER", "is_new_device and (is_anonymized_ip or ip_country_mismatch or is_foreign) and amount_ratio >= 3", 0.7, "BLOCK", "critical", "ato takeover"),
    ("R_ANON_IP", "is_anonymized_ip", 0.12, None, "low", "network"),
    ("R_IP_MISMATCH", "ip_country_mismatch", 0.12, None, "low", "network"),
    ("R_HIGH_RISK_COUNTRY", "is_high_risk_country", 0.3, None, "medium", "aml network"),
    ("R_FOREIGN_NEW_DEVICE", "is_foreign and is_new_device", 0.3, None, "medium", "ato"),
    ("R_VELOCITY_BURST", "cnt_1m >= 3 or cnt_1h >= 8", 0.3, None, "medium", "velocity"),
    ("R_DRAIN_PATTERN", "cnt_1h >= 1 and amount_ratio >= 3 and distinct_payees_24h >= 1 and is_new_payee", 0.4, "HOLD", "high", "ato"),
    ("R_NIGHT_UNUSUAL", "is_night and hour_unusual and amount_ratio >= 2", 0.2, None, "medium", "time"),
    ("R_EXTREME_AMOUNT", "amount_zscore >= 4", 0.35, None, "high", "amount"),
    ("R_STRUCTURING", "near_threshold_cnt_24h >= 3", 0.5, "HOLD", "high", "aml"),
    ("R_CARD_TESTING", "cnt_1h >= 5 and amount_try <= 100", 0.45, "STEP_UP", "high", "card"),
    ("R_CARD_TEST_PROBE", "is_new_device and amount_try <= 100 and 0 <= login_to_transfer_s < 30", 0.35, None, "high", "card"),
    ("R_URGENT_PURPOSE", "purpose_risk >= 0.5", 0.15, None, "low", "app"),
    ("R_REMOTE_ACCESS", "remote_access", 0.35, None, "high", "app device"),
    ("R_ACTIVE_CALL_NEW_PAYEE", "active_call and is_new_payee", 0.35, None, "high", "app"),
    ("R_APP_SCAM_PATTERN", "is_new_payee and amount_ratio >= 3 and (active_call or remote_access or purpose_risk >= 0.5)", 0.6, "HOLD", "critical", "app"),
    ("R_EMULATOR_ROOT", "is_emulator or is_rooted", 0.3, None, "medium", "device"),
    ("R_BOT_TYPING", "typing_deviation >= 4", 0.25, None, "medium", "biometrics ato takeover"),
    ("R_SHARED_DEVICE", "device_customers_7d >= 3", 0.4, None, "high", "mule"),
    ("R_PAYEE_FAN_IN", "payee_fan_in_24h >= 4", 0.4, None, "high", "mule aml"),
    ("R_VULNERABLE_NEW_PAYEE_HIGH", "vulnerable_customer and is_new_payee and amount_ratio >= 3", 0.35, "STEP_UP", "high", "app"),
    ("R_CHANNEL_UNKNOWN", "channel_unknown", 0.08, None, "low", "channel"),
    ("R_MULE_PASS_THROUGH", "graph_pass_through >= 0.7 and graph_fan_in_30m >= 2", 0.5, "HOLD", "critical", "mule"),
    ("R_KNOWN_MULE_PAYEE", "graph_known_mule_payee", 0.6, "HOLD", "critical", "mule"),
    ("R_LAYERING_CYCLE", "graph_cycle", 0.45, "HOLD", "high", "mule aml"),
    ("R_COP_MISMATCH_NEW_PAYEE", "cop_no_match and is_new_payee and amount_ratio >= 2", 0.35, None, "high", "app"),
    ("R_YOUNG_PAYEE_HIGH", "0 <= payee_account_age_d < 30 and amount_ratio >= 3", 0.3, None, "medium", "app mule"),
    ("R_CONSORTIUM_HIT", "consortium_hit", 0.7, "HOLD", "critical", "consortium"),
]


# The reason texts of the core rules.
CORE_REASONS = {
    "R_NEW_PAYEE_HIGH_AMT": "İlk kez para gönderilen alıcıya müşteri ortalamasının {amount_ratio:.1f} katı tutar",
    "R_NEW_DEVICE_HIGH_AMT": "Yeni cihazdan müşteri ortalamasının {amount_ratio:.1f} katı tutar",
    "R_ATO_FAST_LOGIN": "Yeni cihazda oturum açıldıktan {login_to_transfer_s:.0f} sn sonra transfer",
    "R_ATO_TAKEOVER": "Yeni cihaz, anonim/yabancı ağ ve ortalamanın {amount_ratio:.1f} katı tutar: hesap ele geçirme örüntüsü",
    "R_ANON_IP": "IP adresi bilinen bir VPN/Tor aralığında",
    "R_IP_MISMATCH": "IP ülkesi işlem ülkesiyle uyuşmuyor",
    "R_HIGH_RISK_COUNTRY": "Yüksek riskli yargı bölgesiyle işlem",
    "R_FOREIGN_NEW_DEVICE": "Yurt dışından ve tanınmayan bir cihazdan işlem",
    "R_VELOCITY_BURST": "Son 1 saatte {cnt_1h:.0f} işlem (ani hız artışı)",
    "R_DRAIN_PATTERN": "1 saat içinde {cnt_1h:.0f} önceki transferin ardından yeni alıcıya yüksek tutar (hesap boşaltma)",
    "R_NIGHT_UNUSUAL": "Müşteri için olağandışı gece saatinde yüksek tutarlı işlem",
    "R_EXTREME_AMOUNT": "Tutar müşterinin olağan dağılımının {amount_zscore:.1f} standart sapma üzerinde",
    "R_STRUCTURING": "24 saatte raporlama eşiğinin hemen altında {near_threshold_cnt_24h:.0f} işlem (parçalama)",
    "R_CARD_TESTING": "Son 1 saatte {cnt_1h:.0f} küçük tutarlı işlem (kart testi örüntüsü)",
    "R_CARD_TEST_PROBE": "Yeni cihazdan oturum açıldıktan {login_to_transfer_s:.0f} sn sonra küçük tutarlı ödeme (kart testi sondası)",
    "R_URGENT_PURPOSE": "Açıklamada aciliyet/sosyal mühendislik ifadesi",
    "R_REMOTE_ACCESS": "Transfer sırasında uzaktan erişim aracı aktif",
    "R_ACTIVE_CALL_NEW_PAYEE": "Aktif telefon görüşmesi sırasında yeni alıcıya transfer",
    "R_APP_SCAM_PATTERN": "Yeni alıcıya ortalamanın {amount_ratio:.1f} katı tutar ve sosyal mühendislik sinyali (APP örüntüsü)",
    "R_EMULATOR_ROOT": "Emülatör veya root/jailbreak cihaz tespit edildi",
    "R_BOT_TYPING": "Yazma ritmi müşteri profilinden {typing_deviation:.1f} standart sapma farklı",
    "R_SHARED_DEVICE": "Cihaz 7 günde {device_customers_7d:.0f} farklı müşteri tarafından kullanıldı",
    "R_PAYEE_FAN_IN": "Alıcıya 24 saatte {payee_fan_in_24h:.0f} farklı müşteriden para gönderildi (toplama hesabı)",
    "R_VULNERABLE_NEW_PAYEE_HIGH": "Yaşlı/kırılgan müşteriden yeni alıcıya ortalamanın {amount_ratio:.1f} katı tutar",
    "R_CHANNEL_UNKNOWN": "Müşterinin daha önce kullanmadığı kanal",
    "R_MULE_PASS_THROUGH": "Son 30 dakikada {graph_fan_in_30m:.0f} farklı kaynaktan gelen para aktarılıyor (fan-in → fan-out)",
    "R_KNOWN_MULE_PAYEE": "Alıcı hesap doğrulanmış fraud ağında",
    "R_LAYERING_CYCLE": "Para döngüsü tespit edildi (katmanlama)",
    "R_COP_MISMATCH_NEW_PAYEE": "Alıcı adı IBAN sahibinin adıyla eşleşmiyor (CoP) — yeni alıcıya ortalamanın {amount_ratio:.1f} katı",
    "R_YOUNG_PAYEE_HIGH": "Alıcı hesap {payee_account_age_d:.0f} gün önce açılmış; tutar ortalamanın {amount_ratio:.1f} katı",
    "R_CONSORTIUM_HIT": "Alıcı/cihaz konsorsiyum ortak kara listesinde (başka bankada fraud)",
}


def core_rules() -> list[Rule]:
    return [Rule(i, w, s, CORE_REASONS[i], h, v, tuple(t.split())) for i, w, s, h, v, t in CORE_RULES]

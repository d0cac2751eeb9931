"""Operators against hand-computed cases and slow restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.functions import dsl
from tidewatch.functions import text as tx
from tidewatch.functions.scores import noisy_or, threshold_action
from tidewatch.functions.similarity import indel_ratio, jaro_winkler, token_sort_ratio
from tidewatch.operators import cases as cs
from tidewatch.operators import features as ft
from tidewatch.operators import frames as fr
from tidewatch.operators import graph as gr
from tidewatch.operators import matching as mt
from tidewatch.operators import metrics as mx
from tidewatch.operators import normalize as nz
from tidewatch.operators import profile as pf
from tidewatch.operators import rules as rl
from tidewatch.sources import files

TX = "tx_id long, us long, cust long, amount double, channel string, payee string, device string"


def stream(n=120, seed=1):
    r = random.Random(seed)
    rows, us = [], 1_704_067_200_000_000
    for i in range(n):
        us += r.choice([0, 0, 20, 900, 40_000, 200_000]) * 1_000_000
        rows.append((i, us, r.randrange(4), round(r.choice([10, 90, 46_000, 300]) * r.random() + 1, 2), r.choice(["web", "atm", ""]), r.choice(["p1", "p2", "p3", ""]), r.choice(["d1", "d2", ""])))
    r.shuffle(rows)
    return rows


def test_features_equal_a_replay(spark):
    rows = stream()
    got = {r["tx_id"]: r.asDict() for r in ft.features(spark.createDataFrame(rows, TX)).collect()}
    done = []
    for tx_id, us, cust, amount, channel, payee, device in sorted(rows, key=lambda r: (r[1], r[0])):
        past = lambda w, k=2, v=cust: [d for d in done if d[k] == v and d[1] > us - w]  # noqa: E731, B023
        f = got[tx_id]
        for tag, w in (("1m", fr.MINUTE), ("1h", fr.HOUR), ("24h", fr.DAY), ("7d", fr.WEEK)):
            assert f[f"cnt_{tag}"] == len(past(w))
            assert f[f"sum_{tag}"] == pytest.approx(sum(d[3] for d in past(w)), abs=1e-6)
        own = past(10**18)
        last = own[-1] if own else None
        assert f["time_since_last_s"] == ((us - last[1]) / 1e6 if last and us - last[1] < fr.WEEK else 604_800)
        assert f["distinct_payees_24h"] == len({d[5] for d in past(fr.DAY)} - {""})
        known = [d for d in own if d[5] == payee]
        assert f["is_new_payee"] == float(payee != "" and not known)
        assert f["payee_relation_age_d"] == pytest.approx((us - known[0][1]) / fr.DAY if payee and known else -1)
        assert f["payee_fan_in_24h"] == (len({d[2] for d in past(fr.DAY, 5, payee)} | {cust}) if payee else 0)
        assert f["device_customers_7d"] == (len({d[2] for d in past(fr.WEEK, 6, device)} | {cust}) if device else 1)
        near = lambda a: 45_000 <= a < 50_000
        assert f["near_threshold_cnt_24h"] == sum(near(d[3]) for d in past(fr.DAY)) + near(amount)
        week = past(fr.WEEK)
        assert f["night_ratio_7d"] == pytest.approx(sum(d[1] // fr.HOUR % 24 < 6 for d in week) / len(week) if week else 0)
        assert f["channel_change"] == float(bool(last and us - last[1] < fr.WEEK and channel and last[4] and last[4] != channel))
        done.append((tx_id, us, cust, amount, channel, payee, device))


def test_profile_recurrence(spark):
    rows = stream(60, 3)
    df = spark.createDataFrame(rows, TX).withColumn("trusted", F.col("tx_id") % 5 > 0).withColumn("avg_amount", F.lit(None).cast("double")).withColumn("typing", F.lit(None).cast("double"))
    got = {r["tx_id"]: r for r in pf.profile_features(df).collect()}
    state = {}
    for tx_id, us, cust, amount, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        n, m, v, top = state.get(cust, (0, 0.0, 0.05, 0.0))
        assert got[tx_id]["log_mean"] == pytest.approx(m) and got[tx_id]["log_var"] == pytest.approx(v) and got[tx_id]["max_amount"] == top
        if tx_id % 5:
            a = max(0.05, 1 / (n + 1))
            d = math.log1p(amount) - m
            state[cust] = (n + 1, m + a * d, max(0.05, (1 - a) * (v + a * d * d)), max(top, amount))


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("a > 1 and b", True),
        ("a / 0 == 0 and a // 0 == 0 and a % 0 == 0", True),
        ("-7 // 2 == -4 and -7 % 3 == 2", True),
        ("0 <= a < 2", False),
        ("a in (1, 2, 3) and a not in (5,)", True),
        ("(1 if b else 0) == 1", True),
        ("clamp(a, 3, 9) == 3 and min(a, 1) == 1 and max(a, 5) == 5 and abs(-a) == 2", True),
        ("log1p(-2) > 0", False),
        ("missing > 0 or not missing", True),
        ("'x' == 1", False),
        ("'x' < 1", False),
        ("'x' in ('x', 'y')", True),
        ("a", True),
        ("not a", False),
    ],
)
def test_rule_language(spark, rule, want):
    df = spark.createDataFrame([(2.0, True, None)], "a double, b boolean, missing double")
    assert df.select(dsl.condition(rule, ["a", "b", "missing"])).first()[0] is want


@pytest.mark.parametrize("rule", ["__import__('os')", "a.b", "unknown > 1", "lambda: 1", "a[0]", "f(a)", "a if", "x" * 501, "+".join(["a"] * 150), "abs(a, 1)", "a ** 2"])
def test_rule_language_refuses(rule):
    with pytest.raises(dsl.RuleSyntaxError):
        dsl.condition(rule, ["a"])


def test_core_rules_compile_and_version():
    rules = rl.core_rules()
    assert len(rules) == 31 and len({r.id for r in rules}) == 31
    assert rl.ruleset_version(rules) == rl.ruleset_version(rules[::-1]) != rl.ruleset_version(rules[1:])
    with pytest.raises(ValueError):
        rl.with_overrides(rules[0], score=1.5).checked(["is_new_payee", "amount_ratio"])


def test_policy_table(spark):
    cases = [
        (0.10, None, None, 100.0, False, False, False, "ALLOW", ""),
        (0.40, None, None, 100.0, False, False, False, "STEP_UP", ""),
        (0.90, None, "HOLD", 100.0, False, False, False, "HOLD", "TYPOLOGY_CAP"),
        (0.20, "HOLD", None, 100.0, False, False, False, "STEP_UP", "RULE_FLOOR_SOFTENED,RULE_FLOOR"),
        (0.20, "HOLD", None, 30_000.0, False, False, False, "HOLD", "RULE_FLOOR"),
        (0.20, "BLOCK", None, 100.0, False, False, False, "BLOCK", "RULE_FLOOR"),
        (0.10, None, None, 100.0, True, False, True, "BLOCK", "ACCOUNT_BLOCKED"),
        (0.10, None, None, 100.0, False, True, False, "HOLD", "UNKNOWN_CUSTOMER"),
        (0.10, None, None, 100.0, False, False, True, "HOLD", "SANCTIONS_HIT"),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], "combined double, rule_hint string, cap string, amount double, account_blocked boolean, unknown_customer boolean, sanctions_hit boolean").withColumn("i", F.monotonically_increasing_id())
    got = [(r["decision"], ",".join(r["overrides"])) for r in rl.decide(df).orderBy("i").collect()]
    assert got == [c[7:] for c in cases]


def test_scores(spark):
    assert spark.range(1).select(noisy_or(F.array(F.lit(0.5), F.lit(0.5), F.lit(2.0) * 0))).first()[0] == pytest.approx(0.75)
    assert [r[0] for r in spark.createDataFrame([(0.35,), (0.6,), (0.85,), (0.1,)], "r double").select(threshold_action(F.col("r"))).collect()] == ["STEP_UP", "HOLD", "BLOCK", "ALLOW"]


def test_names(spark):
    def one(f, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]

    assert one(tx.normalise, "  Viktor  MELNİKOV ", "Işık") == ["viktor melnikov", "isik"]
    assert one(tx.phonetic, "Ashcraft", "Robert", "Rupert", "", "Tymczak") == ["a226", "r163", "r163", "", "t522"]
    assert one(tx.mask_name, "Ayşe Yılmaz", "A") == ["A*** Y*****", "A*"]
    assert sorted(one(tx.ngrams, "ab")[0]) == ["_ab", "ab_"]
    assert one(tx.iban_valid, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", None) == [True, False, False]
    assert one(tx.luhn_valid, "4111 1111 1111 1111", "4111 1111 1111 1112") == [True, False]
    assert one(tx.tckn_valid, "10000000146", "10000000147") == [True, False]
    assert one(tx.redact, "mail a.b@c.com now", "pay 4111 1111 1111 1111") == ["mail [EMAIL] now", "pay [CARD]"]
    assert jaro_winkler("viktor melnikof", "viktor melnikov") == pytest.approx(0.97333, abs=1e-4)
    assert indel_ratio("abc", "abd") == pytest.approx(2 / 3) and token_sort_ratio("b a", "a b") == 1


def test_screening_and_confirmation(spark):
    q = spark.createDataFrame([(1, "Viktor Melnikof", 1960, "RU"), (2, "melnikov", 1960, "RU"), (3, "Jane Doe", 1990, "GB"), (4, "MELNIKOV viktor", 1961, "TR"), (5, None, None, None)], "q_id long, name string, birth_year int, country string")
    r = spark.createDataFrame([(9, ["Viktor Melnikov", "V. M."], 1960, "RU")], "rec_id long, names array<string>, birth_year int, country string")
    got = {x["q_id"]: x for x in mt.screen(q, r).collect()}
    assert {k: v["match_type"] for k, v in got.items()} == {1: "fuzzy", 2: "exact", 4: "exact"}
    assert got[2]["confidence"] == 1.0 and got[4]["confidence"] == pytest.approx(0.75 * 0.85, abs=1e-4)
    reg = spark.createDataFrame([("TR1 2", "Ayşe Yılmaz")], "iban string, name string")
    asked = spark.createDataFrame([(1, "tr12", "AYSE YILMAZ"), (2, "TR12", "Ayse Yilmas"), (3, "TR12", "Bob"), (4, "X", "Bob"), (5, "TR12", None)], "q_id long, iban string, name string")
    got = {x["q_id"]: x["result"] for x in mt.confirm_payee(asked, reg).collect()}
    assert got[1] == "EXACT" and got[2] in ("CLOSE", "EXACT") and (got[3], got[4], got[5]) == ("NO_MATCH", "UNKNOWN", "UNKNOWN")


def test_ip_ranges(spark):
    ranges = mt.cidr_ranges(spark.createDataFrame([("10.0.0.0/8", "A"), ("10.1.0.0/16", "B"), ("0.0.0.0/0", "Z")], "cidr string, country string"))
    got = mt.longest_prefix(spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",), ("8.8.8.8",), ("bad",), (None,)], "ip string"), ranges).collect()
    assert sorted((r["ip"] or "", r["country"]) for r in got) == sorted([("10.1.2.3", "B"), ("10.2.0.1", "A"), ("8.8.8.8", "Z"), ("bad", None), ("", None)])


def test_money(spark):
    rows = [("EUR", 1.005), ("aed", 10.0), ("XXX", 1.0), (None, 2.0)]
    got = nz.convert(spark.createDataFrame(rows, "currency string, amount double")).collect()
    assert [None if r["amount_try"] is None else float(r["amount_try"]) for r in got] == [45.45, 109.0, None, None]


def test_metrics_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9, 10.0), (0, 0.5, 1.0), (1, 0.5, 5.0), (0, 0.1, 1.0)], "y int, s double, amount double")
    m = mx.rank_metrics(rows).first()
    assert m["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and m["roc_auc"] == pytest.approx((2 + 1.5) / 4)
    b = mx.budget_metrics(rows, 0.5).first()
    assert b["alerts"] == 2 and b["precision"] == pytest.approx(0.75)
    assert mx.psi(rows, rows, "s").first()[0] == pytest.approx(0)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "y")], "a string, b string")
    assert {(r["node"], r["component"]) for r in gr.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x")}
    ranks = gr.pagerank(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 2.0)], "src string, dst string, w double"), 20).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1) and max(ranks, key=lambda r: r["rank"])["node"] == "a"


def test_audit_chain_and_states(spark):
    e = spark.createDataFrame([("c", i, f"p{i}") for i in range(20)], "chain string, id long, payload string")
    log = cs.append_chain(e)
    assert cs.verify_chain(log).count() == 0
    assert [r["id"] for r in cs.verify_chain(log.withColumn("payload", F.when(F.col("id") == 7, "x").otherwise(F.col("payload")))).collect()] == [7]
    rows = [(1, 1, 1, "system", "INCELENIYOR"), (1, 2, 2, "system", "AKTIF"), (1, 3, 3, "analyst", "AKTIF"), (1, 4, 4, "system", "BLOKE")]
    got = cs.account_states(spark.createDataFrame(rows, "cust long, us long, tx_id long, actor string, requested string")).orderBy("us").collect()
    assert [(r["status"], r["version"]) for r in got] == [("INCELENIYOR", 1), ("INCELENIYOR", 1), ("AKTIF", 2), ("BLOKE", 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"transaction_id": "1", "ts": "2024-01-02T03:04:05", "amount": 5, "session": {"paste_used": true}}]')
    r = files.json_array(spark, str(tmp_path / "t.json")).first()
    assert r["transaction_id"] == "1" and r["session"]["paste_used"] and r["currency"] is None
    n = nz.normalise(files.json_array(spark, str(tmp_path / "t.json"))).first()
    assert (n["currency"], n["payee"], n["us"]) == ("TRY", "", 1_704_164_645_000_000)
    got = spark.createDataFrame([('x ```json\n{"a": 1}\n``` {"a": 2}',), ('say {"a": 3} now',), ("none",)], "t string").select(files.json_object(F.col("t"), "a int")["a"]).collect()
    assert [r[0] for r in got] == [1, 3, None]


def test_entry_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0

"""Stored vectors and their context, profile summaries, screening of both roles, IPv6 ranges, tails, learned scores alone."""

import ipaddress
import math
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tidewatch.operators import documents as dc
from tidewatch.operators import matching as mt
from tidewatch.operators import models as md
from tidewatch.operators import profile as pf
from tidewatch.operators import protocols as pr
from tidewatch.operators import rules as rl
from tidewatch.operators import vectors as vs


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=60).returncode == 0


def test_ranges_of_both_kinds_equal_the_standard_library(spark):
    rng = random.Random(5)
    six = [ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(rng.choice((8, 40, 96)))) for _ in range(60)]
    asked = [rng.choice((str(a), a.exploded, a.compressed.upper())) for a in six] + [f"10.{i % 3}.0.{i}" for i in range(20)]
    asked += ["::ffff:10.1.2.3", "::", "fe80::1%eth0", "::1::2", "1:2:3", "1:2:3:4:5:6:7:8:9", ":::", "12345::", "g::1", "::10.1.2.999", "10.1.2", "", None]
    nets = [f"{a}/{rng.randint(30, 128)}" for a in six[:25]] + ["::/0", "2001:db8::/32", "::ffff:10.1.0.0/112", "10.0.0.0/8", "10.1.0.0/16", "0.0.0.0/0"]
    ranges = spark.createDataFrame([(str(ipaddress.ip_network(n, strict=False)),) for n in dict.fromkeys(nets)], "cidr string").distinct()
    known = [ipaddress.ip_network(r["cidr"]) for r in ranges.collect()]
    got = mt.longest_prefix(spark.createDataFrame([(a,) for a in asked], "ip string"), mt.cidr_ranges(ranges)).collect()
    assert len(got) == len(asked)
    for r in got:
        try:
            a = ipaddress.ip_address(r["ip"])
            holds = [n for n in known if n.version == a.version and a in n]
        except ValueError:
            holds = []
        assert r["cidr"] == (str(max(holds, key=lambda n: n.prefixlen)) if holds else None), r
    assert mt.longest_prefix(spark.createDataFrame([("10.0.0.1",)], "ip string"), mt.cidr_ranges(ranges.limit(0))).first()["cidr"] is None


def test_both_roles_are_screened_once(spark):
    records = spark.createDataFrame([(1, ["Ivan Petrov"], 1970, "RU"), (2, ["Maria Lopez Garcia"], None, None)], "rec_id int, names array<string>, birth_year int, country string")
    rows = [
        (1, "Ivan Petrov", 1970, "ru", "Maria Lopez Garcia", "TR12"),
        (2, "Nobody Known", 1980, "TR", "Ivan Petrov", "Ivan Petrov"),
        (3, "Ivan Petrov", 1950, "TR", None, "Maria Lopez Garcia"),
        (4, None, None, None, "", " "),
        (5, "Ivan Petrov", 1970, "ru", "Ivan Petrov", None),
    ]
    p = spark.createDataFrame(rows, "tx_id int, customer_name string, birth_year int, country string, beneficiary_name string, beneficiary_id string")
    got = {(r["tx_id"], r["rec_id"], r["matched_on"]): r["confidence"] for r in mt.screen_payments(p, records).collect()}
    assert set(got) == {(1, 1, "Ivan Petrov"), (1, 2, "Maria Lopez Garcia"), (2, 1, "Ivan Petrov"), (3, 1, "Ivan Petrov"), (3, 2, "Maria Lopez Garcia"), (5, 1, "Ivan Petrov")}
    # known keys that differ lower the confidence; the first question that finds a record tells it
    assert got[3, 1, "Ivan Petrov"] < got[2, 1, "Ivan Petrov"] <= got[5, 1, "Ivan Petrov"]
    assert mt.screen_payments(p, records, least=0.99).where("tx_id = 3 and rec_id = 1").isEmpty()
    assert mt.screen_payments(p.limit(0), records).isEmpty()


def _entries(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, cust string, document string")


def test_vectors_go_in_once_or_replace(spark):
    first = vs.upserted(None, _entries(spark, [("a", "profile", "a", "one"), ("a", "profile", "a", "another"), ("b", "profile", "b", None)]), replace=False)
    assert {r["id"]: r["document"] for r in first.collect()} == {"a": "another", "b": None}
    later = _entries(spark, [("a", "profile", "a", "new"), ("c", "profile", "c", "see")])
    kept = vs.upserted(first, later, replace=False)
    assert {r["id"]: r["document"] for r in kept.collect()} == {"a": "another", "b": None, "c": "see"}
    replaced = vs.upserted(first, later, replace=True)
    assert {r["id"]: r["document"] for r in replaced.collect()} == {"a": "new", "b": None, "c": "see"}
    for r in replaced.collect():
        assert math.isclose(sum(x * x for x in r["embedding"]), 0.0 if r["document"] is None else 1.0, abs_tol=1e-9)
    people = spark.createDataFrame([("a", 1.0, ["d"], ["l"], [3]), ("", 1.0, [], [], []), (None, 1.0, [], [], [])], "cust string, average double, devices array<string>, locations array<string>, hours array<int>")
    assert [r["id"] for r in vs.profile_entries(people).collect()] == ["a"]
    assert [r["id"] for r in vs.case_entries(spark.createDataFrame([(5, "a", "x"), (None, "a", "y")], "case_id int, cust string, document string")).collect()] == ["case:5"]


def test_context_is_the_own_customers_profile(spark):
    store = vs.upserted(None, _entries(spark, [("a", "profile", "a", "gece kart mobil"), ("b", "profile", "b", "sabah web"), ("z", "profile", "z", None), ("case:1", "fraud_case", "a", "gece kart mobil")]), replace=False)
    p = spark.createDataFrame([(1, "a", "gece web"), (2, "b", "gece web"), (3, "c", "gece web"), (4, None, "x"), (5, "z", "gece"), (6, "a", None), (1, "a", "gece web")], "tx_id int, cust string, document string")
    got = vs.behaviour_context(store, p).collect()
    assert sorted(r["tx_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6]
    told = {r["tx_id"]: (r["context"], r["distance"]) for r in got}
    texts = spark.createDataFrame([("gece web",), ("gece kart mobil",), ("sabah web",)], "t string")
    v = {r["t"]: np.array(r["embedding"]) for r in dc.hash_embedding(texts, "t", "t").collect()}
    for tx, own in ((1, "gece kart mobil"), (2, "sabah web")):
        assert told[tx][0] == own and abs(told[tx][1] - (1 - v["gece web"] @ v[own])) < 1e-6
    assert told[3] == told[4] == (None, None) and told[5] == (None, 1.0) and told[6] == ("gece kart mobil", 1.0)
    decided = spark.createDataFrame([(1, "HOLD"), (9, "BLOCK")], "tx_id int, decision string")
    assert {r["tx_id"] for r in vs.explained(decided, store, p).collect()} == {1}


def test_summaries_equal_the_profile_itself(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(10**12), f"c{i % 3}" if i % 7 else None, rng.choice((None, rng.uniform(1, 500))), "web", f"d{rng.randrange(30)}" if i % 5 else None, i % 4 > 0, 80.0 if i % 3 == 0 else None, None) for i in range(200)]
    tx = spark.createDataFrame(rows, "tx_id long, us long, cust string, amount double, channel string, device string, trusted boolean, avg_amount double, typing double")
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        p = want.setdefault(r[2] or "", pf.Profile(r[7] or 0.0))
        if r[6]:
            p.learn(r[3] or 0.0, r[1] // 3_600_000_000 % 24, r[4], r[5] or "", r[1], None)
    got = {r["cust"]: r for r in pf.profile_summaries(tx).collect()}
    assert set(got) == set(want) == {"", "c0", "c1", "c2"}
    for c, p in want.items():
        assert got[c]["observations"] == round(p.n, 1) and got[c]["devices"] == len(p.devices)
        assert abs(got[c]["ewma_amount"] - math.expm1(p.log_mean)) < 0.0051 and abs(got[c]["max_amount"] - p.max_amount) < 0.0051
    assert pf.profile_summaries(tx.limit(0)).isEmpty()


def test_every_core_rule_has_a_text_of_known_features(spark):
    import string

    rules = rl.core_rules()
    assert all(r.reason for r in rules) and set(rl.CORE_REASONS) == {r.id for r in rules}
    for r in rules:
        for _, name, _, _ in string.Formatter().parse(r.reason):
            assert name is None or name in r.when or name in ("cnt_1h",), r.id
    x = spark.createDataFrame([(6.25, 1.0)], "amount_ratio double, is_new_payee double")
    rule = next(r for r in rules if r.id == "R_NEW_PAYEE_HIGH_AMT")
    assert rl.evaluate(x, [rule]).first()["rule_hits"][0]["text"].endswith("6,3 katı tutar")


def test_tails_equal_their_definition(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.exponential(size=300), -rng.exponential(size=300).round(1), np.full(300, 2.0)])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    asked = [(0.1, -3.0, 2.0), (9.0, 1.0, 2.0), (-1.0, -0.2, 5.0)]
    score = md.fitted_tails(rows, ["a", "b", "c"])
    got = [r["ecod"] for r in score(spark.createDataFrame([*asked, (None, None, None)], "a double, b double, c double")).collect()]
    for values, told in zip(asked, got):
        want = 0.0
        for v, k in zip(values, x.T):
            l, r = (-math.log(max(1 / 301, s / 300)) for s in ((k <= v).sum(), (k >= v).sum()))
            lean = ((k - k.mean()) ** 3).mean() if k.min() < k.max() else 0
            want += max(l, r, r if lean > 0 else l if lean < 0 else l + r)
        assert abs(want - told) < 1e-9
    assert got[3] == 0.0
    assert md.fitted_tails(rows.limit(0), ["a"])(rows).where("ecod <> 0").isEmpty()


def test_tails_are_those_of_all_rows(spark, monkeypatch):
    """no sample stands for the rows, values that most rows have and missing ones included."""
    monkeypatch.setattr(md, "TAIL_BLOCK", 16)
    rng = np.random.default_rng(5)
    n = 6000
    x = np.column_stack([rng.normal(size=n), np.where(rng.random(n) < 0.9, 0.0, rng.integers(-3, 4, n)), rng.choice([-1.0, 1.0], n) * 0.1])
    x[::2, 2], x[1::2, 2] = -0.1, 0.1  # leans to no side
    x[:7, 0], x[7:20, 1] = np.nan, -0.0
    rows = spark.createDataFrame([(None if i == 3 else float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)], "a double, b double, c double").repartition(5)
    asked = [(i, *map(float, r)) for i, r in enumerate([*x[:60], (9.0, -0.0, 0.1), (-9.0, 5.0, 0.0), (0.0, -5.0, -0.2)])]
    got = {r["i"]: r for r in md.fitted_tails(rows, ["a", "b", "c"])(spark.createDataFrame(asked, "i long, a double, b double, c double")).collect()}
    assert len(got) == len(asked)
    for i, *values in asked:
        want = 0.0
        for v, k in zip(values, x.T):
            k = k[~np.isnan(k)]
            if not math.isnan(v):
                l, r = (-math.log(max(1 / (len(k) + 1), s / len(k))) for s in ((k <= v).sum(), (k >= v).sum()))
                skew = ((k - k.mean()) ** 3).mean() / k.std() ** 3
                want += max(l, r, r if skew > 1e-9 else l if skew < -1e-9 else l + r)
        assert abs(want - got[i]["ecod"]) < 1e-9


def test_learned_scores_alone_find_what_is_there(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(1200) < 0.2).astype(int)
    rows = spark.createDataFrame([(i, int(t), float(rng.normal(2.5 * t)), float(rng.normal()), 10.0 + i % 7) for i, t in enumerate(y)], "i long, y int, a double, b double, amount double")
    scored = pr.learned_layers(rows, ["a", "b"], ["i"], trees=5, depth=3)
    last = scored.agg(F.count("*").alias("n"), F.min("i").alias("first")).first()
    assert (last["n"], last["first"]) == (180, 1020)  # no row that a model saw
    got = {r["layer"]: r for r in pr.learned_only_protocol(scored, ["i"], rounds=20).collect()}
    assert set(got) == {"gbm", "anomaly", "hybrid"} and got["gbm"]["gain"] is None
    for r in got.values():
        assert r["n"] == 180 and r["pr_auc_low"] <= r["pr_auc"] <= r["pr_auc_high"] and r["roc_auc"] > 0.7
    assert got["hybrid"]["pr_auc"] > 0.6 and got["hybrid"]["verdict"] in ("none", "gain", "harm")


def test_names_with_any_marks_are_replaced(spark):
    rows = [(1, "ÉLODIE MÜLLER and élodie  müller, Elodie Muller; Elodie Mullers", ["Élodie Müller"]), (2, "nobody", ["Élodie Müller"]), (3, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    out = dc.pseudonymised(d, names="names")
    told = out.select("doc_id", "text", "redacted", dc.restored(F.col("redacted"), F.col("tokens")).alias("back")).collect()
    got = {r["doc_id"]: r["redacted"] for r in told}
    assert "uller," not in got[1] and "MÜLLER" not in got[1] and "Muller;" not in got[1] and got[1].endswith("Elodie Mullers")
    assert got[2] == "nobody" and got[3] is None
    assert all(r["back"] == r["text"] for r in told)

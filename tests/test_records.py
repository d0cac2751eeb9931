"""Records, signals, evaluation, documents, sources: hand-made cases and slow restatements."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores
from tidewatch.functions import text as tx
from tidewatch.operators import documents as dc
from tidewatch.operators import evaluation as ev
from tidewatch.operators import features as ft
from tidewatch.operators import frames as fr
from tidewatch.operators import graph as gr
from tidewatch.operators import matching as mt
from tidewatch.operators import metrics as mx
from tidewatch.operators import models as md
from tidewatch.operators import normalize as nz
from tidewatch.operators import profile as pf
from tidewatch.operators import records as rc
from tidewatch.operators import rules as rl
from tidewatch.operators import signals as sg
from tidewatch.plans import full
from tidewatch.sources import files, sinks
from tidewatch.storage import running_sums
from tidewatch.streaming import streams
from tests.test_engine import TX


# --- frames -------------------------------------------------------------------------------
def test_one_payee_with_half_of_all_events(spark):
    r = random.Random(4)
    rows = [(i, 1_704_067_200_000_000 + i * 40 * fr.MINUTE // 10, i % 97, 1.0 + i % 7, "web", "hub" if i % 2 else f"p{i % 50}", "d") for i in range(6000)]
    got = {x["tx_id"]: x["payee_fan_in_24h"] for x in ft.features(spark.createDataFrame(rows, TX), ["payee_fan_in_24h"]).collect()}
    for i in r.sample(range(6000), 60):
        _, us, cust, _, _, payee, _ = rows[i]
        assert got[i] == len({x[2] for x in rows[max(0, i - 400) : i] if x[5] == payee and x[1] > us - fr.DAY} | {cust})


def test_sums_leave_no_trace_of_large_amounts(spark):
    rows = [(1, 0, 1, 0.01, "", "p", ""), (2, 10, 1, 1e14, "", "p", ""), (3, 20, 1, 5.0, "", "p", ""), (4, 20 + fr.DAY, 1, 7.0, "", "p", "")]
    got = {x["tx_id"]: x["sum_24h"] for x in ft.features(spark.createDataFrame(rows, TX), ["sum_24h"]).collect()}
    assert got == {1: 0.0, 2: 0.01, 3: 1e14 + 0.01, 4: 0.0} or (got[2], got[4]) == (0.01, 0.0)


def test_running_sums_over_ranges(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    out = running_sums(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc("b")], {"upto": F.col("a")})
    total, want = 0, {}
    for a, b in sorted(rows, key=lambda x: -x[1]):
        total += a
        want[b] = total
    assert {r["b"]: r["upto"] for r in out.collect()} == want


# --- records ------------------------------------------------------------------------------
def test_idempotent_streams_write_once_and_set_conflicts_aside(spark, tmp_path):
    target, dead = str(tmp_path / "t"), str(tmp_path / "d")
    write = streams.write_idempotent(target, dead, "tx_id")
    batches = [[(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")], [(1, "a"), (2, "c"), (3, "d")]]
    for n, b in enumerate(batches):
        write(spark.createDataFrame(b, "tx_id long, digest string"), n)
    read = lambda p: sorted(map(tuple, spark.read.schema("tx_id long, digest string").parquet(p).collect()))
    assert read(target) == [(1, "a"), (2, "b"), (3, "d")] and read(dead) == [(2, "c")]
    once = streams.write_once(str(tmp_path / "o"), ["tx_id"])
    for n, b in enumerate(batches):
        once(spark.createDataFrame(b, "tx_id long, digest string"), n)
    assert spark.read.schema("tx_id long, digest string").parquet(str(tmp_path / "o")).count() == 3


def test_back_filled_rings_and_documents_of_nothing(spark):
    cases = spark.createDataFrame([(1, 7, "YENI", None), (2, 7, "KAPALI", None), (3, 8, "YENI", "R0")], "case_id long, cust long, status string, ring_id string")
    rings = spark.createDataFrame([("R2", [7]), ("R1", [7, 8])], "ring_id string, members array<long>")
    assert {r["case_id"]: r["ring_id"] for r in rc.back_filled_rings(cases, rings).collect()} == {1: "R1", 2: None, 3: "R0"}
    assert rc.decided_approvals(spark.createDataFrame([(1, "SIB", "Ann", "BEKLIYOR", "ann", "admin", True), (2, "SIB", "Ann", "BEKLIYOR", "bob", "analist", True), (3, "SIB", "Ann", "BEKLIYOR", "bob", None, False), (4, "SIB", "Ann", "BEKLIYOR", "admin_token", "admin", True)], "approval_id long, kind string, requested_by string, status string, actor string, role string, approve boolean")).orderBy("approval_id").select("outcome").collect() == [("same_person",), ("role",), ("REDDEDILDI",), ("token",)]


def test_seeded_rules_are_not_overwritten(spark):
    h = spark.createDataFrame([("R1", 3, "own", "ann")], "rule_id string, version long, definition string, actor string")
    s = spark.createDataFrame([("R1", "seed1"), ("R2", "seed2")], "rule_id string, definition string")
    assert sorted(map(tuple, rc.seeded(h, s).collect())) == [("R1", 3, "own", "ann"), ("R2", 1, "seed2", "seed")]


# --- signals ------------------------------------------------------------------------------
def test_louvain_finds_dense_groups(spark):
    edges = []
    for g in range(4):
        m = [f"n{g}{i}" for i in range(6)]
        edges += [(a, b, 1.0) for i, a in enumerate(m) for b in m[i + 1 :]]
        edges.append((m[0], f"n{(g + 1) % 4}1", 0.2))
    got = {r["node"]: r["community"] for r in sg.modularity_communities(spark.createDataFrame(edges, "a string, b string, w double")).collect()}
    assert len(got) == 24 and len(set(got.values())) == 4 and all(len({got[n] for n in got if n[1] == g}) == 1 for g in "0123")
    assert sg.modularity_communities(spark.createDataFrame([], "a string, b string, w double")).count() == 0


def test_every_core_rule_can_fire(spark, sf):
    fired = set()
    for r in full.f11_all_core_rules(spark, sf).collect():
        fired |= set(r["hits"].split(",")) - {""}
    assert fired == {r.id for r in rl.core_rules()}


def test_the_full_pass_agrees_with_its_parts(spark, sf):
    t, s = full.payments(spark, sf), full.surroundings(spark, sf)
    out = {r["tx_id"]: r for r in full.sc.full_pass(t, s).collect()}
    assert len(out) == t.count()
    policy = rl.Policy()
    weights = dict(policy.weights)
    acted = set()
    for r in out.values():
        left = (1 - r["rule_score"]) * (1 - weights["graph"] * r["graph_score"]) * (1 - weights["burst"] * r["burst"]) * (1 - weights["app"] * r["app_score"]) * (1 - weights["consortium"] * r["consortium_score"])
        assert r["risk_score"] == pytest.approx(policy.unknown_risk if r["unknown_customer"] else 1 - left, abs=2e-6)
        score = math.prod(1 - h["score"] for h in r["rule_hits"])
        assert r["rule_score"] == pytest.approx(1 - score, abs=1e-6)
        acted.add(r["decision"])
    assert acted >= {"ALLOW", "STEP_UP", "HOLD"}
    fired = {h["id"] for r in out.values() for h in r["rule_hits"]}
    assert {"R_IP_MISMATCH", "R_ANON_IP", "R_CONSORTIUM_HIT", "R_HIGH_RISK_COUNTRY", "R_REMOTE_ACCESS"} <= fired
    again = {r["tx_id"]: r for r in ft.features(t).collect()}
    assert all(out[i]["cnt_7d"] == again[i]["cnt_7d"] and out[i]["payee_fan_in_24h"] == again[i]["payee_fan_in_24h"] for i in out)


def test_federated_weights_equal_numpy(spark):
    r = random.Random(3)
    rows = [(b, r.random(), r.random(), r.randrange(2)) for b in "abc" for _ in range(20 + 10 * (b == "c"))]
    got = sg.federated_average(spark.createDataFrame(rows, "bank string, u double, v double, y int"), ["u", "v"], rounds=3, epochs=2)
    w = np.zeros(3)
    for _ in range(3):
        local, size = [], []
        for b in "abc":
            x = np.array([[q[1], q[2], 1.0] for q in rows if q[0] == b])
            y = np.array([q[3] for q in rows if q[0] == b])
            v = w.copy()
            for _ in range(2):
                v = v - 0.5 * x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y)
            local.append(v)
            size.append(len(y))
        w = np.average(local, axis=0, weights=size)
    assert got == pytest.approx(w.tolist())


# --- evaluation ---------------------------------------------------------------------------
def test_resamples_keep_the_strata(spark):
    rows = [(i, int(i % 9 == 0), (i * 37 % 100) / 100) for i in range(300)]
    s = ev.resampled(spark.createDataFrame(rows, "tx_id long, y int, s double"), ["tx_id"], 15).groupBy("round").agg(F.sum(F.col("times") * F.col("y")).alias("pos"), F.sum("times").alias("n")).collect()
    assert len(s) == 15 and all((r["pos"], r["n"]) == (34, 300) for r in s)


def test_resamples_are_counts_of_each_row_and_never_rows_by_rounds(spark):
    """Draws, average precision and F1 of every round as a plain loop has them, over several blocks, chunks and ranges; scores tie."""
    rows = [(i * 7 % 500, int(i % 7 == 0), (i * 37 % 40) / 40, float(i * 613 % 500)) for i in range(500)]
    d = spark.createDataFrame(rows, "tx_id long, y int, s double, u double").repartition(3)
    sample = ev.drawn(d, ["tx_id"], 12, block=64, chunk=100).cache()
    got = {r["tx_id"]: np.frombuffer(r["times"], "<u4").tolist() for r in sample.collect()}
    want = {r[0]: [0] * 12 for r in rows}
    for y in (0, 1):
        own = sorted(r[0] for r in rows if r[1] == y)
        for k in range(12):
            for i in range(len(own)):
                x = (i * 48271 + (k + 1) * 69621 + 12345) % (2**31 - 1)
                want[own[(x * x % (2**31 - 1) * 16807 + k + 1) % (2**31 - 1) % len(own)]][k] += 1
    assert sample.count() == 500 and got == want
    for name, at in (("s", 2), ("u", 3)):
        ap = {r["round"]: r["ap"] for r in ev.average_precision_by_round(sample, name).collect()}
        f1 = {r["round"]: r["f1"] for r in ev.f1_by_round(sample, name, 0.5).collect()}
        for k in range(12):
            total = sum(want[r[0]][k] for r in rows if r[1])
            n = pos = value = 0
            for s in sorted({r[at] for r in rows}, reverse=True):
                here = [(want[r[0]][k], r[1]) for r in rows if r[at] == s]
                n, pos = n + sum(t for t, _ in here), pos + sum(t for t, y in here if y)
                value += sum(t for t, y in here if y) * pos / n if n else 0
            assert ap[k + 1] == pytest.approx(value / total)
            hit = [(want[r[0]][k], r[1]) for r in rows if r[at] >= 0.5]
            assert f1[k + 1] == pytest.approx(2 * sum(t for t, y in hit if y) / (sum(t for t, _ in hit) + total))
    sample.unpersist()


def test_drift_shows_where_values_move(spark):
    rows = [(i, float(i % 10) if i < 3000 else float(i % 10) + 20) for i in range(6000)]
    df = spark.createDataFrame(rows, "i long, v double")
    edges = [2.0, 5.0, 8.0]
    out = {r["seen"]: r["psi"] for r in ev.drift_windows(df, ["i"], "v", ev.distribution(df.where("i < 3000"), "v", edges), edges, window=1000, every=500).collect()}
    assert len(out) == 12 and out[3000] == 0 and out[6000] > 1 and out[3500] > 0.1


# --- documents ----------------------------------------------------------------------------
def test_texts_of_one_row_group_are_redacted_by_all_cores(spark, tmp_path):
    from tidewatch.plans import documents as pd_

    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a.b@c.org "), F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("m13_mail_tokens", "m14_name_tokens", "m16_restored"):
        out = pd_.QUERIES[name](spark, str(tmp_path))
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 200, name
        assert out.count() == 400


def test_redaction_there_and_back(spark):
    rows = [
        (1, "Ayşe Yılmaz sent to TR33 0006 1005 1978 6457 8413 26 and AYŞE YILMAZ again, mail a.b@c.org", ["Kemal Tas"]),
        (2, "card 4111 1111 1111 1111, other 4111 1111 1111 1112, id 10000000146, call 0532 123 45 67", None),
        (3, "kemal   taş and Kemal Tas are one; can gelir, Can Demir ve Mehmet Ali Öztürk geldi", ["Kemal Tas"]),
        (4, None, None),
        (5, "", []),
        (6, "nothing to hide", ["ab"]),
    ]
    d = dc.pseudonymised(spark.createDataFrame(rows, "id long, text string, names array<string>"), "text", "names")
    got = {r["id"]: r for r in d.withColumn("back", dc.restored(F.col("redacted"), F.col("tokens"))).collect()}
    assert all(got[i]["back"] == t for i, t, _ in rows)
    kinds = {i: [t["kind"] for t in got[i]["tokens"]] for i in got}
    assert kinds[1] == ["IBAN", "EPOSTA", "KISI", "KISI"] and "lmaz" not in got[1]["redacted"].lower() and "0006" not in got[1]["redacted"]
    assert sorted(kinds[2]) == ["KART", "TCKN", "TELEFON"] and "4111 1111 1111 1112" in got[2]["redacted"]
    assert kinds[3].count("MUSTERI") == 2 and "Öztürk" not in got[3]["redacted"] and "Demir" not in got[3]["redacted"] and "can gelir" in got[3]["redacted"]
    assert kinds[4] == kinds[5] == kinds[6] == []


def test_fields_share_placeholders_and_streams_come_back(spark):
    d = spark.createDataFrame([(1, "mail a@b.co", "again a@b.co", None)], "id long, x string, y string, z string")
    out = dc.pseudonymised_fields(d, ["x", "y", "z"])
    r = out.first()
    assert (r["x"], r["y"], r["z"]) == ("mail EPOSTA_1", "again EPOSTA_1", None)
    chunks = spark.createDataFrame([("s", 1, "to EPO"), ("s", 2, "STA_1 now")], "stream string, seq long, chunk string")
    assert dc.restored_streams(chunks, out.select(F.lit("s").alias("stream"), "tokens")).first()["text"] == "to a@b.co now"


def test_hash_embeddings_equal_their_definition(spark):
    text = "Ali ali veli ölçü 12 x"
    got = dc.hash_embedding(spark.createDataFrame([(1, text), (2, "!!")], "k long, t string"), "k", "t")
    vec = [0.0] * 256
    for w in text.lower().split():
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        vec[int.from_bytes(h[:4], "little") % 256] += 1 if h[4] & 1 else -1
    n = math.sqrt(sum(v * v for v in vec))
    rows = {r["k"]: r["embedding"] for r in got.collect()}
    assert rows[1] == pytest.approx([v / n for v in vec]) and set(rows[2]) == {0.0}
    near = mt.cosine_neighbours(got.where("k = 1"), got, 1, id_col="k")
    assert near.count() == 1


# --- sources and sinks ----------------------------------------------------------------------
def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text("rules:\n  - id: R1\n    when: a >= 1\n    score: 0.5\n    reason_template: 'x {a:.1f}'\n    tags: [app]\n")
    (tmp_path / "kw.yaml").write_text("keywords:\n  'Güvenli': 0.4\n  guvenli: 0.9\n")
    (tmp_path / "ip.json").write_text(json.dumps({"ranges": [{"cidr": "10.0.0.0/8", "country": "TR", "vpn": True}]}))
    (tmp_path / "s.json").write_text(json.dumps([{"id": "S1", "name": "A B", "aliases": ["C"], "birth_date": "1970-01-02", "country": "TR"}]))
    (tmp_path / "ulb.csv").write_text('"Time",' + ",".join(f'"V{i}"' for i in range(1, 29)) + ',"Amount","Class"\n' + ",".join(["0"] * 29) + ",9.5,'1'\n")
    (tmp_path / "p.csv").write_text("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n1,TRANSFER,10,C1,0,0,C2,0,0,1,0\n1,PAYMENT,5,C1,0,0,M1,0,0,0,0\n")
    (tmp_path / "c.csv").write_text("txId,class\n1,1\n2,unknown\n")
    (tmp_path / "e.csv").write_text("txId1,txId2\n1,2\n")
    (tmp_path / "t.jsonl").write_text('{"transaction_id": "a", "amount": 3, "label": 1}\n')
    p = lambda n: str(tmp_path / n)
    (rule,) = files.rule_file(spark, p("rules.yaml"))
    assert rule.checked({"a"}).tags == ("app",) and files.keyword_file(spark, p("kw.yaml")) == {"guvenli": 0.9}
    assert files.ip_ranges(spark, p("ip.json")).first().asDict() == {"cidr": "10.0.0.0/8", "country": "TR", "vpn": True, "tor": False}
    assert files.sanctions(spark, p("s.json")).first().asDict() == {"rec_id": "S1", "names": ["A B", "C"], "birth_year": 1970, "country": "TR"}
    assert files.ulb(spark, p("ulb.csv")).select("row", "y", "Amount").first() == (0, 1, 9.5)
    raw = files.csv(spark, p("p.csv"), where=F.col("isFraud") == 1)
    assert "PushedFilters: [IsNotNull(isFraud), EqualTo(isFraud,1)]" in raw._jdf.queryExecution().toString() and raw.count() == 1
    pay = files.paysim(files.csv(spark, p("p.csv"))).orderBy("tx_id").collect()
    assert [(r["channel"], r["label"]) for r in pay] == [("mobile", 1), ("web", 0)] and pay[1]["us"] - pay[0]["us"] == 1_800_000_000
    nodes, edges = files.elliptic(spark, p("c.csv"), p("e.csv"))
    assert sorted(map(tuple, nodes.collect())) == [(1, 1), (2, -1)] and edges.count() == 1
    assert nz.strip_labels(files.json_lines(spark, p("t.jsonl"))).columns[0] == "transaction_id"
    lists = spark.createDataFrame([("black", ["kp"]), ("grey", ["xx"])], "name string, countries array<string>")
    assert {r["code"] for r in files.jurisdictions(lists, ["black"], ["ir"]).collect()} == {"KP", "IR"}
    t = spark.createDataFrame([(i, i, 100.0) for i in range(5)], "tx_id long, us long, amount double")
    assert [r["amount"] for r in files.drifted(t, 0.4).orderBy("tx_id").collect()] == pytest.approx([100, 110, 120, 130, 140])


def test_sinks_read_back(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    d = spark.createDataFrame([(1, "=x", 0.1234567, 1)], "tx_id long, name string, v double, label int")
    sinks.csv_export(d, p("csv"))
    assert spark.read.csv(p("csv"), header=True).first()["name"] == "'=x"
    sinks.back_test(d, ["v"], p("bt"))
    assert files.back_test_rows(spark, p("bt")).first().asDict() == {"id": "1", "y": 1, "f": {"v": 0.123457}}
    sinks.dataset({"a": d, "b": d.limit(0)}, p("ds"))
    assert {r["name"]: r["rows"] for r in spark.read.json(p("ds/manifest")).collect()} == {"a": 1, "b": 0}
    sinks.report(d, p("sar"))
    assert len(spark.read.json(p("sar")).first()["digest"]) == 64
    e = spark.createDataFrame([(1, 2, 3, "HOLD", 0.7, ["A", "B"], True, 30)], "tx_id long, us long, cust long, decision string, risk_score double, overrides array<string>, case_required boolean, hold_minutes int")
    assert sinks.egress(e).first()["overrides"] == "A,B"
    good, bad = nz.split_valid(d, {"no v": F.col("v") > 1})
    assert good.count() == 0 or bad.count() + good.count() == 1
    m = d.select(nz.mask_values(F.create_map(F.lit("k"), F.lit("secret"), F.lit("n"), F.lit(None).cast("string"))).alias("m")).first()["m"]
    assert m == {"k": "•••", "n": None}


def test_small_functions(spark):
    one = spark.range(1)
    r = one.select(scores.average_path_length(F.lit(256)).alias("a"), tx.amount_text(F.lit(1_500_000.0)).alias("m"), tx.amount_text(F.lit(2_000.0)).alias("k"), dc.hour_band(F.lit(None).cast("int")).alias("h")).first()
    assert r["a"] == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256) and (r["m"], r["k"], r["h"]) == ("1.5M", "2K", "bilinmeyen saat")
    l = spark.createDataFrame([("ALLOW", None), ("ALLOW", "fraud"), ("HOLD", "trusted"), ("HOLD", None)], "d string, l string")
    assert [x[0] for x in l.select(pf.should_learn("d", "l")).collect()] == [True, False, True, False]
    reg = mt.build_registry(spark.createDataFrame([("TR1", "A")], "iban string, name string"), spark.createDataFrame([("tr 1", "X"), ("TR2", "B"), (None, "C")], "iban string, name string"))
    assert sorted((x["iban"], x["name"]) for x in reg.collect()) == [("TR1", "A"), ("TR2", "B")]
    w = one.select(F.lit(0.5).alias("a"), F.lit(0.5).alias("b")).select(md.stacked({"a": 1.0, "b": 2.0}, 0.0).alias("s")).first()["s"]
    assert w == pytest.approx(0.5)
    rows = spark.createDataFrame([(i, float(i % 5), 0.0) for i in range(20)], "tx_id long, a double, b double")
    out = md.leave_one_out(lambda df: df.withColumn("p", 1 / (1 + F.exp(-F.col("a")))), rows, ["a", "b"], {"a": 0.0, "b": 0.0})
    assert {x["value"] for x in out.where("feature = 'b'").collect()} == {0.0}


def test_streams_of_made_up_traffic(spark):
    s = files.traffic(spark, 50)
    assert s.isStreaming and s.columns == ["tx_id", "ts", "cust", "amount", "odd"]


def test_hubs_do_not_pair_payments(spark):
    rows = [(i, i * fr.MINUTE, i % 300 + 1, 100.0, "", "acc", "") for i in range(3000)] + [(9000, 3001 * fr.MINUTE, 0, 50.0, "", "other", "")]
    t, o = spark.createDataFrame(rows, TX), spark.createDataFrame([("acc", 0)], "payee string, owner long")
    r = gr.pass_through(t, o, fr.DAY).where("tx_id = 9000").first()
    assert (r["inflow"], r["fan_in"]) == (100.0 * len([x for x in rows[:-1] if x[1] >= rows[-1][1] - fr.DAY]), 300)
    assert mx.rank_metrics(spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, s double")).first()["roc_auc"] == 1.0


def test_queries_of_one_form_are_dealt_over_tasks(spark):
    """Many queries with one name meet its records in many partitions, and each pair comes once."""
    from tidewatch.operators import matching as mt

    q = spark.range(4000).select(F.col("id").alias("q_id"), F.array(F.lit("red"), F.lit("ring")).alias("qt"))
    q = q.union(q.where("q_id = 7")).union(spark.createDataFrame([(7, ["big"])], "q_id long, qt array<string>"))
    found = spark.createDataFrame([(["red", "ring"], 1), (["red", "ring"], 2), (["big"], 2), (["big"], 3)], "qt array<string>, rec_id long")
    with_all = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_all}
    try:
        for k, v in with_all.items():
            spark.conf.set(k, v)
        out = mt._spread(q, found, "qt")
        rows = out.withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({(r.q_id, r.rec_id) for r in rows}) == len(rows) == 3999 * 2 + 3
    assert len({r.p for r in rows if r.q_id != 7}) > 1


def test_texts_with_placeholders_and_digits_beside_names_come_back(spark):
    from tidewatch.operators import documents as dc

    many = " ".join(f"Ahmet Soyad{c}5" for c in "abcdefghijklmnopqrst")
    texts = ["KISI_1 met Ahmet Demir", many, "a@b.co 2345678901 x", "EPOSTA_1 EPOSTA_23 is c@d.co5", "KISI_99999999999999999999 Ahmet Demir", "to a@b.co 0000000146 and 10000000146", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = dc.pseudonymised(d).select("id", "text", "tokens", dc.restored(F.col("redacted"), F.col("tokens")).alias("back"))
    rows = {r.id: r for r in out.collect()}
    assert [rows[i].back for i in range(len(texts))] == texts
    assert len(rows[1].tokens) == 20


def test_texts_are_embedded_without_a_shuffle(spark):
    from tidewatch.operators import documents as dc

    d = spark.createDataFrame([(1, "Red red ring, ÇAY!"), (2, None), (3, ""), (4, "a b c d e f g a")], "id int, text string")
    out = dc.with_embedding(d, "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.embedding for r in out.collect()}
    assert got == {r.id: r.embedding for r in dc.hash_embedding(d, "id", "text").collect()}
    assert [round(sum(x * x for x in got[i]), 9) for i in (1, 2, 3, 4)] == [1, 0, 0, 1]
    two = spark.createDataFrame([(1, "red ring"), (1, "red çay")], "id int, text string")
    assert dc.hash_embedding(two, "id", "text").first().embedding == got[1]

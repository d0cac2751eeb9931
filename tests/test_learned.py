"""Attributions and online scores against plain restatements."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.scores import logit
from tidewatch.operators import models as md
from tidewatch.operators import online as on
from tidewatch.operators import rules as rl
from tidewatch.operators import trees as tr

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def boosted(spark):
    r = random.Random(3)
    data = []
    for i in range(600):
        x = [round(r.random(), 2) for _ in NAMES]
        data.append((i, *x, int(x[0] + x[1] * x[2] + 0.3 * r.random() > 0.9)))
    rows = spark.createDataFrame(data, "tx_id long, a double, b double, c double, d double, e double, y int")
    model = md.boosted_model(rows, NAMES, rounds=4, depth=3)
    nodes = tr.nodes(model)
    return rows, model, [r.asDict() for r in nodes.collect()], tr.paths(nodes)


def worth(nodes, x, known):
    """The model's log-odds where only the features of ``known`` are told."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n

    def down(tree, i):
        n = tree[i]
        if n["left"] < 0:
            return n["prediction"]
        if n["feature"] in known:
            return down(tree, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        return sum(tree[c]["n"] / n["n"] * down(tree, c) for c in (n["left"], n["right"]))

    return sum(2 * next(iter(t.values()))["weight"] * down(t, 0) for t in trees.values())


def test_attributions_equal_all_subsets(boosted):
    rows, _, nodes, paths = boosted
    x = np.array([[r[c] for c in NAMES] for r in rows.limit(25).collect()])
    x[3, 1] = np.nan
    got = tr.shapley(paths, x)
    n = len(NAMES)
    for k, row in enumerate(x):
        for i in range(n):
            rest = [j for j in range(n) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (worth(nodes, row, {*s, i}) - worth(nodes, row, set(s))) for m in range(n) for s in itertools.combinations(rest, m))
            assert got[k, i] == pytest.approx(want, abs=1e-9)
    assert tr.expected(paths) == pytest.approx(worth(nodes, x[0], set()))


def test_attributions_sum_to_the_log_odds(spark, boosted):
    rows, model, _, paths = boosted
    sums = tr.contributions(rows, paths, NAMES).groupBy("tx_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    p = md.boosted_scores(model, rows, NAMES).select("tx_id", logit(F.col("p"), 1e-9).alias("z"))
    off = sums.join(p, "tx_id").agg(F.max(F.abs(F.col("s") + tr.expected(paths) - F.col("z"))), F.min("n"), F.count("*")).first()
    assert off[0] < 1e-6 and off[1] == len(NAMES) and off[2] == 600
    reasons = rl.ml_reasons(tr.contributions(rows, paths, NAMES), dict.fromkeys(NAMES, "all"))
    assert reasons.where("weight <= 0").count() == 0 and reasons.count() > 0
    assert tr.contributions(rows.limit(0), paths, NAMES).count() == 0


def test_a_tree_without_splits_has_no_attributions(spark):
    rows = spark.createDataFrame([(i, 1.0, i % 2) for i in range(10)], "tx_id long, a double, y int")
    paths = tr.paths(tr.nodes(md.boosted_model(rows, ["a"], rounds=2, depth=2)))
    assert all(p.features == () for p in paths) and tr.contributions(rows, paths, ["a"]).agg(F.sum(F.abs("value"))).first()[0] == 0


# --- half-space trees --------------------------------------------------------------------------------
AXES = ["u", "v", "w"]
EVENTS = "tx_id long, us long, u double, v double, w double, trusted boolean, seg string"


def events(n, seed):
    r = random.Random(seed)
    out, us = [], 0
    for i in range(n):
        us += r.choice((0, 0, 1, 5))
        odd = r.random() < 0.05
        out.append((i * 7919 % 10007, us, *(round(r.random() if odd else min(1.0, max(0.0, r.gauss(0.4, 0.08))), 4) for _ in AXES), r.choice((True, True, False, None)), "xy"[i % 2]))
    return out


def replay(rows, window):
    model = on.HalfSpaceModel(on.forest(3, 5, 4, window, 42))
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        x = np.array([0.0 if v is None else v for v in r[2:5]])
        out[r[0]] = (*model.score(x), model.ready)
        if r[5]:
            model.learn(x, out[r[0]][0])
    return out


@pytest.mark.parametrize(("chunk", "block"), [(on.CHUNK, on.BLOCK), (7, 50)])
def test_online_scores_equal_a_replay(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(on, "CHUNK", chunk)
    monkeypatch.setattr(on, "BLOCK", block)
    rows = events(900, 1)
    rows[40] = (*rows[40][:2], None, *rows[40][3:])
    want = replay(rows, 60)
    got = on.half_space_scores(spark.createDataFrame(rows, EVENTS).repartition(5), AXES, trusted=F.col("trusted"), trees=5, height=4, window=60).collect()
    assert len(got) == len(rows)
    for g in got:
        raw, score, ready = want[g.tx_id]
        assert (g.raw, g.online_score, g.ready) == (pytest.approx(raw, abs=1e-12), pytest.approx(score, abs=1e-9), ready)
    assert max(g.online_score for g in got) > 0.5
    odd = {r[0] for r in rows if any(v is not None and abs(v - 0.4) > 0.4 for v in r[2:5])}
    ready = [g for g in got if g.ready]
    mean = lambda gs: sum(g.online_score for g in gs) / len(gs)
    assert mean([g for g in ready if g.tx_id in odd]) > 5 * mean([g for g in ready if g.tx_id not in odd])


def test_online_scores_of_few_or_no_events(spark):
    got = on.half_space_scores(spark.createDataFrame(events(20, 2), EVENTS), AXES, window=60, trees=5, height=4).collect()
    assert len(got) == 20 and not any(g.ready or g.raw or g.online_score for g in got)
    assert on.half_space_scores(spark.createDataFrame([], EVENTS), AXES).collect() == []


def test_online_stream_equals_a_replay_of_each_segment(spark, tmp_path):
    rows = events(600, 3)
    rows.sort(key=lambda r: (r[1], r[0]))
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from tidewatch.streaming import streams as st

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.tx_id: r for r in st.drain(on.half_space_stream(stream, AXES, "seg", trees=5, height=4, window=60)).collect()}
    for seg in "xy":
        for i, (raw, score, _) in replay([r for r in rows if r[6] == seg], 60).items():
            assert (got[i].seg, got[i].raw, got[i].online_score) == (seg, pytest.approx(raw), pytest.approx(score))
    assert len(got) == 600


def test_reasons_of_rows_equal_those_of_their_contributions(spark, boosted):
    """reasons come from the row's own values; nothing is shuffled."""
    rows, _, _, paths = boosted
    groups = {NAMES[0]: "one"}
    want = rl.ml_reasons(tr.contributions(rows, paths, NAMES), groups, least=0.01)
    got = rl.row_reasons(tr.attributed(rows, paths, NAMES), NAMES, groups, least=0.01)
    shown = lambda df: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in df.collect())
    assert shown(got) == shown(want) and got.count() > 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_positions_and_profiles_stand_beside_their_rows(spark):
    """F16, F21, F25: a place in an order needs no window over the rows, and a profile no join."""
    from tidewatch.operators import evaluation as ev
    from tidewatch.operators import profile as pf

    rows = spark.range(0, 1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(7)
    split = ev.row_split(rows, ["k"])
    assert {r["k"]: r["part"] for r in split.collect()} == {k: "train" if k < 700 else "valid" if k < 850 else "test" for k in range(1000)}
    tx = spark.range(0, 60).selectExpr("id as tx_id", "id * 3600000000 as us", "if(id % 3 = 0, null, id % 3) as cust", "id * 1.5D as amount", "'web' as channel", "concat('d', id % 4) as device", "id % 5 > 0 as trusted", "cast(null as double) as avg_amount", "90.0D as typing", "id * 2 as other")
    names = ["amount_ratio", "amount_zscore", "is_new_device", "typing_deviation"]
    slim = pf.profile_features(tx, names, keep=("tx_id", "other"))
    assert slim.columns == ["tx_id", "other", *names]
    whole = {r["tx_id"]: [r[n] for n in names] for r in pf.profile_features(tx).collect()}
    assert {r["tx_id"]: [r[n] for n in names] for r in slim.collect()} == whole and all(r["other"] == 2 * r["tx_id"] for r in slim.collect())
    assert "Join" not in slim._jdf.queryExecution().executedPlan().toString()


def test_reasons_of_a_row_are_those_of_a_table(spark):
    """reasons to show are chosen in their row; nothing is shuffled."""
    r = random.Random(8)
    reasons = [(i, f"R{r.randrange(6)}", r.choice(("rule", "ml", "signal", "policy")), r.choice((0.1, 0.2, 0.5, 0.7))) for i in range(60) for _ in range(r.randrange(1, 12))]
    flat = spark.createDataFrame(reasons, "tx_id long, code string, source string, weight double")
    want = {(x["tx_id"], x["place"]): (x["code"], x["source"], x["weight"]) for x in rl.top_reasons(flat).collect()}
    rows = spark.createDataFrame([(i, [x[1:] for x in reasons if x[0] == i]) for i in range(61)], "tx_id long, reasons array<struct<code string, source string, weight double>>")
    got = rl.shown_reasons(rows)
    assert {(x["tx_id"], n): tuple(s) for x in got.collect() for n, s in enumerate(x["reasons"], 1)} == want
    assert got.columns == ["tx_id", "reasons"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_stand_beside_rows_as_columns(spark, boosted):
    """what a model says of a row is a column of it, and needs no join."""
    rows, _, _, paths = boosted
    forest = md.grown_forest(rows, NAMES, trees=5, sample=64)
    told = rows.withColumns({"anomaly": md.forest_column(forest, NAMES), "_phi": tr.attribution(paths, NAMES), "other": F.array("a")})
    got = {r["tx_id"]: r for r in told.collect()}
    for r in md.forest_scores(rows, forest, NAMES).join(tr.attributed(rows, paths, NAMES), "tx_id").collect():
        assert got[r["tx_id"]]["anomaly"] == r["anomaly"] and got[r["tx_id"]]["_phi"] == r["_phi"] and got[r["tx_id"]]["other"] == [r["a"]]

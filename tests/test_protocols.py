"""Bloom filters, protocols that refit, the registry, and how far a stream is."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import known as kn
from tidewatch.operators import models as md
from tidewatch.operators import protocols as pr
from tidewatch.operators import registry as rg
from tidewatch.operators import trees as tr
from tidewatch.streaming import monitor as mo
from tidewatch.streaming import streams as st


# --- known identifiers -----------------------------------------------------------------------------
def test_filters_hold_all_they_were_given_and_few_others(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("tx"), "id").alias("tx_id"), (F.col("id") % 3).alias("day"))
    filters = kn.bloom_filters(ids, "tx_id", F.col("day")).cache()
    assert [(r.slice, r.n) for r in filters.orderBy("slice").collect()] == [("0", 6667), ("1", 6667), ("2", 6666)]
    assert kn.with_maybe(ids, filters, "tx_id").where("not maybe").count() == 0
    others = spark.range(20_000, 120_000).select(F.concat(F.lit("tx"), "id").alias("tx_id"))
    rate = kn.with_maybe(others, filters, "tx_id").where("maybe").count() / 100_000
    assert rate < 3 * kn.ERROR_RATE * 1.5  # three slices
    # the same by halves, united
    halves = [kn.bloom_filters(ids.where(f"hash(tx_id) % 2 {op} 0"), "tx_id", F.col("day"), words=kn.shape(6667)[0]) for op in ("=", "<>")]
    both = kn.united(*halves)
    assert {r.slice: r.n for r in both.collect()} == {"0": 6667, "1": 6667, "2": 6666}
    assert kn.with_maybe(ids, both, "tx_id").where("not maybe").count() == 0


def test_filters_equal_a_plain_bit_array(spark):
    ids = spark.createDataFrame([(i,) for i in ("a", "b", "c", "a", None, "")], "tx_id string")
    row = kn.bloom_filters(ids, "tx_id").first()
    words, hashes = kn.shape(5)
    assert (len(row.bits), row.hashes, row.n) == (words, hashes, 5)
    positions = [r for i in range(hashes) for r in ids.where("tx_id is not null").select(F.pmod(F.xxhash64(F.lit(i), "tx_id"), F.lit(words * 64))).toPandas().iloc[:, 0]]
    plain = 0
    for p in positions:
        plain |= 1 << p
    assert sum((b % 2**64) << (64 * w) for w, b in enumerate(row.bits)) == plain


def test_filters_are_looked_up_block_by_block(spark):
    """No row of the lookup holds a whole filter, and filters of several sizes are asked side by side."""
    ids = spark.range(40_000).select(F.col("id").alias("tx_id"))
    large, small = kn.bloom_filters(ids, "tx_id"), kn.bloom_filters(spark.range(50_000, 50_010).select(F.col("id").alias("tx_id")), "tx_id", F.lit("few"))
    words = len(large.first().bits)
    assert words > 20 * kn.BLOCK
    asked = kn.with_maybe(spark.range(60_000).select(F.col("id").alias("tx_id")), large.unionByName(small).localCheckpoint(), "tx_id")
    assert asked.where("maybe and (tx_id < 40000 or tx_id between 50000 and 50009)").count() == 40_010
    assert asked.where("maybe").count() < 40_010 + 100
    assert "NestedLoop" not in asked._jdf.queryExecution().executedPlan().toString()


def test_arrivals_are_new_duplicate_or_conflict_and_few_are_looked_up(spark, monkeypatch):
    known = spark.range(5000).select(F.col("id").alias("tx_id"), F.lit("d").alias("digest"))
    arrivals = spark.range(4900, 9000).select(F.col("id").alias("tx_id"), F.when(F.col("id") % 2 == 0, "d").otherwise("e").alias("digest")).unionByName(spark.createDataFrame([(None, "d")], "tx_id long, digest string"))
    filters = kn.bloom_filters(known, "tx_id")
    got = {tuple(r) for r in kn.fates(arrivals, known, filters).groupBy("fate").count().collect()}
    assert got == {("duplicate", 50), ("conflict", 50), ("new", 4001)}
    assert kn.with_maybe(arrivals, filters, "tx_id").where("maybe").count() <= 100 + 25
    none = kn.bloom_filters(known.limit(0), "tx_id")
    assert kn.fates(arrivals, known.limit(0), none).where("fate <> 'new'").count() == 0
    monkeypatch.setattr(kn, "MAX_BROADCAST", 8)  # too large to send: the exact check decides alone
    assert {tuple(r) for r in kn.fates(arrivals, known, filters).groupBy("fate").count().collect()} == got
    monkeypatch.setattr(kn, "MAX_BITS", 1024)
    with pytest.raises(ValueError, match="finer"):
        kn.bloom_filters(known, "tx_id")


# --- protocols ------------------------------------------------------------------------------------------
COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def stepped(spark):
    r = random.Random(6)
    rows = []
    for i in range(900):
        a, b = r.random(), r.random()
        rows.append((i, i // 60 + 1, round(a, 3), round(b, 3), int(a + 0.3 * r.random() > 0.85)))
    return spark.createDataFrame(rows, "tx_id long, step int, a double, b double, y int").cache()


def test_no_row_is_scored_by_a_model_that_saw_its_step(stepped):
    got = pr.expanding_predictions(stepped, COLUMNS, "step", [(4, 6), (7, 8), (20, 30)], pr.boosted(3, 2)).collect()
    assert {r.step for r in got} == {4, 5, 6, 7, 8} and all(r.fitted_to == (3 if r.step <= 6 else 6) for r in got)
    alone = pr.boosted(3, 2)(stepped.where("step < 7"), COLUMNS)(stepped.where("step between 7 and 8")).collect()
    assert {r.tx_id: r.p for r in alone} == pytest.approx({r.tx_id: r.p for r in got if r.step > 6})
    assert pr.expanding_predictions(stepped, COLUMNS, "step", [(1, 2)], pr.boosted(3, 2)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        pr.expanding_predictions(stepped, COLUMNS, "step", [(4, 6), (6, 8)], pr.boosted(3, 2))


def test_the_protocol_takes_its_threshold_from_inside_training(stepped):
    fit, folds = pr.boosted(3, 2), [(4, 6), (7, 9), (11, 12)]
    got = {r.name: r for r in pr.temporal_protocol(stepped, {"a": ["a"], "b": ["b"], "both": COLUMNS}, "step", 10, folds, fit, order=["tx_id"], rounds=30).collect()}
    inside = pr.expanding_predictions(stepped.where("step <= 10"), COLUMNS, "step", folds[:2], fit).toPandas()
    f1 = lambda y, hit: 2 * (y & hit).sum() / max(1, y.sum() + hit.sum())
    y = inside.y.to_numpy() == 1
    best = max((f1(y, inside.p.to_numpy() >= t), t) for t in inside.p.unique())
    assert got["both"].threshold == pytest.approx(best[1])
    test = fit(stepped.where("step <= 10"), COLUMNS)(stepped.where("step > 10")).toPandas()
    y, hit = test.y.to_numpy() == 1, test.p.to_numpy() >= best[1]
    assert got["both"].f1 == pytest.approx(f1(y, hit), abs=1e-4) and got["both"].recall == pytest.approx((y & hit).sum() / y.sum(), abs=1e-4)
    assert got["both"].low <= got["both"].f1 <= got["both"].high and got["a"].f1 > got["b"].f1


def test_learned_scores_are_drawn_once_for_all_layers(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, int(r.random() < 0.2), r.random(), r.random(), r.random(), 10.0 * r.random()) for i in range(400)]
    scored = spark.createDataFrame(rows, "tx_id long, y int, gbm double, anomaly double, hybrid double, amount double").withColumn("gbm", F.col("gbm") + F.col("y"))
    calls, plain = [], pr.ev.drawn
    monkeypatch.setattr(pr.ev, "drawn", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {x.layer: x for x in pr.learned_only_protocol(scored, ["tx_id"], rounds=20).collect()}
    assert len(calls) == 1
    assert all(x.pr_auc_low <= x.pr_auc_high for x in got.values()) and got["gbm"].pr_auc == 1.0 == got["gbm"].pr_auc_low
    assert got["gbm"].gain is None and got["anomaly"].gain < -0.5 and got["hybrid"].verdict == "harm"
    assert got["anomaly"].gain_high == pytest.approx(got["anomaly"].pr_auc_high - 1, abs=2e-4)


def test_ablation_refits_without_a_group(stepped):
    got = {r.group: r for r in pr.feature_ablation(stepped.where("step <= 10"), stepped.where("step > 10"), COLUMNS, {"of_a": ["a"], "of_b": ["b"]}, pr.boosted(3, 2)).collect()}
    assert got[""].loss == 0 and got["of_a"].loss > 0.3 > abs(got["of_b"].loss)
    assert got["of_a"].loss == pytest.approx(got[""].pr_auc - got["of_a"].pr_auc, abs=2e-6)


# --- registry ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def bundle(stepped):
    model = md.boosted_model(stepped, COLUMNS, rounds=3, depth=2)
    forest = md.grown_forest(stepped, COLUMNS, trees=10, sample=64)
    knots = md.quantile_points(md.forest_scores(stepped.select("tx_id", *COLUMNS), forest, COLUMNS), "anomaly")
    return rg.Bundle(model, COLUMNS, forest, knots, {"ml_score": 1.1, "anomaly_score": 0.2}, -0.4, {"note": "küçük"})


def test_a_reloaded_bundle_scores_as_before(spark, stepped, bundle, tmp_path):
    folder = f"file://{tmp_path}/v1"
    rg.save_bundle(bundle, folder)
    again = rg.load_bundle(spark, folder)
    told = lambda b: {r.tx_id: (r.ml_score, r.anomaly_score, r.stacked) for r in b.stacked(b.scores(stepped)).collect()}
    assert told(again) == told(bundle) and again.about == bundle.about
    assert tr.expected(again.paths(spark, folder)) == pytest.approx(tr.expected(tr.paths(tr.nodes(bundle.model))))
    with pytest.raises(rg.RegistryError, match="already"):
        rg.save_bundle(bundle, folder)
    with pytest.raises(rg.RegistryError, match="no bundle"):
        rg.load_bundle(spark, f"file://{tmp_path}/none")


def test_registry_roles_and_conflicts(spark, bundle, tmp_path):
    reg = rg.Registry(spark, f"file://{tmp_path}/registry")
    assert reg.load_role("champion") is None and reg.models().count() == 0
    reg.register("v1", bundle, {"pr_auc": 0.5})
    reg.promote("v1")
    reg.register("v2", bundle, {"pr_auc": 0.6})
    reg.register("v3", bundle, {"pr_auc": 0.7})
    before = reg.read()
    assert (before["champion"], before["challenger"]) == ("v1", "v3")
    assert {r.version: r.status for r in reg.models().collect()} == {"v1": "champion", "v2": "archived", "v3": "challenger"}
    # two writers that have read one state: the second fails and changes nothing
    after = reg.promote("v3", state=before)
    with pytest.raises(rg.Conflict):
        reg.promote("v2", state=before)
    assert reg.read() == after and (after["champion"], after["challenger"]) == ("v3", None) and after["models"]["v1"]["status"] == "archived"
    reg.restore(before)
    assert {k: reg.read()[k] for k in ("champion", "challenger", "models")} == {k: before[k] for k in ("champion", "challenger", "models")}
    reg.set_status("v3", "archived")
    assert reg.load_role("challenger") is None and reg.load_role("champion").columns == COLUMNS
    for bad in (lambda: reg.promote("v9"), lambda: reg.set_status("v1", "challenger"), lambda: reg.set_status("v1", "king"), lambda: reg.register("../x", bundle, {}), lambda: reg.register("v1", bundle, {})):
        with pytest.raises(rg.RegistryError):
            bad()


# --- how far a stream is ------------------------------------------------------------------------------------
def test_backlog_and_keys_of_a_stopped_stream(spark, tmp_path):
    folder, ck = f"{tmp_path}/in", f"file://{tmp_path}/ck"
    rows = [(i, i % 7, float(i)) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(folder)
    listener = mo.ProgressTable(spark, f"file://{tmp_path}/progress")

    def run() -> None:
        s = spark.readStream.schema("event_id long, user_id long, value double").parquet(folder).withColumn("ts", F.timestamp_seconds("event_id"))
        q = st.running_profiles(s).writeStream.outputMode("update").option("checkpointLocation", ck).format("memory").queryName("q").trigger(availableNow=True).start()
        q.awaitTermination()

    assert tuple(mo.backlog(spark, ck, [folder]).first()) == (0, 3, 0, 0, 3)
    spark.streams.addListener(listener)
    try:
        run()
        spark.createDataFrame(rows[:5], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(folder)
        assert tuple(mo.backlog(spark, ck, [folder]).first()) == (0, 4, 3, 0, 1)
        assert mo.state_keys(spark, ck).agg(F.sum("keys")).first()[0] == 7
        # a batch that was taken but not committed is pending
        last = max(int(p.name) for p in (tmp_path / "ck/commits").iterdir() if p.name.isdigit())
        (tmp_path / f"ck/commits/{last}").rename(tmp_path / "kept")
        assert tuple(mo.backlog(spark, ck, [folder]).first())[2:] == (0, 3, 1)
        (tmp_path / "kept").rename(tmp_path / f"ck/commits/{last}")
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.streams.removeListener(listener)
    told = spark.read.schema(mo.PROGRESS).parquet(f"{tmp_path}/progress")
    assert told.agg(F.sum("rows"), F.max("state_rows")).first()[:] == (90, 7)
    assert np.isfinite(told.first().rows_per_second)

"""The pipeline's stages on the smallest tables, each judged on its own input."""

import corpus_pipeline as cp
from tidewatch.llm import decontam, minhash
from tidewatch.llm.store import materialise


def test_stages_keep_the_schema_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    by = {}
    at = docs
    for name, stage in cp.STAGES[:-1]:
        by[name] = (at, materialise(stage(spark, at, sf), name))
        at = by[name][1]
        assert at.columns == docs.columns and at.count() <= by[name][0].count()
    _, kept = by["quality_classifier"]
    toxic = labels.where("toxic = 1 or quality = 0").select("doc_id")
    clean = labels.where("toxic = 0 and quality = 1").select("doc_id")
    assert kept.join(toxic, "doc_id").count() <= 0.3 * toxic.count()
    assert kept.join(clean, "doc_id").count() >= 0.95 * clean.count()
    _, near = by["near_dedup"]
    classes = minhash.near_duplicates(near).collect()
    assert all(r["kept"] for r in classes)
    _, last = by["benchmark_decontamination"]
    assert decontam.leaks(last, bench).count() == 0
    packed = cp.STAGES[-1][1](spark, at, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][-1] == "packing"

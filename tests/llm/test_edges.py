"""Nulls, repeats, clashing columns, empty tables and very long texts, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_text_ops import DOC, docs, plain_classes, plain_jaccard, words
from tidewatch.llm import chaining, chat, decontam, langid, linededup, minhash, packing, quality, sharding, store
from tidewatch.llm.queries import word_tokenizer

CLASHES = ["_did", "_xx", "_again", "_dk", "_gone", "_removed", "_lines", "_uid", "_part", "_r", "_z", "_piece", "_n", "node", "bucket", "did", "rep", "class_size", "Text_", "seed", "doc", "key", "log_weight"]


def clashing(spark, rows):
    df = docs(spark, rows)
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def unchanged(before, after):
    """Whether all columns of the rows that stayed are as they were."""
    old = {r["doc_id"]: r for r in before.collect()}
    assert after.columns == before.columns
    return all(r[c] == old[r["doc_id"]][c] for r in after.collect() for c in CLASHES)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ROWS = [(i, " ".join(words(60, i))) for i in range(12)] + [(20, None), (21, ""), (None, " ".join(words(60, 3))), (22, "\n".join(["a line"] * 3)), (23, " ".join(words(60, 2)))]


def test_columns_of_any_name_stay(spark):
    d = clashing(spark, ROWS)
    bench = spark.createDataFrame([(1, " ".join(words(60, 5)[10:30])), (None, None)], "item_id long, text string")
    lab = labels(spark, [(i, 1, 0) for i in range(6)] + [(i, 0, 0) for i in range(6, 9)])
    kept = {"near": minhash.without_near_duplicates(d), "lines": linededup.cleaned(d), "leaks": decontam.without_leaks(d, bench), "quality": quality.accepted(d, lab, k=9)}
    assert all(unchanged(d, x) for x in kept.values())
    assert sharding.shuffle_to_shards(d, 3).columns == [*d.columns, "shard", "slot"] and unchanged(d, sharding.shuffle_to_shards(d, 3).drop("shard", "slot"))
    assert {r["doc_id"] for r in kept["near"].collect()} == {*range(12), 20, 21, 22}
    assert 5 not in {r["doc_id"] for r in kept["leaks"].collect()}


def test_empty_tables_give_empty_results(spark):
    none, bench, lab = docs(spark, []), spark.createDataFrame([], "item_id long, text string"), labels(spark, [])
    for out in (minhash.near_duplicates(none), minhash.without_near_duplicates(none), linededup.cleaned(none), decontam.without_leaks(none, bench), quality.accepted(none, lab), chaining.passages(none), packing.pack(none, word_tokenizer()), langid.predict(none), sharding.shard_report(none)):
        assert out.count() == 0


def test_repeated_rows_and_a_very_long_text(spark):
    long = " ".join(words(150_000, 1, 10**6))
    rows = [(1, long), (2, long + " x"), (3, "a b"), (3, "a b"), (4, None), (4, None)]
    d = docs(spark, rows)
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(d).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4), (4, 4)]
    assert sorted(r["doc_id"] for r in minhash.without_near_duplicates(d).collect()) == [1, 3, 4, 4]
    assert [(r["doc_id"], r["start_word"], r["end_word"], r["source_id"]) for r in chaining.passages(d).collect()] == [(2, 0, 150_000, 1)]
    packed = packing.pack(d, word_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in packed if r["doc_id"] in (1, 2)) and {r["doc_id"]: r["n"] for r in packed}[4] == 2
    bench = spark.createDataFrame([(1, " ".join(long.split()[90_000:90_030])), (1, " ".join(long.split()[90_000:90_030]))], "item_id long, text string")
    assert {(r["doc_id"], r["place"]) for r in decontam.leaks(d, bench).collect()} == {(1, 90_000), (2, 90_000)}
    assert linededup.line_report(d).count() == 6 and langid.predict(d).count() == 6
    assert quality.resample(d, labels(spark, [(1, 1, 0)]), k=6).count() == 6


# --- op1 ------------------------------------------------------------------------------
def test_a_large_group_of_near_copies_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    r, base, rows = random.Random(3), words(60, 3, 10**6), []
    for i in range(240):  # far from a common centre, so that many pairs share buckets without being alike
        w = list(base)
        for j in r.sample(range(60), r.randrange(0, 4)):
            w[j] = f"z{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_recall_of_links_at_the_threshold(spark):
    r, rows, linked = random.Random(5), [], 0
    for i in range(150):
        w = words(100, 1000 + i, 10**6)
        v = list(w)
        for j in r.sample(range(100), r.choice((2, 3, 4))):
            v[j] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    for i in range(150):
        if plain_jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8:
            linked += 1
            assert got[2 * i] == got[2 * i + 1]
        else:
            assert got[2 * i] != got[2 * i + 1]
    assert 20 < linked < 150


# --- op2 ------------------------------------------------------------------------------
def test_a_log_folds_back_into_its_messages(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "wörld 😀!"), (1, 2, "assistant", ""), (1, 3, None, None), (None, 0, "assistant", "x"), (2, 0, "user", "a" * 300_000)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.event_log(m)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"delta", "regenerate", "message", "edit"}
    assert {tuple(r) for r in chat.fold_events(log).collect()} == {(c, t, r or "", x or "") for c, t, r, x in rows}
    odd = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "assistant", "a"), (1, 0, None, None)], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9)).withColumn("kind", F.lit("delete"))
    r = chat.chat_report(odd).where("conv_id = 1").first()
    assert (r["n_turns"], r["loss_chars"]) == (4, 1)


# --- op3 ------------------------------------------------------------------------------
def test_every_text_of_an_id_and_texts_without_id_count(spark):
    p, q = words(100, 61, 10**6), words(80, 62, 10**6)
    rows = [(5, " ".join(words(30, 63, 10**6) + p)), (5, " ".join(words(300, 64, 10**6) + q)), (7, " ".join(p + words(9, 65, 10**6))), (8, " ".join(q)), (None, " ".join(words(4, 66, 10**6) + q)), (None, " ".join(words(4, 66, 10**6) + q)), (-(2**63), "x")]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in chaining.passages(docs(spark, rows)).collect()}
    assert (7, 0, 100) in got and (8, 0, 80) in got
    # one of the two texts that hold q and have no number of their own repeats the other
    assert len(got) == 3 and {(None, 4, 84), (5, 300, 380)} & got


def test_repeats_within_a_document_are_told_if_asked_for(spark):
    p = words(70, 71, 10**6)
    d = docs(spark, [(1, " ".join(p + words(40, 72, 10**6) + p)), (2, "x y")])
    assert chaining.passages(d).count() == 0
    assert [tuple(r) for r in chaining.passages(d, within=True).collect()] == [(1, 110, 180, 1, 0, 70, 70)]


def plain_passages(rows):
    """Documents' words that repeat an earlier one's, from all common k-mers of each pair."""
    ids = [i for i, t in sorted(rows) if t]
    texts = {i: t.lower().split() for i, t in rows if t}
    import numpy as np

    number = {}
    coded = {i: np.array([number.setdefault(w, len(number) + 1) for w in t], np.uint64) for i, t in texts.items()}
    out = {}
    for n, b in enumerate(ids):
        for a in ids[:n]:
            at = {}
            for y in range(len(texts[a]) - chaining.K + 1):
                at.setdefault(tuple(texts[a][y : y + chaining.K]), []).append(y)
            xy = sorted((x, y) for x in range(len(texts[b]) - chaining.K + 1) for y in at.get(tuple(texts[b][x : x + chaining.K]), ()))
            if xy:
                xs, ys = (np.array(c) for c in zip(*xy))
                for chain in chaining.chains(chaining.merge(xs, ys, chaining.K)):
                    x0, x1, y0, y1, m = chaining.align(coded[b], coded[a], chain)
                    if x1 - x0 >= chaining.MIN_WORDS and m >= chaining.IDENTITY * max(x1 - x0, y1 - y0):
                        out.setdefault(b, set()).update(range(x0, x1))
    return out


def test_passages_equal_brute_force_over_all_k_mers(spark):
    r = random.Random(9)
    pool = [words(n, 500 + n, 10**6) for n in (55, 70, 120, 200)]
    rows = []
    for i in range(24):
        w = words(r.randrange(5, 60), 600 + i, 10**6)
        for _ in range(r.randrange(0, 3)):  # up to two passages a document, some changed in a few places
            p = list(r.choice(pool))
            for j in range(r.randrange(14, 30), len(p), 23):
                p[j] = f"c{i}"
            w += p + words(r.randrange(0, 90), 700 + i, 10**6)
        rows.append((i, " ".join(w)))
    want, got = plain_passages(rows), {}
    for x in chaining.passages(docs(spark, rows)).collect():
        got.setdefault(x["doc_id"], set()).update(range(x["start_word"], x["end_word"]))
    both = sum(len(want[i] & got.get(i, set())) for i in want)
    assert set(got) == set(want) and both >= 0.97 * sum(map(len, want.values())) and both >= 0.97 * sum(map(len, got.values()))


@pytest.mark.parametrize("every,least", [(25, 1.0), (17, 0.9)])
def test_recall_by_identity(spark, every, least):
    rows, n = [], 40
    for i in range(n):
        p = words(80, 800 + i, 10**6)
        v = [f"v{i}" if j % every == every // 2 else w for j, w in enumerate(p)]
        rows += [(2 * i, " ".join(p)), (2 * i + 1, " ".join(v))]
    found = {(x["doc_id"], x["source_id"]) for x in chaining.passages(docs(spark, rows)).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(n)} and len(found) >= least * n


@pytest.mark.parametrize("period", [1, 2, 5, 10, 12, 13, 30])
def test_passages_of_texts_that_repeat_themselves(spark, period):
    sentence = words(period, 900 + period, 10**6)
    told = (sentence * 300)[:300]
    rows = [(1, " ".join(told)), (2, " ".join(words(40, 1, 10**6) + told + words(25, 2, 10**6))), (3, " ".join(told)), (4, " ".join(words(7, 3, 10**6) + told[:60])), (5, " ".join(words(80, 4, 10**6) + told[:30]))]
    covered = {}
    for x in chaining.passages(docs(spark, rows)).collect():
        assert x["source_id"] < x["doc_id"] and x["matched"] >= 0.8 * (x["end_word"] - x["start_word"])
        covered.setdefault(x["doc_id"], set()).update(range(x["start_word"], x["end_word"]))
    assert set(covered) == {2, 3, 4}
    assert covered[3] == set(range(300)) and set(range(40, 340)) <= covered[2] and set(range(7, 67)) <= covered[4]


# --- store ----------------------------------------------------------------------------
def test_scratch_tables_go_and_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with store.Scratch() as scratch:
        df = scratch.keep(spark.range(5), "some")
        path = df.inputFiles()[0].replace("file://", "")
        assert df.count() == 5
    import os

    assert not os.path.exists(path) and spark.conf.get(key) == before
    assert store.free_name(spark.range(1).withColumn("_X", F.lit(1)), "_x") == "_x_"


# --- pipeline -------------------------------------------------------------------------
def test_stages_with_nulls_repeats_and_nothing(spark, sf):
    extra = [(None, None), (-1, ""), (-1, ""), (-2, None), (None, "x y z " * 30)]
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(0).union(docs(spark, ROWS + extra))
    for _, stage in cp.STAGES[:-1]:
        for df in (d, docs(spark, [])):
            out = stage(spark, df, sf)
            assert out.columns == df.columns and out.count() <= df.count()
    assert cp.STAGES[-1][1](spark, d, sf).select("doc_id").distinct().count() == len({i for i, _ in ROWS + extra})
    assert cp.STAGES[-1][1](spark, docs(spark, []), sf).count() == 0
    assert DOC.startswith("doc_id")

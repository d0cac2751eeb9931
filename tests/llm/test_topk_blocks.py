"""Exact top-k over many blocks and slices, with repeated rows and shared identifiers."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import store, topk


def _brute(rows, is_query, k):
    good = [(i, np.floor(256 * np.array(v, np.float64)), v) for i, v in rows]
    firsts = {}
    for i, x, v in good:
        if is_query(i) and (i not in firsts or v < firsts[i][1]):
            firsts[i] = (x, v)
    out = set()
    for q, (x, _) in firsts.items():
        best = sorted((-int(x @ y), c) for c, y, _ in good if c != q)[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


def _got(df, k):
    return {tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, k).collect()}


def test_many_blocks_slices_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(topk, "SLICE_BLOCKS", 2)
    rng = np.random.default_rng(4)
    # a third of all rows are one vector: ties by the hundred
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 == 0 else [float(x) for x in rng.integers(-4, 5, 3) / 8]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    assert _got(df, 5) == _brute(rows, lambda i: i % 10 == 0, 5)


def test_repeated_rows_and_equal_query_identifiers(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 1.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, 4).collect())
    # the smallest vector of identifier 0 asks; each of the two equal rows of identifier 1 is a candidate
    assert [r for r in got if r[0] == 0] == [(0, 1, 2, 65536), (0, 2, 1, 32768), (0, 3, 1, 32768), (0, 4, 10, 32768)]
    assert [r[2] for r in got if r[0] == 10] == [0, 2, 0, 0]


def test_only_the_result_stays_in_the_shared_folder(spark):
    folder = Path(store.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, 3).count() == 12
    assert [p.name.split("-")[0] for p in folder.iterdir() if p.name not in before] == ["nearest"]

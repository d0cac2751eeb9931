"""Exact quantiles by ranges, and nearest vectors by block products, against slow restatements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import matching as mt
from tidewatch.operators import metrics as mx
from tidewatch.operators import models as md

POINTS = [0.0, 0.1, 0.25, 0.5, 0.95, 0.99, 1.0]


def test_quantiles_equal_numpy_for_hot_null_and_small_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": [float(x) for x in rng.integers(0, 40, 3000)], "one": [4.0], "two": [1.0, 2.0], None: [5.0, 5.0, 9.0], "none": [None, None]}
    df = spark.createDataFrame([(g, v, "x") for g, vs in groups.items() for v in vs], "g string, v double, _n string").repartition(7)
    got = {(r["g"], r["point"]): r["value"] for r in mx.quantiles(df.drop("_n"), "v", POINTS, by=["g"]).collect()}
    assert {g for g, _ in got} == {"hot", "one", "two", None}
    for (g, p), value in got.items():
        assert value == pytest.approx(np.quantile(groups[g], p), abs=1e-12), (g, p)
    assert len(got) == 4 * len(POINTS)


def test_quantiles_of_nothing_and_of_infinities(spark):
    empty = spark.createDataFrame([], "v double")
    assert mx.quantiles(empty, "v", POINTS).count() == 0 and md.quantile_points(empty, "v") == []
    assert mx.reference_edges(empty, "v").first()["edges"] is None
    odd = spark.createDataFrame([(-math.inf,), (1.0,), (math.inf,), (None,)], "v double")
    assert [r["value"] for r in mx.quantiles(odd, "v", [0.0, 0.5, 1.0]).orderBy("point").collect()] == [-math.inf, 1.0, math.inf]


def _slow(queries, rows, k):
    out = {}
    for q, s, x in queries:
        found = []
        for v, t, y in rows:
            if v is None or v == q or s != t:
                continue
            ok = all(z and all(c is not None and math.isfinite(c) for c in z) and any(z) for z in (x, y)) and len(x) == len(y)
            found.append((-round(float(np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y))), 6) if ok else math.inf, v))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("same", [None, "s"])
def test_neighbours_equal_all_pairs_with_odd_vectors_and_a_hot_group(spark, same, monkeypatch):
    monkeypatch.setattr(mt, "SLICE", 40)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 10 > 6), [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(240)]
    rows += [(300, 0, [0.0] * 4), (301, 0, None), (302, 0, []), (303, 0, [1.0, None, 2.0, 1.0]), (304, 1, [1.0, 2.0]), (305, 1, [math.nan, 1.0, 1.0, 1.0]), (None, 0, [1.0] * 4), (306, 9, [1.0] * 4), (307, 9, [0.0] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, s int, embedding array<double>, rank string")
    queries = [r for r in rows if r[0] is not None and (r[0] % 25 == 0 or r[0] >= 300)]
    got = {}
    picked = df.where("vec_id % 25 = 0 or vec_id >= 300")
    for r in mt.cosine_neighbours(picked, df, 4, same=same).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((math.inf if r["cosine"] is None else -r["cosine"], r["v_id"]))
    want = _slow([(q, s if same else 0, x) for q, s, x in queries], [(v, s if same else 0, y) for v, s, y in rows], 4)
    assert got == {q: [(pytest.approx(c), v) for c, v in w] for q, w in want.items() if w}


def test_neighbours_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mt.cosine_neighbours(empty, empty, 3).count() == 0

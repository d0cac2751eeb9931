"""The graph that grows by increments, and sketches of distributions, against plain restatements."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import frames as fr
from tidewatch.operators import livegraph as lg
from tidewatch.operators import sketch as sk

TX = "tx_id long, us long, cust long, amount double, payee string, device string"


def payments(n, seed, nodes=14, days=12):
    r = random.Random(seed)
    return [(i, r.randrange(days) * fr.DAY + r.randrange(1000), r.randrange(nodes), round(r.random() * 90, 2), r.choice([f"p{r.randrange(nodes)}", "", None]), r.choice([f"d{r.randrange(nodes)}", "", None])) for i in range(n)]


def rebuilt(rows, days):
    """Edges and components of all payments at once."""
    ends = [(f"C:{r[2]}", e, r[1], a) for r in rows for e, a in ((f"A:{r[4]}" if r[4] else None, r[3]), (f"D:{r[5]}" if r[5] else None, 0.0)) if e]
    if not ends:
        return {}, {}
    first = max(e[2] // fr.DAY for e in ends) - days
    edges, parent = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, us, amount in ends:
        if us // fr.DAY >= first:
            n, total, last = edges.get((a, b), (0, 0.0, 0))
            edges[a, b] = (n + 1, round(total + amount, 2), max(last, us))
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return edges, {x: root(x) for x in parent}


@pytest.mark.parametrize("order", [(2, 0, 1)])
def test_increments_in_any_order_equal_a_rebuild(spark, order):
    rows = payments(36, 2)
    parts = [[r for r in rows if r[0] % 3 == k] for k in order]
    # a last increment of one late day, which pushes much out of the window, and an empty one
    parts += [[(99, 16 * fr.DAY, 1, 5.0, "p1", "d0")], []]
    state, seen = lg.empty(spark), []
    for part in parts:
        state = lg.observe(state, spark.createDataFrame(part, TX), 6)
        seen += part
        edges, labels = rebuilt(seen, 6)
        got = state.labels.collect()
        assert len(got) == len(labels) and {r.node: r.component for r in got} == labels
        assert {(r.a, r.b): (r.n, round(float(r.total), 2), r.last_us) for r in state.edges().collect()} == edges
    assert len(set(labels.values())) > 1


# --- sketches --------------------------------------------------------------------------------------
def test_quantiles_of_merged_sketches_are_within_the_error(spark):
    r = random.Random(4)
    values = [r.lognormvariate(3, 2) for _ in range(3000)] + [-r.random() * 50 for _ in range(500)] + [0.0] * 200 + [None, float("nan")]
    rows = spark.createDataFrame([(i, i % 7, v) for i, v in enumerate(values)], "i long, day long, x double")
    days = sk.sketches(rows, ["x"], ["day"])
    whole = sk.merged(days)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sk.sketches(rows, ["x"]).collect()))
    points = [0.0, 0.01, 0.1, 0.2, 0.5, 0.9, 0.99, 1.0]
    told = sorted(v for v in values if v is not None and not math.isnan(v))
    got = {q.point: q.value for q in sk.quantiles(whole, points).collect()}
    for p in points:
        want = told[math.floor(p * (len(told) - 1))]
        assert got[p] == pytest.approx(want, rel=sk.ERROR * 1.0001, abs=1e-9)
        # the rank of the value told is that of a value within the error
        assert np.searchsorted(told, want - sk.ERROR * abs(want) - 1e-9) <= math.floor(p * (len(told) - 1)) <= np.searchsorted(told, want + sk.ERROR * abs(want) + 1e-9, side="right")
    order = [b.bucket for b in rows.where("x is not null and not isnan(x)").select(sk.bucket(F.col("x")).alias("bucket"), "x").orderBy("x").collect()]
    assert all(a <= b for a, b in itertools.pairwise(order))


def test_drift_of_sketches_equals_the_index_over_the_same_bins(spark):
    r = random.Random(5)
    e, a = [r.gauss(100, 15) for _ in range(2000)], [r.gauss(108, 15) for _ in range(700)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    got = sk.drift(sk.sketches(frame(e), ["x"]), sk.sketches(frame(a), ["x"])).collect()
    cuts = sorted({float(q.value) for q in sk.quantiles(sk.sketches(frame(e), ["x"]), [i / 10 for i in range(1, 10)]).collect()})
    tops = [c * (1 + sk._G) / 2 for c in cuts]  # the upper border of each cut's bucket
    share = lambda v: np.array([(np.bincount(np.searchsorted(tops, v, side="left"), minlength=len(tops) + 1)[i] / len(v) + 1e-4) / (1 + 1e-4 * (len(tops) + 1)) for i in range(len(tops) + 1)])
    p, q = share(e), share(a)
    assert got[0].psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()), rel=1e-6) and got[0].psi > 0.1
    same = sk.drift(sk.sketches(frame(e), ["x"]), sk.sketches(frame(e), ["x"])).first().psi
    assert same == pytest.approx(0) and sk.drift(sk.sketches(frame(e), ["x"]), sk.sketches(frame([]), ["x"])).count() == 0

"""Work that must not grow faster than the input, against plain restatements."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewatch.operators import features as ft
from tidewatch.operators import frames as fr
from tidewatch.operators import graph as gr
from tidewatch.operators import profile as pf
from tidewatch.operators import signals as sg
from tidewatch.plans import full


# --- communities ------------------------------------------------------------------------------
def _louvain(edges, halves, least=1e-4):
    """The same rounds over plain dicts, and how many there were."""
    level = defaultdict(float)
    for a, b, w in edges:
        level[a, b] += w
        level[b, a] += w
    twice = sum(level.values())
    member, rounds = {n: n for n, _ in level}, 0
    while True:
        k = defaultdict(float)
        for (a, _), w in level.items():
            k[a] += w
        labels = {n: n for n in k}

        def quality(of):
            tot = Counter()
            for n, c in of.items():
                tot[c] += k[n]
            return sum(w for (a, b), w in level.items() if of[a] == of[b]) / twice - sum((t / twice) ** 2 for t in tot.values())

        start = best = quality(labels)
        kept, idle, turn = labels, 0, 0
        while idle < 2:
            tot, inner = Counter(), defaultdict(float)
            for n, c in labels.items():
                tot[c] += k[n]
            for (a, b), w in level.items():
                if a != b:
                    inner[a, labels[b]] += w
            moved = dict(labels)
            for n, c in labels.items():
                gains = {to: round(w - k[n] * (tot[to] - (k[n] if to == c else 0)) / twice, 9) for (a, to), w in inner.items() if a == n}
                if gains and halves[n] == turn % 2:
                    top = max(gains.values())
                    if top > gains.get(c, round(-k[n] * (tot[c] - k[n]) / twice, 9)):
                        moved[n] = min(to for to, g in gains.items() if g == top)
            labels, turn, rounds = moved, turn + 1, rounds + 1
            now = quality(labels)
            idle = 0 if now > best + least else idle + 1
            if now > best:
                kept, best = labels, now
        if best <= start + least:
            return member, rounds
        member = {n: kept[c] for n, c in member.items()}
        up = defaultdict(float)
        for (a, b), w in level.items():
            up[kept[a], kept[b]] += w
        level = up


def test_louvain_rounds_equal_a_restatement_in_few_jobs(spark):
    r = random.Random(4)
    name = lambda i: f"C:{i}"  # noqa: E731  (numbers and their names have different orders)
    edges = [(name(a), name(b), float(r.randrange(1, 9))) for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(200)) if a != b]
    edges += [(name(a), name(b), 4.0) for g in range(0, 120, 6) for a in range(g, g + 6) for b in range(g, a)]
    df = spark.createDataFrame(edges, "a string, b string, w double").coalesce(1)
    halves = {x["a"]: x["h"] for x in df.select("a").union(df.select("b")).distinct().select("a", F.pmod(F.xxhash64("a"), F.lit(2)).alias("h")).collect()}
    group = "louvain-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {x["node"]: x["community"] for x in sg.modularity_communities(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want, rounds = _louvain(edges, halves)
    assert got == want and 1 < len(set(got.values())) < 60
    # a round sends every link once, which gives the moves and the modularity
    assert jobs <= 17 * rounds


# --- the full pass ----------------------------------------------------------------------------
def test_full_pass_scores_payments_once(spark, sf):
    seen = spark.sparkContext.accumulator(0)

    def scored(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = full.payments(spark, sf).where("tx_id < 60").coalesce(1)
    n = t.count()
    x = t.withColumn("ml_score", F.lit(0.3)).drop("session", "avg_amount", "payee_opened")
    x = x.mapInArrow(scored, x.schema).join(t.select("tx_id", "session", "avg_amount", "payee_opened"), "tx_id")
    out = full.sc.full_pass(x, full.surroundings(spark, sf)).select("tx_id", "decision")
    assert out.count() == n and seen.value == n


def test_histories_of_ints_are_sums_of_longs(spark):
    df = spark.createDataFrame([(i, i * fr.HOUR, 1, 0.1 * i) for i in range(50)], "tx_id long, us long, cust long, amount double")
    out = fr.sums_before(df, ["cust"], {"n": (3 * fr.HOUR, F.lit(1)), "s": (3 * fr.HOUR, F.col("amount"))})
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["s"].startswith("decimal")
    for r in out.collect():
        before = range(max(0, r.tx_id - 2), r.tx_id)
        assert r.n == len(before) and abs(float(r.s) - sum(0.1 * i for i in before)) < 1e-9


def test_features_are_dealt_once_for_each_key(spark, sf):
    """rows go to a key before they become lines of entries and exits, so the lines are not sent."""
    t = full.payments(spark, sf)
    plan = ft.features(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    line = fr.distinct_before(t.select("tx_id", "us", "cust", "payee"), ["payee"], F.col("cust"), {"n": fr.DAY})
    assert line._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_histories_hold_what_features_and_profiles_tell(spark, sf):
    """histories are made once, and the learned pass, its model and its signals read them."""
    t = full.payments(spark, sf)
    got = {r["tx_id"]: r.asDict() for r in full.sc.histories(t, ["trusted"]).collect()}
    assert len(got) == t.count() and "trusted" in got[0]
    for part in (ft.features(t), pf.profile_features(t).select("tx_id", *full.sc.PROFILE), ft.session_features(t)):
        assert all(got[r["tx_id"]][n] == v for r in part.collect() for n, v in r.asDict().items())


# --- graphs --------------------------------------------------------------------------------------
def _counted(spark, df):
    """The rows of ``df``, and how many of them have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_graph_rounds_read_the_edges_once(spark):
    r = random.Random(1)
    pairs = [(r.randrange(20), r.randrange(20)) for _ in range(60)]
    edges, made = _counted(spark, spark.createDataFrame(pairs, "src long, dst long").coalesce(1))
    nodes = spark.range(20).select(F.col("id").alias("node"), (F.col("id") % 2).alias("step"))
    assert sg.step_graph(nodes, edges, 3).count() == 20 and made.value == 60
    edges, made = _counted(spark, spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double").coalesce(1))
    got = {x["node"]: x["rank"] for x in gr.pagerank(edges, 6).collect()}
    assert made.value == 60
    names = sorted({n for p in pairs for n in p})
    rank = dict.fromkeys(names, 1 / len(names))
    total = Counter(a for a, _ in pairs)
    for _ in range(6):
        lost = sum(v for n, v in rank.items() if not total[n])
        sent = defaultdict(float)
        for a, b in pairs:
            sent[b] += rank[a] / total[a]
        rank = {n: 0.15 / len(names) + 0.85 * (sent[n] + lost / len(names)) for n in names}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in names)


def test_first_letters_beyond_ascii_are_tried_behind_one_test(spark):
    """of a word that begins in ASCII no class with other letters is asked; names are found in any case and marks as before."""
    import re

    from tidewatch.operators import documents as dc

    p = dc.person_pattern()
    start, guard = p.index("(?:") + 3, "(?=[^\\x00-\\x7F])"
    heads = re.findall(r"(?:^|\|)\[([^\]]+)\]\(\?:", p[start : p.index(guard)])
    assert len(heads) > 15 and all(h.isascii() for h in heads)
    texts = [("ŞERİFE yılmaz", 1), ("serife Yılmaz", 1), ("ömer Şahin, Omer sahin", 2), ("Çan Demir", 0), ("can demir", 0), ("Can Demir", 1), ("İbrahim ve", 0), ("xAli Demir", 0), ("özlem Ayşe Kaya", 1)]
    rows = spark.createDataFrame(texts, "text string, n int")
    got = rows.select("text", "n", F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("got")).collect()
    assert [(r["text"], r["got"]) for r in got] == texts

"""Streams with timers against the batch forms and slow restatements."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features as ft
from tidewatch.operators import frames as fr
from tidewatch.streaming import stateful as sf

T0 = 1_704_067_200_000_000
EVENT = "tx_id long, us long, cust long, amount double, channel string, device string, typing double, decision string"
FEEDBACK = "tx_id long, us long, cust long, label string"


def story(seed=5, n=160):
    r = random.Random(seed)
    events, feedback, us = [], [], T0
    for i in range(n):
        us += r.choice((0, 60, 4000, 90_000)) * 1_000_000
        events.append((i, us, r.randrange(4), round(r.random() * 500, 2), r.choice(("web", "atm", None)), r.choice(("d1", "d2", "d3")), r.choice((None, 120.0, 90.5)), r.choice(("ALLOW", "STEP_UP", "HOLD"))))
        if r.random() < 0.6:
            late = r.choice((1, 3600, 5 * 86_400, 8 * 86_400)) * 1_000_000
            feedback.append((i if r.random() < 0.9 else 10_000 + i, us + late, events[-1][2], r.choice(("trusted", "trusted", "fraud"))))
    feedback += feedback[:5]  # told twice
    return events, feedback


def batch(spark, events, feedback, **options):
    return sorted(map(tuple, sf.late_learning(spark.createDataFrame(events, EVENT), spark.createDataFrame(feedback, FEEDBACK), **options).collect()), key=repr)


def test_feedback_teaches_what_waits_and_is_refused_else(spark):
    events = [(1, T0, 1, 100.0, "web", "d1", None, "ALLOW"), (2, T0 + 1, 1, 50.0, "web", "d2", None, "HOLD"), (3, T0 + 2, 1, 50.0, "web", "d2", None, "HOLD"), (4, T0 + 20, 1, 10.0, "web", "d2", None, "ALLOW"), (5, T0 + 30, 1, 10.0, "web", "d3", None, "HOLD"), (6, T0 + 40, 1, 10.0, "web", "d4", None, "HOLD")]
    feedback = [(2, T0 + 10, 1, "trusted"), (2, T0 + 11, 1, "trusted"), (3, T0 + 12, 1, "fraud"), (1, T0 + 13, 1, "trusted"), (9, T0 + 14, 1, "trusted"), (5, T0 + 30 + 8 * fr.DAY, 1, "trusted")]
    got = {(r[0], r[1], r[2]) for r in batch(spark, events, feedback)}
    assert got == {(1, "event", "learned"), (2, "event", "pending"), (3, "event", "pending"), (4, "event", "learned"), (5, "event", "pending"), (6, "event", "pending"), (2, "feedback", "taught"), (2, "feedback", "refused"), (3, "feedback", "forgotten"), (1, "feedback", "refused"), (9, "feedback", "refused"), (5, "feedback", "refused")}
    new_device = {r[0]: r[5] for r in batch(spark, events, feedback) if r[1] == "event"}
    assert (new_device[2], new_device[3], new_device[4], new_device[6]) == (1.0, 1.0, 0.0, 1.0)
    pushed = batch(spark, events, [(2, T0 + 50, 1, "trusted"), (6, T0 + 50, 1, "trusted")], most=2)
    assert {(r[0], r[2]) for r in pushed if r[1] == "feedback"} == {(2, "refused"), (6, "taught")}
    assert batch(spark, [], []) == []


def test_late_learning_in_a_stream_equals_the_batch(spark, tmp_path):
    events, feedback = story()
    cut = sorted(e[1] for e in events)[len(events) // 2]
    for name, rows, schema in (("e", events, EVENT), ("f", feedback, FEEDBACK)):
        for part in ([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]):
            spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda n, s: spark.readStream.schema(s + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    got = sf.drained(lambda: sf.late_learning_stream(read("e", EVENT), read("f", FEEDBACK)), spark)
    want = batch(spark, events, feedback)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[2] for r in want} == {"learned", "pending", "taught", "forgotten", "refused"}


@pytest.mark.parametrize("files", [1, 4])
def test_sliding_features_of_a_stream_equal_the_batch(spark, tmp_path, files):
    r = random.Random(8)
    rows, us = [], T0
    for i in range(300):
        us += r.choice((0, 0, 30, 1800, 40_000)) * 1_000_000
        rows.append((i * 31 % 307, us, r.randrange(3), round(r.random() * 90, 2), r.choice(("p1", "p2", "p3", "", None)), "web", "d"))
    # out of order by less than the delay: rows are dealt to files by time, but for a few that come a file later
    cuts = sorted(x[1] for x in rows)
    bounds = [cuts[len(cuts) * k // files] for k in range(1, files)]
    for k in range(files):
        part = [x for x in rows if sum(x[1] - (x[0] % 5 == 0) * 3_000_000_000 >= b for b in bounds) == k]
        r.shuffle(part)
        spark.createDataFrame(part, "tx_id long, us long, cust long, amount double, payee string, channel string, device string").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("tx_id long, us long, cust long, amount double, payee string, channel string, device string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {x["tx_id"]: x.asDict() for x in sf.drained(lambda: sf.sliding_features_stream(stream), spark).collect()}
    names = [c for c in sf._COLUMNS if c not in ("tx_id", "cust", "us")]
    want = {x["tx_id"]: x.asDict() for x in ft.features(spark.read.parquet(f"{tmp_path}/in").drop("ts"), names).collect()}
    last = max(x[1] for x in rows) // 1000 * 1000 - fr.HOUR
    told = {x[0] for x in rows if x[1] <= last}
    assert set(got) == told and len(told) > 250
    for i in told:
        assert {n: got[i][n] for n in names} == pytest.approx({n: want[i][n] for n in names}), i


def test_windows_move_without_new_events():
    w = sf.Windows([(0, 1, 5, "a"), (10, 2, 7, "b")])
    assert w.features(20)["cnt_1m"] == 2.0 and w.features(fr.MINUTE + 5)["cnt_1m"] == 1.0
    w.move(fr.WEEK + 10)
    assert not w.entries and not w.payees["7d"] and w.sums == dict.fromkeys(sf.WIDTHS, 0)


def test_a_customer_without_change_is_not_written_again():
    """A batch in any order is taken by time; a timer that drops nothing writes no state and tells no rows."""
    import pandas as pd

    class State:
        saved, writes = None, 0

        def get(self):
            return self.saved

        def update(self, value):
            self.saved, self.writes = value, self.writes + 1

    class Handle:
        def registerTimer(self, at):
            pass

    class Info:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    p = sf._Learning(sf.PENDING_US, sf.PENDING_MAX)
    p.state, p.handle = State(), Handle()
    line = [(30, "feedback", 2, None, None, None, None, None, "trusted"), (20, "event", 2, 5.0, "web", "d1", None, "HOLD", None), (10, "event", 1, 7.0, None, "d1", float("nan"), "ALLOW", None), (20, "event", 3, 1.0, "web", None, None, "HOLD", None)]
    got = pd.concat(p.handleInputRows(("a",), iter([pd.DataFrame(line[:2], columns=sf._TOLD), pd.DataFrame(line[2:], columns=sf._TOLD)]), None))
    assert list(zip(got.tx_id, got.kind, got.outcome, strict=True)) == [(1, "event", "learned"), (2, "event", "pending"), (3, "event", "pending"), (2, "feedback", "taught")]
    assert p.state.writes == 1
    assert list(p.handleExpiredTimer(("a",), None, Info(1))) == [] and p.state.writes == 1
    assert list(p.handleExpiredTimer(("a",), None, Info(sf.PENDING_US // 1000 + 1))) == [] and p.state.writes == 2
    assert not sf.LateLearner(saved=p.state.saved[0]).pending


def test_many_customers_share_a_key_and_only_those_with_news_are_written():
    """A call takes a shard of customers; a timer writes those that are due and leaves the others alone."""
    import pandas as pd

    class Map:
        def __init__(self):
            self.of, self.writes = {}, []

        def getValue(self, key):
            return self.of.get(key)

        def updateValue(self, key, value):
            self.of[key] = value
            self.writes.append(key[0])

        def removeKey(self, key):
            del self.of[key]

        def iterator(self):
            return iter(list(self.of.items()))

    class At:
        def __init__(self, us):
            self.us = us

        def getCurrentWatermarkInMs(self):
            return self.us // 1000

        def registerTimer(self, ms):
            timers.append(ms)

    timers: list[int] = []
    p = sf._Sliding()
    p.customers, p.handle = Map(), At(0)
    rows = pd.DataFrame([("a", 5_000, 1, 2.0, "x"), ("b", 9_000, 2, 3.0, None), ("a", 7_000, 3, float("nan"), "y")], columns=["cust", "us", "tx_id", "amount", "payee"])
    assert list(p.handleInputRows((0,), iter([rows]), At(0))) == [] and timers == [6] and p.customers.writes == ["a", "b"]
    told = pd.concat(p.handleExpiredTimer((0,), At(7_000), None))
    assert list(zip(told.tx_id, told.cust, told.cnt_1h, told.sum_1h, strict=True)) == [(1, "a", 0.0, 0.0), (3, "a", 1.0, 2.0)]
    assert p.customers.writes == ["a", "b", "a"] and timers[-1] == 10
    assert len(pd.concat(p.handleExpiredTimer((0,), At(9_000 + fr.WEEK), None))) == 1 and p.customers.of == {}


def test_customers_of_one_shard_do_not_mix(spark, tmp_path):
    rows = [(i, T0 + i * 1_000_000, i % 5, 1.0, "p") for i in range(50)] + [(99, T0 + 9 * fr.HOUR, 0, 1.0, "p")]
    schema = "tx_id long, us long, cust long, amount double, payee string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema + ", ts timestamp").parquet(f"{tmp_path}/in")
    got = {r["tx_id"]: r["cnt_1h"] for r in sf.drained(lambda: sf.sliding_features_stream(stream, shards=1), spark).collect()}
    assert got == {i: float(i // 5) for i in range(50)}


def test_an_event_does_not_look_at_all_that_wait():
    """Of what waits only the first is looked at, also after a restart; out of order and told twice all are, and what is dropped is the same."""
    seen = 0

    class Counted(sf.OrderedDict):
        def values(self):
            return counted(super().values())

        def items(self):
            return counted(super().items())

    def counted(of):
        nonlocal seen
        for x in of:
            seen += 1
            yield x

    event = lambda i, us: {"us": us, "kind": "event", "tx_id": i, "amount": 1.0, "channel": "web", "device": "d", "typing": None, "decision": "HOLD", "label": None}
    learner = sf.LateLearner(keep_us=400)
    learner.pending = Counted()
    for i in range(800):
        learner.take(event(i, i))
    assert seen < 4 * 800 and list(sf.OrderedDict.keys(learner.pending)) == list(range(399, 800))
    again = sf.LateLearner(keep_us=400, saved=learner.saved())
    assert again.ordered and again.expire(900) == 101
    again.take(event(1000, 600))  # late
    assert not again.ordered and again.expire(1001) == 102 and 1000 not in again.pending
    again.take(event(700, 1001))  # told twice: it keeps its place
    assert again.expire(1102) == 100 and 700 in again.pending and 701 not in again.pending

"""Keyed state with timers: late learning from feedback, and sliding features.

State lives in the RocksDB store (:func:`with_state_store`); timers follow the
watermark, so what is due happens without a new event of the key.
"""

from __future__ import annotations

import json
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import frames as fr
from ..operators.profile import Amounts, fold_sorted

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB, which timers and typed state need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


# --- late learning ---------------------------------------------------------------------------------
#: Events of a customer that wait for feedback at most (the oldest go first), and how long each waits.
PENDING_MAX, PENDING_US = 1000, 7 * fr.DAY
LEARNING = "tx_id long, kind string, outcome string, amount_ratio double, amount_zscore double, is_new_device double, n double"
_LEARNED = [c.split()[0] for c in LEARNING.split(", ")]
_EVENT = ("us", "amount", "hour", "channel", "device", "typing")


class LateLearner:
    """A customer's profile and the events that wait for feedback.

    An allowed event is learned at once. Any other waits; feedback ``trusted``
    within ``keep_us`` teaches it then, to the profile as it is by then, ``fraud``
    forgets it, and feedback on what does not wait (never seen, learned, told
    before, expired, pushed out) is refused.
    """

    def __init__(self, keep_us: int = PENDING_US, most: int = PENDING_MAX, saved: str | None = None):
        self.keep_us, self.most = keep_us, most
        self.profile, self.pending = Amounts(), OrderedDict()
        if saved is not None:
            state = json.loads(saved)
            for name in Amounts.__slots__:
                setattr(self.profile, name, state["profile"][name])
            self.pending = OrderedDict((i, v) for i, v in state["pending"])
        times = [v[0] for v in self.pending.values()]
        self.ordered, self.latest = times == sorted(times), max(times, default=None)

    def saved(self) -> str:
        return json.dumps({"profile": {n: getattr(self.profile, n) for n in Amounts.__slots__}, "pending": list(self.pending.items())})

    def _learn(self, v: list) -> None:
        us, amount, hour, channel, device, typing = v
        self.profile.learn(amount, hour, channel, device, us, typing)

    def expire(self, us: int) -> int:
        """Drops what has waited too long; how many. While events came in order of time only the first that wait are looked at."""
        if self.ordered:
            n = len(self.pending)
            while self.pending and next(iter(self.pending.values()))[0] + self.keep_us < us:
                self.pending.popitem(last=False)
            return n - len(self.pending)
        gone = [i for i, v in self.pending.items() if v[0] + self.keep_us < us]
        for i in gone:
            del self.pending[i]
        return len(gone)

    def take(self, row: dict) -> dict:
        """One event or feedback; what to tell of it."""
        us, i = row["us"], row["tx_id"]
        if row["kind"] == "feedback":
            waits = self.pending.pop(i, None)
            if waits is None or waits[0] + self.keep_us < us:
                outcome = "refused"
            elif row["label"] == "trusted":
                self._learn(waits)
                outcome = "taught"
            else:
                outcome = "forgotten"
            return {"tx_id": i, "kind": "feedback", "outcome": outcome, "amount_ratio": None, "amount_zscore": None, "is_new_device": None, "n": float(self.profile.n)}
        v = [us, row["amount"] or 0.0, int(us // fr.HOUR % 24), row["channel"] or "", row["device"] or "", row["typing"]]
        f = self.profile.features(*v[1:])
        out = {"tx_id": i, "kind": "event", "amount_ratio": f["amount_ratio"], "amount_zscore": f["amount_zscore"], "is_new_device": f["is_new_device"], "n": float(self.profile.n)}
        if row["decision"] == "ALLOW":
            self._learn(v)
            return {**out, "outcome": "learned"}
        self.expire(us)
        # an event told twice keeps its place
        self.ordered = not self.pending or (self.ordered and i not in self.pending and us >= self.latest)
        self.latest = us if self.ordered else max(self.latest, us)
        self.pending[i] = v
        while len(self.pending) > self.most:
            self.pending.popitem(last=False)
        return {**out, "outcome": "pending"}


_TOLD = ["us", "kind", "tx_id", "amount", "channel", "device", "typing", "decision", "label"]


def told(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Events (tx_id, us, cust, amount, channel, device, typing, decision) and feedback (tx_id, us, cust, label) as one line; keeps a column ts for a watermark if both have one."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    time = [c for c in ("ts",) if c in events.columns and c in feedback.columns]
    cust = F.coalesce(F.col("cust").cast("string"), F.lit("")).alias("cust")
    e = events.select(cust, "us", F.lit("event").alias("kind"), "tx_id", "amount", "channel", "device", F.col("typing").cast("double").alias("typing"), "decision", text.alias("label"), *time)
    f = feedback.select(cust, "us", F.lit("feedback").alias("kind"), "tx_id", number.alias("amount"), text.alias("channel"), text.alias("device"), number.alias("typing"), text.alias("decision"), "label", *time)
    return e.unionByName(f)


def _plain(row: dict) -> dict:
    return {k: None if v is None or v != v else v for k, v in row.items()}


def late_learning(events: DataFrame, feedback: DataFrame, *, keep_us: int = PENDING_US, most: int = PENDING_MAX) -> DataFrame:
    """What each event and each feedback came to, in time order: tx_id, kind, outcome, amount_ratio, amount_zscore, is_new_device, n.

    Outcomes of events: learned, pending; of feedback: taught, forgotten,
    refused. Features are those of the profile before the event, and null for
    feedback; n is how much the profile had learned. At equal times events come
    before feedback, then by tx_id.
    """

    def step(state: LateLearner, row: dict) -> tuple[LateLearner, dict]:
        for k in ("amount", "typing"):  # the numbers that may be NaN
            if row[k] != row[k]:
                row[k] = None
        return state, state.take(row)

    return fold_sorted(told(events, feedback).select("cust", *_TOLD), "cust", ["us", "kind", "tx_id"], lambda _: LateLearner(keep_us, most), step, LEARNING)


class _Learning(StatefulProcessor):
    """The learner of a customer as a value; a timer drops what has waited too long."""

    def __init__(self, keep_us: int, most: int):
        self.keep_us, self.most = keep_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("learner", "saved string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        learner = LateLearner(self.keep_us, self.most, saved[0] if saved else None)
        # plain tuples: a frame of its own for each customer costs more than what it holds
        line = sorted((r for pdf in rows for r in zip(*(pdf[c].tolist() for c in _TOLD), strict=True)), key=lambda r: (r[0], r[1], r[2] is None or r[2] != r[2], r[2]))
        out = [learner.take(_plain(dict(zip(_TOLD, r, strict=True)))) for r in line]
        self.state.update((learner.saved(),))
        if learner.pending:
            self.handle.registerTimer((max(v[0] for v in learner.pending.values()) + self.keep_us) // 1000 + 1)
        yield pd.DataFrame({c: [o[c] for o in out] for c in _LEARNED})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        if saved:
            learner = LateLearner(self.keep_us, self.most, saved[0])
            if learner.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000):
                self.state.update((learner.saved(),))
        return iter(())

    def close(self) -> None:
        pass


def late_learning_stream(events: DataFrame, feedback: DataFrame, *, delay: str = "1 hour", keep_us: int = PENDING_US, most: int = PENDING_MAX) -> DataFrame:
    """:func:`late_learning` over streams, which have ts beside us. A batch is taken in time order, batches as they come; start it within :func:`with_state_store`."""
    line = told(events, feedback).withWatermark("ts", delay)
    return line.groupBy("cust").transformWithStateInPandas(statefulProcessor=_Learning(keep_us, most), outputStructType=LEARNING, outputMode="Append", timeMode="EventTime")


# --- sliding features ------------------------------------------------------------------------------------
WIDTHS = {"1m": fr.MINUTE, "1h": fr.HOUR, "24h": fr.DAY, "7d": fr.WEEK}
SLIDING = "tx_id long, cust string, us long, " + ", ".join(f"cnt_{t} double, sum_{t} double" for t in WIDTHS) + ", distinct_payees_24h double, distinct_payees_7d double, time_since_last_s double"
_COLUMNS = [c.split()[0] for c in SLIDING.split(", ")]
_UNIT = Decimal("0.00000001")


def _exact(amount: float | None) -> int:
    """An amount in units of the eighth decimal, as sums of histories count it."""
    return 0 if amount is None else int(Decimal(repr(float(amount))).quantize(_UNIT, rounding=ROUND_HALF_UP).scaleb(8))


class Windows:
    """A customer's windows as entries and exits: each holds its running count and sum, and where its oldest entry lies."""

    def __init__(self, entries: list[tuple[int, int, int, str]]):
        """``entries``: (us, tx_id, amount in units, payee) of the longest window, in order."""
        self.entries = deque(entries)
        self.inside = {t: deque() for t in WIDTHS}
        self.sums = dict.fromkeys(WIDTHS, 0)
        self.payees: dict[str, dict[str, int]] = {t: {} for t in ("24h", "7d")}
        for e in entries:
            self._enter(e)

    def _enter(self, e: tuple[int, int, int, str]) -> None:
        for t in WIDTHS:
            self.inside[t].append(e)
            self.sums[t] += e[2]
        for seen in self.payees.values():
            if e[3]:
                seen[e[3]] = seen.get(e[3], 0) + 1

    def move(self, us: int) -> None:
        """Lets entries go whose window has passed at ``us``."""
        for t, width in WIDTHS.items():
            q = self.inside[t]
            while q and q[0][0] <= us - width:
                e = q.popleft()
                self.sums[t] -= e[2]
                if t in self.payees and e[3]:
                    seen = self.payees[t]
                    seen[e[3]] -= 1
                    if not seen[e[3]]:
                        del seen[e[3]]
        while self.entries and self.entries[0][0] <= us - fr.WEEK:
            self.entries.popleft()

    def features(self, us: int) -> dict[str, float]:
        self.move(us)
        out = {}
        for t in WIDTHS:
            out[f"cnt_{t}"], out[f"sum_{t}"] = float(len(self.inside[t])), self.sums[t] / 1e8
        last = self.inside["7d"][-1][0] if self.inside["7d"] else None
        return {**out, **{f"distinct_payees_{t}": float(len(s)) for t, s in self.payees.items()}, "time_since_last_s": 604_800.0 if last is None else (us - last) / 1e6}

    def add(self, e: tuple[int, int, int, str]) -> None:
        self.entries.append(e)
        self._enter(e)


#: Keys of the sliding state, each of which holds many customers: a call of its own for each customer costs more than its events.
SHARDS = 1024
#: Rows that a call tells at once.
_TELL = 10_000


class _Sliding(StatefulProcessor):
    """A shard's customers, each with its events that wait for the watermark and the entries of the longest window.

    A customer is read and written alone, and only if it has new events or is due. A timer at the next due
    time of those that were written lets all who are due by then move on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.customers = handle.getMapState("customers", "cust string", "saved string")

    def _moved(self, cust: str, saved: tuple | None, fresh: list, limit: int, out: list) -> tuple[list, list]:
        """The customer's waiting events and entries once the watermark is at ``limit``; what is told goes to ``out``."""
        waiting, entries = ([tuple(e) for e in part] for part in json.loads(saved[0])) if saved else ([], [])
        waiting = sorted([*waiting, *fresh])
        w = Windows(entries)
        ready = [e for e in waiting if e[0] <= limit]
        for e in ready:
            f = w.features(e[0])
            out.append((e[1], cust, e[0], *(f[c] for c in _COLUMNS[3:])))
            w.add(e)
        w.move(limit)
        return waiting[len(ready) :], list(w.entries)

    @staticmethod
    def _due(waiting: list, entries: list) -> int | None:
        return waiting[0][0] if waiting else entries[-1][0] + fr.WEEK if entries else None

    def _keep(self, changed: dict[str, tuple[list, list]], there: set[str], due: list) -> None:
        for cust, (waiting, entries) in changed.items():
            if waiting or entries:
                self.customers.updateValue((cust,), (json.dumps([waiting, entries]),))
                due.append(self._due(waiting, entries))
            elif cust in there:
                self.customers.removeKey((cust,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        fresh: dict[str, list] = {}
        for pdf in rows:
            for c, u, i, a, p in zip(*(pdf[n].tolist() for n in ("cust", "us", "tx_id", "amount", "payee")), strict=True):
                fresh.setdefault(c, []).append((int(u), int(i), _exact(None if a != a else a), p or ""))
        out, changed, there = [], {}, set()
        for cust, events in fresh.items():
            saved = self.customers.getValue((cust,))
            if saved:
                there.add(cust)
            changed[cust] = self._moved(cust, saved, events, limit, out)
            if len(out) >= _TELL:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        due: list[int] = []
        self._keep(changed, there, due)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        out, changed, due = [], {}, []
        for (cust,), saved in self.customers.iterator():
            waiting, entries = json.loads(saved[0])
            at = self._due(waiting, entries)
            if at > limit:
                due.append(at)
                continue
            changed[cust] = self._moved(cust, saved, [], limit, out)
            if len(out) >= _TELL:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        self._keep(changed, set(changed), due)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def sliding_features_stream(events: DataFrame, *, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Velocity and payee features of each event, as ``features`` gives them, over a stream that may be out of order by ``delay``.

    Events have ts, us, tx_id, cust, amount, payee. An event waits until the
    watermark passes it, so that its history is whole, and is told once; one
    that comes later than ``delay`` is dropped by the watermark. A customer's
    state is the events of seven days and those that wait, and goes when the
    last has left its window. Customers are dealt to ``shards`` keys; a stream
    keeps that number for its life. Start it within :func:`with_state_store`.
    """
    cust = F.coalesce(F.col("cust").cast("string"), F.lit(""))
    shard = F.pmod(F.xxhash64(cust), F.lit(shards)).alias("shard")
    e = events.select("ts", shard, "us", "tx_id", cust.alias("cust"), F.col("amount").cast("double").alias("amount"), "payee").withWatermark("ts", delay)
    return e.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Sliding(), outputStructType=SLIDING, outputMode="Append", timeMode="EventTime")


def drained(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """Run a stream of this module over what is there and read its output back."""
    from .streams import drain

    with with_state_store(spark):
        return drain(make())

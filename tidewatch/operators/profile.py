"""Adaptive customer profiles: folds over a customer's events in time order.

The recurrences need a customer's events one after the other. Rows are dealt
by customer and sorted; a task then streams through its rows and keeps one
state, so no customer's history is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

ALPHA, VAR_FLOOR, MAX_DEVICES = 0.05, 0.05, 20
LARGE_FACTOR, UNUSUAL_HOUR, RARE_CHANNEL = 1.5, 0.02, 0.05


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[dict], object], step: Callable[[object, dict], tuple[object, dict]], schema: str, *, partitions: int | None = None, keep: Sequence[str] = (), reads: Sequence[str] | None = None) -> DataFrame:
    """For each row the output of ``step`` (state, row) -> (state, output), rows of a key in order; ``start`` makes a key's first state from its first row.

    Columns ``keep`` stand beside the output as they are, so that it need not be joined to its rows; ``step`` sees the
    key and the columns ``reads`` (all by default).
    """

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    seen = [key, *(c for c in (df.columns if reads is None else reads) if c != key)]
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kinds.names}
            for values in zip(*(batch.column(c).to_pylist() for c in seen), strict=True):
                row = dict(zip(seen, values, strict=True))
                if values[0] != now:
                    now, state = values[0], start(row)
                state, made = step(state, row)
                for n, column in out.items():
                    column.append(made[n])
            made = pa.RecordBatch.from_pydict(out, schema=kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made.columns], [*keep, *kinds.names])

    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *_parse_datatype_string(schema).fields]))


class Amounts:
    """What a profile knows of amounts, devices and typing: log-amount mean and variance, largest amount, recent devices."""

    __slots__ = ("n", "log_mean", "log_var", "max_amount", "devices", "typing_n", "typing_mean", "typing_var")

    def __init__(self, avg_amount: float = 0.0, prior_weight: float = 5.0, devices: tuple[str, ...] = ()):
        self.n = prior_weight if avg_amount > 0 else 0.0
        self.log_mean, self.log_var = math.log1p(avg_amount), 0.25 if avg_amount > 0 else VAR_FLOOR
        self.max_amount = avg_amount
        self.devices = dict.fromkeys(devices, 0)
        self.typing_n, self.typing_mean, self.typing_var = 0, 0.0, 0.0

    def features(self, amount: float, hour: int, channel: str, device: str, typing: float | None) -> dict[str, float]:
        return {
            "amount_ratio": amount / max(1.0, math.expm1(self.log_mean)),
            "amount_zscore": (math.log1p(amount) - self.log_mean) / math.sqrt(max(self.log_var, 1e-6)),
            "first_large_transfer": float(amount > self.max_amount * LARGE_FACTOR),
            "is_new_device": float(bool(device) and device not in self.devices),
            "typing_deviation": abs(typing - self.typing_mean) / math.sqrt(max(self.typing_var, 1.0)) if typing is not None and self.typing_n >= 3 else 0.0,
        }

    def learn(self, amount: float, hour: int, channel: str, device: str, us: int, typing: float | None) -> None:
        alpha = max(ALPHA, 1.0 / (self.n + 1.0))
        off = math.log1p(max(0.0, amount)) - self.log_mean
        self.log_mean += alpha * off
        self.log_var = max(VAR_FLOOR, (1 - alpha) * (self.log_var + alpha * off * off))
        self.max_amount = max(self.max_amount, amount)
        if device:
            self.devices[device] = us
            while len(self.devices) > MAX_DEVICES:
                del self.devices[min(self.devices, key=self.devices.__getitem__)]
        if typing is not None and typing > 0:
            a = max(ALPHA, 1.0 / (self.typing_n + 1.0))
            off = typing - self.typing_mean
            self.typing_mean += a * off
            self.typing_var = (1 - a) * (self.typing_var + a * off * off)
            self.typing_n += 1
        self.n += 1


class Profile(Amounts):
    """:class:`Amounts` with decayed hours and channels, which cost more than all else: where no one reads them, take Amounts."""

    __slots__ = ("hours", "channels")

    def __init__(self, avg_amount: float = 0.0, prior_weight: float = 5.0, hours: tuple[int, ...] = tuple(range(9, 19)), channels: tuple[str, ...] = (), devices: tuple[str, ...] = ()):
        super().__init__(avg_amount, prior_weight, devices)
        self.hours = [1.0 if avg_amount > 0 and h in hours else 0.0 for h in range(24)]
        self.channels = dict.fromkeys(channels, 1.0)

    def features(self, amount: float, hour: int, channel: str, device: str, typing: float | None) -> dict[str, float]:
        total, used = sum(self.hours), sum(self.channels.values())
        share = self.channels.get(channel, 0.0) / used if used else 0.0
        own = super().features(amount, hour, channel, device, typing)
        return {**own, "hour_unusual": float((self.hours[hour] / total if total else 0.0) < UNUSUAL_HOUR), "channel_unknown": float(share <= RARE_CHANNEL)}

    def learn(self, amount: float, hour: int, channel: str, device: str, us: int, typing: float | None) -> None:
        alpha = max(ALPHA, 1.0 / (self.n + 1.0))
        self.hours = [h * (1 - alpha) for h in self.hours]
        self.hours[hour] += 1.0
        self.channels = {c: v * (1 - alpha) for c, v in self.channels.items()}
        if channel:
            self.channels[channel] = self.channels.get(channel, 0.0) + 1.0
        super().learn(amount, hour, channel, device, us, typing)


PROFILE_SCHEMA = "tx_id long, amount_ratio double, amount_zscore double, first_large_transfer double, is_new_device double, hour_unusual double, channel_unknown double, typing_deviation double, log_mean double, log_var double, max_amount double, n double"


def _clean(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def profile_features(tx: DataFrame, names: Sequence[str] | None = None, keep: Sequence[str] = ("tx_id",)) -> DataFrame:
    """``keep`` and profile features (``names``, or all) of each event before it is learned; events with ``trusted`` false teach nothing.

    Columns: tx_id, us, cust, amount, channel, device, trusted; avg_amount and
    typing may be null. A null customer is one customer. Hours and channels are
    only followed where ``names`` has features of theirs.
    """
    kinds = {c.split()[0]: c for c in PROFILE_SCHEMA.split(", ")[1:]}
    names = list(kinds if names is None else names)
    kind = Profile if {"hour_unusual", "channel_unknown"} & set(names) else Amounts

    def start(row: dict) -> Amounts:
        return kind(_clean(row["avg_amount"]) or 0.0)

    def step(p: Amounts, row: dict) -> tuple[Amounts, dict]:
        hour = int(row["us"] // 3_600_000_000 % 24)
        amount, channel, device, typing = _clean(row["amount"]) or 0.0, _clean(row["channel"]) or "", _clean(row["device"]) or "", _clean(row["typing"])
        out = p.features(amount, hour, channel, device, typing)
        out["log_mean"], out["log_var"], out["max_amount"], out["n"] = p.log_mean, p.log_var, p.max_amount, float(p.n)
        if row["trusted"]:
            p.learn(amount, hour, channel, device, row["us"], typing)
        return p, out

    reads = ["us", "amount", "channel", "device", "trusted", "avg_amount", "typing"]
    rows = tx.select(F.coalesce(F.col("cust").cast("string"), F.lit("")).alias("_who"), *dict.fromkeys(["tx_id", *reads, *keep]))
    return fold_sorted(rows, "_who", ["us", "tx_id"], start, step, ", ".join(kinds[n] for n in names), keep=keep, reads=reads)


def profile_summaries(tx: DataFrame) -> DataFrame:
    """What is known of each customer after its last event: cust, observations, ewma_amount, max_amount, devices.

    Columns and nulls as in :func:`profile_features`; an empty table has no customers.
    """

    def start(row: dict) -> Profile:
        return Profile(_clean(row["avg_amount"]) or 0.0)

    def step(p: Profile, row: dict) -> tuple[Profile, dict]:
        if row["trusted"]:
            p.learn(_clean(row["amount"]) or 0.0, int(row["us"] // 3_600_000_000 % 24), _clean(row["channel"]) or "", _clean(row["device"]) or "", row["us"], _clean(row["typing"]))
        return p, {"cust": row["cust"], "us": row["us"], "tx_id": row["tx_id"], "n": float(p.n), "log_mean": p.log_mean, "max_amount": p.max_amount, "devices": len(p.devices)}

    cols = ["tx_id", "us", "amount", "channel", "device", "trusted", "avg_amount", "typing"]
    dealt = tx.select(F.coalesce(F.col("cust").cast("string"), F.lit("")).alias("cust"), *cols)
    states = fold_sorted(dealt, "cust", ["us", "tx_id"], start, step, "cust string, us long, tx_id long, n double, log_mean double, max_amount double, devices long")
    last = states.groupBy("cust").agg(F.max_by(F.struct("n", "log_mean", "max_amount", "devices"), F.struct("us", "tx_id")).alias("s"))
    return last.select("cust", F.round("s.n", 1).alias("observations"), F.round(F.expm1("s.log_mean"), 2).alias("ewma_amount"), F.round("s.max_amount", 2).alias("max_amount"), "s.devices")


def should_learn(decision: str, label: str) -> F.Column:
    """Fraud never teaches; a trusted label always does; otherwise an ALLOW decision does."""
    return F.when(F.col(label) == "fraud", False).when(F.col(label) == "trusted", True).otherwise(F.col(decision) == "ALLOW")

"""Point-in-time features of payment events.

Events have tx_id, us (microseconds), cust, amount, and, empty or null where
unknown, channel, device, payee, location, country, purpose. Sentinels are
values: -1 for an unknown or new age, seven days for no history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as fr

THRESHOLD, BAND = 50_000.0, 0.90
NO_HISTORY_S = 604_800.0
CASH = ("atm", "cash")
CUST, PAIR, PAYEE, DEVICE = ["cust"], ["cust", "payee"], ["payee"], ["device"]

#: Features by name: group, Column, the histories it is made of, and the key by which its Column looks back. Columns need a session, so the built-in ones are added at first use.
REGISTRY: dict[str, tuple[str, Column, tuple[str, ...], tuple[str, ...]]] = {}
#: Histories by name: key and width, and the value to sum, or the name of the column whose distinct values count.
HISTORIES: dict[str, tuple[list[str], int, Column | str]] = {}


def feature(name: str, group: str, value: Column, history: Sequence[str] = (), by: Sequence[str] = CUST) -> None:
    """Add a feature of one's own; it becomes a column of :func:`features`. ``by`` is the key of its windows, if it has some."""
    REGISTRY[name] = (group, value, tuple(history), tuple(by))


def with_histories(tx: DataFrame, names: set[str]) -> DataFrame:
    """Adds the named histories, those of one key in one pass."""
    sums: dict[tuple[str, ...], dict] = {}
    distinct: dict[tuple[tuple[str, ...], str], dict] = {}
    for n in sorted(names):
        key, width, value = HISTORIES[n]
        if isinstance(value, str):
            distinct.setdefault((tuple(key), value), {})[n] = width
        else:
            sums.setdefault(tuple(key), {})[n] = (width, value)
    for key, specs in sums.items():
        tx = fr.sums_before(tx, list(key), specs)
    for (key, value), widths in distinct.items():
        tx = fr.distinct_before(tx, list(key), F.col(value), widths)
    return tx


def _days(us: Column) -> Column:
    return us / F.lit(float(fr.DAY))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def near_threshold(amount: Column) -> Column:
    return (amount >= BAND * THRESHOLD) & (amount < THRESHOLD)


def first_seen(keys: list[str]) -> Column:
    return F.min("us").over(fr.before(keys))


def hour(us: Column) -> Column:
    return F.floor(F.pmod(us, F.lit(fr.DAY)) / F.lit(fr.HOUR))


def _register() -> None:
    amount, us = F.col("amount"), F.col("us")
    feature("amount_try", "amount", amount)
    feature("amount_log", "amount", F.log1p(amount))
    feature("near_threshold", "amount", _flag(near_threshold(amount)))
    HISTORIES["h_near_24h"] = (CUST, fr.DAY, near_threshold(amount).cast("int"))
    feature("near_threshold_cnt_24h", "amount", (F.col("h_near_24h") + near_threshold(amount).cast("int")).cast("double"), ["h_near_24h"])
    for tag, width in (("1m", fr.MINUTE), ("1h", fr.HOUR), ("24h", fr.DAY), ("7d", fr.WEEK)):
        HISTORIES[f"h_cnt_{tag}"], HISTORIES[f"h_sum_{tag}"] = (CUST, width, F.lit(1)), (CUST, width, amount)
        feature(f"cnt_{tag}", "velocity", F.col(f"h_cnt_{tag}").cast("double"), [f"h_cnt_{tag}"])
        feature(f"sum_{tag}", "velocity", F.col(f"h_sum_{tag}").cast("double"), [f"h_sum_{tag}"])
    gap = us - F.lag("us").over(fr.ordered(CUST))
    feature("time_since_last_s", "velocity", F.when(gap < fr.WEEK, gap / F.lit(1e6)).otherwise(NO_HISTORY_S))
    for tag, width in (("24h", fr.DAY), ("7d", fr.WEEK)):
        HISTORIES[f"h_payees_{tag}"] = (CUST, width, "payee")
        feature(f"distinct_payees_{tag}", "payee", F.col(f"h_payees_{tag}").cast("double"), [f"h_payees_{tag}"])
    pair = first_seen(["cust", "payee"])
    feature("is_new_payee", "payee", _flag(_known("payee") & pair.isNull()), by=PAIR)
    feature("payee_relation_age_d", "payee", F.when(_known("payee") & pair.isNotNull(), _days(us - pair)).otherwise(-1.0), by=PAIR)
    HISTORIES["h_senders"], HISTORIES["h_users"] = (PAYEE, fr.DAY, "cust"), (DEVICE, fr.WEEK, "cust")

    def with_own(name: str) -> Column:
        return (F.col(name) + F.when(F.col(f"_here_{name}"), 0).otherwise(1)).cast("double")

    feature("payee_fan_in_24h", "payee", F.when(_known("payee"), with_own("h_senders")).otherwise(0.0), ["h_senders"])
    seen = first_seen(PAYEE)
    feature("payee_age_d", "payee", F.when(_known("payee") & seen.isNotNull(), _days(us - seen)).otherwise(-1.0), by=PAYEE)
    feature("device_missing", "device", _flag(~_known("device")))
    device = first_seen(DEVICE)
    feature("device_age_d", "device", F.when(~_known("device"), -1.0).when(device.isNull(), 0.0).otherwise(_days(us - device)), by=DEVICE)
    feature("device_customers_7d", "device", F.when(_known("device"), with_own("h_users")).otherwise(1.0), ["h_users"])
    h = hour(us)
    feature("hour", "time", h.cast("double"))
    feature("is_night", "time", _flag(h < 6))
    HISTORIES["h_night_7d"] = (CUST, fr.WEEK, (h < 6).cast("int"))
    ratio = F.col("h_night_7d").cast("double") / F.col("h_cnt_7d").cast("double")
    feature("night_ratio_7d", "time", F.when(F.col("h_cnt_7d") > 0, ratio).otherwise(0.0), ["h_night_7d", "h_cnt_7d"])
    feature("is_cash_channel", "channel", _flag(F.lower("channel").isin(*CASH)))
    last = F.lag("channel").over(fr.ordered(CUST))
    feature("channel_change", "channel", _flag((gap < fr.WEEK) & _known("channel") & (F.coalesce(last, F.lit("")) != "") & (last != F.col("channel"))))


def by_key(names: Sequence[str] | None = None) -> dict[tuple[str, ...], list[str]]:
    """The named features (all by default) by the key by which rows must lie for them; what looks back by pairs goes with the customers."""
    if "amount_try" not in REGISTRY:
        _register()
    out: dict[tuple[str, ...], list[str]] = {}
    for n in names or REGISTRY:
        key = tuple(HISTORIES[REGISTRY[n][2][0]][0]) if REGISTRY[n][2] else REGISTRY[n][3]
        out.setdefault(tuple(CUST) if key == tuple(PAIR) else key, []).append(n)
    return out


def features(tx: DataFrame, names: list[str] | None = None, keep: Sequence[str] = ("tx_id",)) -> DataFrame:
    """``keep`` and the named features (all of the registry by default)."""
    if "amount_try" not in REGISTRY:
        _register()
    names = list(names or REGISTRY)
    early = [n for n in names if not REGISTRY[n][2]]
    past = {h for n in names for h in REGISTRY[n][2]}
    # key by key, so that rows are dealt once for all that a key needs; pairs lie where their customer does
    for key in dict.fromkeys([*map(tuple, (CUST, PAIR, PAYEE, DEVICE)), *(REGISTRY[n][3] for n in early), *(tuple(HISTORIES[h][0]) for h in sorted(past))]):
        tx = tx.withColumns({f"_f_{n}": REGISTRY[n][1] for n in early if REGISTRY[n][3] == key})
        tx = with_histories(tx, {h for h in past if tuple(HISTORIES[h][0]) == key})
    return tx.select(*keep, *((F.col(f"_f_{n}") if n in early else REGISTRY[n][1]).alias(n) for n in names))


def static_features(tx: DataFrame, customers: DataFrame, high_risk: list[str]) -> DataFrame:
    """Features that compare an event with its customer's record (cust, home_country, birth_year, vulnerable, channels).

    A customer without a record gets neutral values.
    """
    j = tx.join(customers, "cust", "left")
    country = F.upper(F.coalesce("country", F.lit("")))
    return j.select(
        "tx_id",
        _flag((country != "") & F.col("home_country").isNotNull() & (country != F.upper("home_country"))).alias("is_foreign"),
        _flag(country.isin(*high_risk)).alias("is_high_risk_country"),
        _flag(F.coalesce("vulnerable", F.lit(False)) | (F.coalesce(F.year(F.timestamp_micros("us")) - F.col("birth_year"), F.lit(0)) >= 65)).alias("vulnerable_customer"),
        _flag(~F.coalesce(F.array_contains("channels", F.col("channel")), F.lit(False))).alias("channel_not_kyc"),
    )


SESSION_NUMBERS = ("login_to_transfer_s", "session_duration_s")
SESSION_FLAGS = {"paste_used": "paste_used", "is_emulator": "is_emulator", "is_rooted": "is_rooted", "remote_access": "remote_access_tool", "active_call": "active_call"}


def session_number(name: str, session: str = "session") -> Column:
    """A number of the session struct, -1 where it is not known."""
    return F.coalesce(F.col(session)[name].cast("double"), F.lit(-1.0))


def session_columns(session: str = "session") -> dict[str, Column]:
    """Features of the session struct: numbers or -1, flags only where exactly true."""
    s = F.col(session)
    return {n: session_number(n, session) for n in SESSION_NUMBERS} | {n: _flag(F.coalesce(s[k], F.lit(False))) for n, k in SESSION_FLAGS.items()}


def session_features(tx: DataFrame, session: str = "session") -> DataFrame:
    """tx_id and :func:`session_columns`."""
    return tx.select("tx_id", *(c.alias(n) for n, c in session_columns(session).items()))

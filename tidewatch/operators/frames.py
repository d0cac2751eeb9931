"""Frames of earlier events of the same key.

History of an event: events of its key with a time in (now - width, now],
committed before it. Among equal times the event id decides. Histories are
running sums over a line of entries and exits (:func:`sums_before`), not moving
frames, whose cost grows with what a window of a busy key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
WEEK = 7 * DAY


def beside(rows: DataFrame, part: DataFrame, how: str = "inner") -> DataFrame:
    """Payments with what a part has of each, a row at most.

    Parts are as long as the payments, so none is sent whole, however small its files
    look; and they are many, so they are looked up, as each sort would hold memory until the last is done.
    """
    return rows.join(part.hint("shuffle_hash"), "tx_id", how)


def ordered(keys: list[str], us: str = "us", tx: str = "tx_id") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(us, tx)


def before(keys: list[str], us: str = "us", tx: str = "tx_id") -> WindowSpec:
    """All earlier rows of the key."""
    return ordered(keys, us, tx).rowsBetween(W.unboundedPreceding, -1)


#: Sums are taken in decimals, so that what has been added can be taken off again without a trace; those of ints in longs.
EXACT = "decimal(28,8)"


def _timeline(df: DataFrame, key: list[str], entry: dict[str, Column], exits: list[tuple[Column, Column | int, dict[str, Column]]]) -> DataFrame:
    """``df`` with the running sums over its key of all values that came in before a row and have not gone out again.

    Every row brings its ``entry`` values in just after itself. An exit (when,
    at, values) takes values off again, ahead of all rows of that time. Rows
    and exits of a key are one line in time, so a sum is one pass over it,
    however many rows a window holds.
    """
    names = list(entry)
    df = df.repartition(*key)  # rows are dealt, not the longer line that is made of them
    kinds = {f.name: "long" if f.dataType in (ByteType(), ShortType(), IntegerType()) else EXACT for f in df.select(*(v.alias(n) for n, v in entry.items())).schema}

    def delta(at: Column, kind: int, values: dict[str, Column]) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), *((F.coalesce(values[n], F.lit(0)) if n in values else F.lit(0)).cast(kinds[n]).alias(n) for n in names))

    out = [F.when(when, delta(F.col("us") + width, 0, {n: -v for n, v in values.items()})) for when, width, values in exits]
    line = df.withColumn("_d", F.explode(F.filter(F.array(delta(F.col("us"), 1, entry), *out), lambda x: x.isNotNull())))
    past = W.partitionBy(*key).orderBy("_d.at", "_d.kind", "tx_id").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumns({n: F.coalesce(F.sum(f"_d.{n}").over(past), F.lit(0).cast(kinds[n])) for n in names})
    return line.where("_d.kind = 1").drop("_d")


def sums_before(df: DataFrame, key: list[str], specs: dict[str, tuple[int, Column]]) -> DataFrame:
    """Adds sums over the history of each width: {name: (width, value)}; nulls are 0. Amounts count to 8 decimals."""
    widths = sorted({w for w, _ in specs.values()})
    return _timeline(df, key, {n: v for n, (_, v) in specs.items()}, [(F.lit(True), w, {n: v for n, (x, v) in specs.items() if x == w}) for w in widths])


def distinct_before(df: DataFrame, key: list[str], value: Column, widths: dict[str, int]) -> DataFrame:
    """Adds, by name and width, how many distinct values the history has, without nulls and ''; and ``_here_<name>``, whether the row's own is one.

    A value is there from one occurrence until ``width`` after the last that
    followed in time, so it comes in and goes out once for each such stretch.
    """
    w = W.partitionBy(*key, "_v").orderBy("us", "tx_id")
    df = df.repartition(*key).withColumn("_v", F.nullif(value.cast("string"), F.lit(""))).withColumns({"_last": F.lag("us").over(w), "_next": F.lead("us").over(w)})
    known = F.col("_v").isNotNull()
    entry = {n: (known & (F.col("_last").isNull() | (F.col("_last") + x <= F.col("us")))).cast("int") for n, x in widths.items()}
    exits = [(known & (F.col("_next").isNull() | (F.col("_next") >= F.col("us") + x)), x, {n: F.lit(1)}) for n, x in widths.items()]
    df = df.withColumns({f"_here_{n}": known & F.coalesce(F.col("_last") + x > F.col("us"), F.lit(False)) for n, x in widths.items()})
    return _timeline(df, key, entry, exits).drop("_v", "_last", "_next")

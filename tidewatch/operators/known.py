"""Which arrivals are known already: mergeable Bloom filters in front of an exact check.

Known identifiers are kept with a filter of their bits, one filter for each
slice (a day, a month), so that filters stay bounded, a new slice is added
without touching the others, and an old one can be dropped. An arrival that no
filter holds is new for sure and needs no join; only the others are looked up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: False positives wanted, and the most bits of one slice's filter (64 MB): a slice of more identifiers than that allows for must be cut finer.
ERROR_RATE, MAX_BITS = 0.001, 1 << 29
#: All filters together are sent to every task only up to this size.
MAX_BROADCAST = 256 << 20
FILTERS = "slice string, n long, hashes int, bits array<bigint>"
#: Words of a block: all bits of an identifier lie in one block, so that a lookup reads one block a filter, not a whole filter.
BLOCK = 128


def shape(n: int, error_rate: float = ERROR_RATE) -> tuple[int, int]:
    """Words of 64 bits (a power of two) and hashes of a filter for n identifiers."""
    bits = max(64, n * -math.log(error_rate) / math.log(2) ** 2)
    words = 1 << max(0, math.ceil(math.log2(bits / 64)))
    return words, max(1, round(words * 64 / max(n, 1) * math.log(2))) if words * 64 / max(n, 1) < 40 else 10


def _block(key: Column, words: int) -> Column:
    """The block of an identifier in a filter of so many words (a power of two)."""
    return F.pmod(F.xxhash64(F.lit(-1), key.cast("string")), F.lit(max(1, words // BLOCK))).cast("int")


def _positions(key: Column, words: int, hashes: int) -> Column:
    """The bits of an identifier, counted from the first one of its block."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), key.cast("string")), F.lit(min(words, BLOCK) * 64)).cast("int") for i in range(hashes)))


def _mask(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _part(size: int) -> Callable[[Column], Column]:
    return lambda b: F.slice("bits", b * size + 1, F.lit(size))


def _all_set(positions: str) -> Callable[[Column], Column]:
    return lambda x: F.forall(positions, lambda p: F.get(x, F.shiftright(p, 6)).bitwiseAND(_mask(p)) != 0)


def bloom_filters(ids: DataFrame, key: str, slice_: Column | None = None, error_rate: float = ERROR_RATE, words: int | None = None) -> DataFrame:
    """A filter of each slice: slice, n, hashes, bits. Null identifiers are in none.

    Bits of a word are united before they are shuffled, so a slice costs as many
    rows a task as its filter has words, and repeated identifiers cost nothing.
    All slices of one call have one size (that of the largest, or ``words``), and filters
    of one size can be united.
    """
    d = ids.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k"), (F.lit("") if slice_ is None else F.coalesce(slice_.cast("string"), F.lit(""))).alias("slice"))
    sizes = d.groupBy("slice").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    planned, hashes = shape(most, error_rate)
    words = words or planned
    if words * 64 > MAX_BITS:
        raise ValueError(f"a slice of {most} identifiers needs more than {MAX_BITS} bits: cut slices finer")
    size = min(words, BLOCK)
    at = d.select("slice", _block(F.col("_k"), words).alias("b"), F.explode(_positions(F.col("_k"), words, hashes)).alias("p"))
    masks = at.groupBy("slice", "b", F.shiftright("p", 6).alias("w")).agg(F.bit_or(_mask(F.col("p"))).alias("m"))
    # a block is put in order by itself, and then the blocks of a slice; neither is looked up word by word
    none = F.lit(0).cast("long")
    full = F.map_from_entries(F.collect_list(F.struct("w", "m")))
    blocks = masks.groupBy("slice", "b").agg(full.alias("f")).select("slice", "b", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda w: F.coalesce(F.try_element_at("f", w), none)).alias("x"))
    every = sizes.select("slice", F.explode(F.sequence(F.lit(0), F.lit(words // size - 1))).alias("b")).join(blocks, ["slice", "b"], "left")
    every = every.select("slice", "b", F.coalesce("x", F.array_repeat(none, size)).alias("x"))
    packed = every.groupBy("slice").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", "x"))), lambda e: e["x"])).alias("bits"))
    return packed.join(sizes, "slice").select("slice", "n", F.lit(hashes).alias("hashes"), "bits")


def united(*filters: DataFrame) -> DataFrame:
    """Filters of the same slice as one; they must be of one size. n is an upper bound of its identifiers."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    words = every.select("slice", "n", "hashes", F.posexplode("bits").alias("w", "m")).groupBy("slice", "w").agg(F.bit_or("m").alias("m"), F.max("hashes").alias("hashes"))
    sizes = every.groupBy("slice").agg(F.sum("n").alias("n"), F.count_distinct(F.size("bits"), F.col("hashes")).alias("shapes"))
    packed = words.groupBy("slice").agg(F.max("hashes").alias("hashes"), F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("bits"))
    same = F.when(F.col("shapes") > 1, F.raise_error(F.lit("filters of one slice differ in size"))).otherwise(F.col("n"))
    return packed.join(sizes, "slice").select("slice", same.cast("long").alias("n"), "hashes", "bits")


def with_maybe(arrivals: DataFrame, filters: DataFrame, key: str) -> DataFrame:
    """Adds ``maybe``: whether some filter holds the identifier. False is certain; a null identifier is held by none.

    Filters go to every task, cut into blocks, if they are small enough together;
    an arrival meets one block of each. Else every arrival is a maybe, and the
    exact check decides alone.
    """
    shapes = filters.groupBy(F.size("bits").alias("words"), "hashes").agg(F.count("*").alias("n")).collect()  # powers of two
    if not shapes:
        return arrivals.withColumn("maybe", F.lit(False))
    if sum(r["words"] * r["n"] for r in shapes) * 8 > MAX_BROADCAST:
        return arrivals.withColumn("maybe", F.col(key).isNotNull())
    out, held = arrivals, F.lit(False)
    for i, (words, hashes, _) in enumerate(shapes):
        size = min(words, BLOCK)
        cut = F.transform(F.sequence(F.lit(0), F.lit(words // size - 1)), _part(size))
        like = filters.where((F.size("bits") == words) & (F.col("hashes") == hashes))
        blocks = like.select(F.posexplode(cut).alias("_b", "x")).groupBy("_b").agg(F.collect_list("x").alias(f"_x{i}"))
        out = out.withColumn("_b", _block(F.col(key), words)).withColumn(f"_p{i}", _positions(F.col(key), words, hashes)).join(F.broadcast(blocks), "_b", "left").drop("_b")
        held = held | F.coalesce(F.exists(f"_x{i}", _all_set(f"_p{i}")), F.lit(False))
    return out.withColumn("maybe", F.col(key).isNotNull() & held).select(*(arrivals[c] for c in arrivals.columns), "maybe")


def fates(arrivals: DataFrame, known: DataFrame, filters: DataFrame, key: str = "tx_id") -> DataFrame:
    """Adds ``fate`` to each arrival (with a ``digest`` of its payload): new, duplicate (equal payload) or conflict.

    ``known`` has key and digest, a row a key; ``filters`` are of all its keys.
    Only arrivals that a filter holds are joined with it. Of several arrivals of one new key
    all are new here: :func:`~tidewatch.operators.records.idempotent` settles a batch with itself. A null
    key is new.
    """
    a = with_maybe(arrivals, filters, key)
    fresh = a.where(~F.col("maybe")).drop("maybe").withColumn("fate", F.lit("new"))
    held = a.where("maybe").drop("maybe").join(known.select(key, F.col("digest").alias("_known")), key, "left")
    fate = F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("digest"), "duplicate").otherwise("conflict")
    return fresh.unionByName(held.withColumn("fate", fate).drop("_known").select(*fresh.columns))

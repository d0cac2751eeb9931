"""Hierarchical packing of documents into training windows of several lengths.

Tiers are context sizes, powers of two from 512 to 4096. A document's tokens are
cut into whole windows of the longest tier, a head in grains of GRAIN tokens
and a tail shorter than a grain; a head or tail is routed to the smallest tier
that holds it. Each tier is packed into windows of its own size, from the
longest tier down: a window is opened by the longest piece of its tier, and
the gap that it leaves is filled from what is left of the shorter tiers,
longest first. A window that is full is of a power of two, so it needs no
padding. What cannot fill a window of its tier any more is packed together
into windows of the longest.

How many pieces there are of each length decides the layout, and there are few
lengths, so the driver lays out patterns (lengths in one window, and how many
windows repeat them), never documents. Each piece then finds its window from
its rank among the pieces of its length. Windows of each tier are dealt to step
groups in turn, each tier beginning where the one before has ended, so groups
differ by one window of a tier at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text
from .store import frugal, materialise
from .tokens import encoder

#: Context sizes; the last is the longest sequence.
TIERS = (512, 1024, 2048, 4096)
GRAIN, END_ID = 128, 2
#: Tokens in a step group, about.
STEP_TOKENS = 64 * 4096
#: Pieces of one length that are ranked together, about, and the most such groups.
RANKED_ROWS, RANK_GROUPS = 500, 20_000


def cuts(n: int, window: int = TIERS[-1], grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(a, window) for a in range(0, n - window + 1, window)]
    at = len(out) * window
    head = (n - at) // grain * grain
    out += [(at, head)] if head else []
    return out + ([(at + head, n - at - head)] if n > at + head else [])


def _pieces(path: str, window: int, grain: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            which, rows = [], []
            for a, b in text.chunks(texts):
                ids, at = encode(texts[a:b])
                ids = ids.astype("<u4")
                for i in range(b - a):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for s, n in cuts(len(own), window, grain):
                        which.append(a + i)
                        rows.append((s, n, zlib.crc32(own[s : s + n].tobytes()), len(own)))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(which, pa.int64())), *(pa.array(cols[:, c]) for c in range(4))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return frugal(pieces)


Pattern = list[tuple[int, int]]


def _filled(left: dict[int, int], gap: int) -> tuple[Pattern, int]:
    """The longest of the pieces that fit into a gap, one after the other, and what stays empty."""
    pattern = []
    for n, c in left.items():
        m = min(gap // n, c)
        if m:
            pattern.append((n, m))
            gap -= n * m
            if not gap:
                break
    return pattern, gap


def layout(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, Pattern, int]]:
    """(tier, pattern, windows): patterns are (length, how often) in one window, longest first."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    rest: dict[int, int] = {}
    out = []
    for tier in reversed(tiers):
        shorter = max((t for t in tiers if t < tier), default=0)
        while left and (n := next(iter(left))) > shorter:
            pattern, gap = _filled(left, tier)
            if gap:  # nothing short enough is left
                rest[n] = left.pop(n)
                continue
            times = min(left[n] // m for n, m in pattern)
            out.append((tier, pattern, times))
            for n, m in pattern:
                left[n] -= m * times
                if not left[n]:
                    del left[n]
    rest = dict(sorted(rest.items(), reverse=True))
    while rest:
        pattern, _ = _filled(rest, tiers[-1])
        times = min(rest[n] // m for n, m in pattern)
        out.append((tiers[-1], pattern, times))
        for n, m in pattern:
            rest[n] -= m * times
            if not rest[n]:
                del rest[n]
    return out


def _plan(counts: dict[int, int], tiers: tuple[int, ...]) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Rows (length, first rank, last rank + 1, first window, windows, offset, tier), and all tokens."""
    rows, ranks, windows = [], dict.fromkeys(counts, 0), 0
    for tier, pattern, times in layout(counts, tiers):
        offset = 0
        for n, m in pattern:
            for _ in range(m):
                rows.append((n, ranks[n], ranks[n] + times, windows, times, offset, tier))
                ranks[n] += times
                offset += n
        windows += times
    return rows, sum(n * c for n, c in counts.items())


def pack(documents: DataFrame, tokenizer: str, *, tiers: tuple[int, ...] = TIERS, grain: int = GRAIN, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tier`` is the size of the piece's window, whose tokens are fewer than that
    only if the shorter tiers have run out. Step groups hold about
    ``step_tokens`` tokens, and each its share of every tier. A null or empty
    text is the end token alone; repeated rows are packed each, in any order
    among themselves; null ids are ids like others. A long text is cut at the
    longest tier. Columns other than doc_id and text are not read. An empty
    table gives an empty result.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").mapInArrow(_pieces(tokenizer, tiers[-1], grain), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    rows = materialise(rows, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan, tokens = _plan(counts, tiers)
    groups = max(1, -(-tokens // step_tokens))
    buckets = min(RANK_GROUPS, max(1, -(-max(counts.values(), default=0) // RANKED_ROWS)))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_b").count().select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32"))
    ranked = rows.withColumn("_n", nth).join(offsets, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1)
    # at most one row for each pattern and place in a window
    slots = spark.createDataFrame(plan, "length long, _first long, _last long, _window long, _times long, offset long, tier int")
    placed = ranked.join(F.broadcast(slots) if len(plan) <= 100_000 else slots, "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    # windows are numbered tier by tier, so dealing them in turn gives every group its share of each
    sequence = F.col("_window") + F.col("_rank") - F.col("_first")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset", "tier", F.pmod(sequence, F.lit(groups)).alias("step_group"))


def token_windows(documents: DataFrame, packed: DataFrame, tokenizer: str) -> DataFrame:
    """The windows themselves: sequence_id, ids. ``documents`` and ``packed`` must have unique doc_ids."""
    part = packed.select("doc_id", F.struct("start", "length", "sequence_id", "offset").alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("ps"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids, at = encode(batch.column(0).to_pylist())
            out = []
            for i, ps in enumerate(batch.column(1).to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID))
                out += [{"sequence_id": p["sequence_id"], "offset": p["offset"], "ids": own[p["start"] : p["start"] + p["length"]].astype(np.int32)} for p in ps]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    rows = documents.select("doc_id", "text").join(part, "doc_id").select("text", "ps").mapInArrow(slices, "sequence_id long, offset long, ids array<int>")
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))

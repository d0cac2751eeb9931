"""Fuzzy passages that documents share: seeds, collinear chains, alignment.

Seeds are minimizers, the word k-mers of least hash in every window of WINDOW
successive ones, so that equal stretches of k + WINDOW - 1 words share one; a
seed that follows itself, as where a text repeats, is kept once with how far it
reaches, and counts as long as it reaches in both documents. A
seed's first document leads: every other occurrence of the seed is matched with
all of the leader's. A passage whose seeds are led by several documents, none
of which holds it whole, is told by links, two seeds MIN_SPAN to NEAR words
apart and how far: the documents of a link that lies in no passage told so far
are matched with the link's own first document, on all the seeds they share.
No table grows with the square of the documents that share a seed or a link; a
seed said m times in one document and n times, apart, in its leader has m * n matches. Matches of one document with one
leader are merged into anchors where they continue one another, and chained:
among anchors that follow in both documents with no gap over MAX_GAP, a
segment tree over the leader's positions yields the best predecessor, a gap
costing its words. (A Fenwick tree has maxima of prefixes only and cannot take
back an anchor that has fallen behind by more than MAX_GAP, so that one far and
long stretch would hide all near ones.) Chains are aligned word by word, between anchors and
outwards from both ends, and are passages if long and alike enough.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text
from .store import Scratch, frugal, materialise

K, WINDOW = 6, 12
MIN_WORDS, IDENTITY = 50, 0.8
#: Chain score lost for each word of a gap, in either document.
GAP_COST = 0.1
#: Words from the first to the last word of a chain that is worth aligning.
MIN_SPAN = 20
#: An outward extension ends when mismatches lead matches by this since its best point.
DROP = 6
#: Longest gap between anchors that is aligned in full, in words; longer ones end a chain.
MAX_GAP = 60
#: Most words between the seeds of a link.
NEAR = MIN_SPAN + MAX_GAP


def minimizers(hashes: np.ndarray, at: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds of all texts, their texts and word positions, and how far each is said again.

    Texts of fewer than k words have none. Where successive seeds are one and the
    same, as in a text that repeats itself, they are one seed that reaches from
    the first to the last of them.
    """
    n = len(hashes)
    if n < k:
        none = np.zeros(0, np.int64)
        return hashes[:0], none, none, none
    mers = text.shingles(hashes, k)
    of = np.searchsorted(at, np.arange(len(mers)), side="right") - 1
    crosses = np.arange(len(mers)) + k > at[of + 1]
    mers = np.where(crosses, np.uint64(2**64 - 1), mers)
    picked = np.zeros(len(mers), bool)
    if len(mers) >= window:
        views = np.lib.stride_tricks.sliding_window_view(mers, window)
        for a in range(0, len(views), 1 << 16):  # in blocks, to bound the memory
            picked[a + np.arange(len(views[a : a + (1 << 16)])) + views[a : a + (1 << 16)].argmin(axis=1)] = True
    # texts shorter than a window give their least k-mer
    sizes = np.diff(at) - k + 1
    for i in np.flatnonzero((sizes > 0) & (sizes < window)):
        picked[at[i] + mers[at[i] : at[i] + sizes[i]].argmin()] = True
    where = np.flatnonzero(picked & ~crosses)
    # of a run of one seed the first, as the alignment runs along the rest: else a word said n times matches n x n places
    again = (mers[where][1:] == mers[where][:-1]) & (of[where][1:] == of[where][:-1])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(where)), bool), ~again)))
    last = np.concatenate((first[1:], [len(where)]))[: len(first)] - 1
    reach = where[last] - where[first]
    where = where[first]
    return mers[where], of[where], where - at[of[where]], reach


def merge(x: np.ndarray, y: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Anchors (x, y, words) of matches sorted by x: matches on one diagonal that touch become one."""
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        i = last.get(a - b)
        if i is not None and out[i][0] + out[i][2] >= a:
            out[i] = (out[i][0], out[i][1], a + k - out[i][0])
        else:
            last[a - b] = len(out)
            out.append((a, b, k))
    return out


def chains(anchors: list[tuple[int, int, int]], gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of anchors, best first. An anchor follows another if it begins in both texts after its end, by max_gap at most."""
    todo = sorted(anchors)
    # leaves of a segment tree: anchors by their ends in y, so that a range of ends is a range of leaves
    by_end = sorted(range(len(todo)), key=lambda i: todo[i][1] + todo[i][2])
    ends = [todo[i][1] + todo[i][2] for i in by_end]
    leaf = {i: p for p, i in enumerate(by_end)}
    size, none = len(todo), (-1e18, -1)
    tree: list[tuple[float, int]] = [none] * (2 * size)
    score, prior = [0.0] * size, [-1] * size

    def put(i: int, value: tuple[float, int]) -> None:
        p = leaf[i] + size
        tree[p] = value
        while p > 1:
            p //= 2
            tree[p] = max(tree[2 * p], tree[2 * p + 1])

    # an anchor is a predecessor from when the sweep over x has passed its end until its end is max_gap behind
    waiting = sorted(range(size), key=lambda i: todo[i][0] + todo[i][2])
    w = gone = 0
    for i, (x, y, n) in enumerate(todo):
        while w < size and todo[waiting[w]][0] + todo[waiting[w]][2] <= x:
            j = waiting[w]
            xj, yj, nj = todo[j]
            # gap cost is gap_cost * ((x - end of j in x) + (y - end of j in y)): the part of j is fixed
            put(j, (score[j] + gap_cost * (xj + nj + yj + nj), j))
            w += 1
        while gone < w and todo[waiting[gone]][0] + todo[waiting[gone]][2] < x - max_gap:
            put(waiting[gone], none)
            gone += 1
        best, lo, hi = none, bisect_left(ends, y - max_gap) + size, bisect_right(ends, y) + size
        while lo < hi:
            if lo & 1:
                best, lo = max(best, tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                best = max(best, tree[hi])
            lo, hi = lo // 2, hi // 2
        gain = best[0] - gap_cost * (x + y)
        score[i] = n + max(gain, 0.0)
        prior[i] = best[1] if gain > 0 else -1
    taken, out = set(), []
    for i in sorted(range(len(todo)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and i not in taken:
            taken.add(i)
            chain.append(todo[i])
            i = prior[i]
        if chain:
            out.append(chain[::-1])
    return out


def _edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal words that an alignment of a and b with fewest edits has.

    Some such alignment pairs what both begin and end with, so only the words between are aligned.
    """
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    a, b, n = a[head:], b[head:], n - head
    unlike = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(unlike[0]) if len(unlike) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return head + tail + _inner_matches(a, b)


def _inner_matches(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) == 1:
        return int(a[0] == b[0])
    # an edit costs more than all matches together are worth, so the least key is that of fewest edits and then of most matches
    edit = 1 << 32
    steps = np.arange(len(b) + 1, dtype=np.int64) * edit
    key = steps
    for word in a:
        new = key + edit
        same = b == word
        new[1:] = np.minimum(new[1:], key[:-1] + np.where(same, -1, edit))
        # insertions run along the row
        key = np.minimum.accumulate(new - steps) + steps
    return int(-key[-1] % edit)


def _extend(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int]:
    """(words, matches) of the best extension without gaps along a and b from their beginnings."""
    at, best, length, matches = 0, 0, 0, 0
    total, found = 0, 0
    n = min(len(a), len(b))
    while at < n:
        same = a[at : min(at + 256, n)] == b[at : min(at + 256, n)]
        run = total + np.cumsum(np.where(same, 1, -1))
        high = np.maximum.accumulate(np.maximum(run, best))
        stop = np.flatnonzero(high - run >= drop)
        run = run[: stop[0]] if len(stop) else run
        if len(run) and run.max() > best:
            i = int(len(run) - 1 - run[::-1].argmax())
            best, length, matches = int(run[i]), at + i + 1, found + int(same[: i + 1].sum())
        if len(stop):
            break
        total, found, at = int(run[-1]), found + int(same.sum()), at + len(same)
    return length, matches


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(start, end) in a, (start, end) in b and equal words of a chain with both its extensions."""
    matches = sum(n for _, _, n in chain)
    for (x, y, n), (x2, y2, _) in zip(chain, chain[1:], strict=False):
        between, other = a[x + n : x2], b[y + n : y2]
        matches += len(between) if between.tobytes() == other.tobytes() else _edit_matches(between, other)
    x0, y0 = chain[0][:2]
    x1, y1 = chain[-1][0] + chain[-1][2], chain[-1][1] + chain[-1][2]
    back, more = _extend(a[:x0][::-1], b[:y0][::-1])
    on, most = _extend(a[x1:], b[y1:])
    return x0 - back, x1 + on, y0 - back, y1 + on, matches + more + most


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for a, b in text.chunks(texts):
            w = text.words(texts[a:b])
            h, of, at, reach = minimizers(w.hashes, w.at)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[a:b][of]), pa.array(at.astype(np.int32)), pa.array(reach.astype(np.int32))], ["seed", "doc", "at", "reach"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, its shared seeds, its passages) to links, and whether one lies in no passage."""
    for batch in batches:
        for doc, found, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            at, seed = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(at, kind="stable")
            at, seed = at[order].astype(np.int64), seed[order].view(np.uint64)
            lo, hi = np.searchsorted(at, at + MIN_SPAN - K), np.searchsorted(at, at + NEAR, side="right")
            for a in range(0, len(at), 1 << 10):  # in blocks, to bound the memory
                n = hi[a : a + (1 << 10)] - lo[a : a + (1 << 10)]
                i = np.repeat(np.arange(a, a + len(n)), n)
                if not len(i):
                    continue
                k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
                open_ = np.ones(len(i), bool)
                for r in told or ():
                    open_ &= (at[i] < r["start"]) | (at[k] + K > r["end"])
                keys = text.mix(text.mix(seed[i] * np.uint64(text.BASE) + seed[k]) + (at[k] - at[i]).astype(np.uint64))
                keys, of = np.unique(keys, return_inverse=True)
                some = np.zeros(len(keys), bool)
                some[of[open_]] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), doc, np.int64)), pa.array(some)], ["link", "doc", "open"])


def _reach(chain: list[tuple[int, int, int]], xs: np.ndarray, ys: np.ndarray, far: np.ndarray) -> int:
    """Where a chain ends, counting how far the seeds of its last anchor are said again in both texts."""
    x, y, n = chain[-1]
    end = x + n
    if end - chain[0][0] >= MIN_SPAN:
        return end
    lo, hi = np.searchsorted(xs, (x, x + n))
    on = xs[lo:hi] - ys[lo:hi] == x - y
    return max([end, *(xs[lo:hi] + far[lo:hi] + K)[on].tolist()])


_CHAIN = "doc long, lead long, xs array<int>, ys array<int>, ns array<int>"


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, matches as three equally long lists) to chains."""
    for batch in batches:
        out = []
        for doc, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = found.values
            leads, xs, ys, far = (v.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort((ys, xs, leads))
            leads, xs, ys, far = leads[order], xs[order], ys[order], far[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(leads)) + 1, [len(leads)]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (xs[a:b] + far[a:b]).max() + K - xs[a] < MIN_SPAN:
                    continue
                for chain in chains(merge(xs[a:b], ys[a:b], K)):
                    if _reach(chain, xs[a:b], ys[a:b], far[a:b]) - chain[0][0] >= MIN_SPAN:
                        out.append({"doc": doc, "lead": int(leads[a]), "xs": [c[0] for c in chain], "ys": [c[1] for c in chain], "ns": [c[2] for c in chain]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc", pa.int64()), ("lead", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("xs", "ys", "ns"))]))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "start", "end", "lead", "lead_start", "lead_end", "matched"]
    for batch in batches:
        known: dict[str, np.ndarray] = {}

        def hashes(value: str, known=known) -> np.ndarray:
            if value not in known:
                if len(known) >= 16:
                    known.clear()
                known[value] = text.words([value]).hashes
            return known[value]

        out = []
        for r in batch.to_pylist():
            x0, x1, y0, y1, matched = align(hashes(r["text"]), hashes(r["lead_text"]), list(zip(r["xs"], r["ys"], r["ns"], strict=True)))
            if x1 - x0 >= MIN_WORDS and matched >= IDENTITY * max(x1 - x0, y1 - y0):
                out.append((r["doc"], x0, x1, r["lead"], y0, y1, matched))
        cols = np.array(out, np.int64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays([pa.array(cols[:, i]) for i in range(len(names))], names)


#: Numbers of documents without an id of their own begin here; ids below HIGH are renumbered too.
LOW, HIGH = -(2**63), -(2**62)
#: So many numbered documents are broadcast; more are shuffled.
SMALL_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _numbered(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc, text) with a number for every text of every id, and (doc, doc_id) of those whose number is not the id."""
    d = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumn("did", F.coalesce("doc_id", F.lit(LOW)))
    odd = _small(scratch.keep(d.groupBy("did").count().where((F.col("count") > 1) | (F.col("did") < HIGH)).select("did"), "shared-ids"))
    several = d.join(odd, "did", "left_semi").withColumn("xx", F.xxhash64("text")).dropDuplicates(["did", "xx"])
    several = scratch.keep(several.select((F.lit(LOW) + F.monotonically_increasing_id()).alias("doc"), "doc_id", "text"), "shared-id-texts")
    docs = d.join(odd, "did", "left_anti").select(F.col("did").alias("doc"), "text").union(several.select("doc", "text"))
    return docs, several.select("doc", "doc_id")


def passages(documents: DataFrame, *, within: bool = False) -> DataFrame:
    """Shared passages: doc_id, start_word, end_word, source_id, source_start, source_end, matched.

    A row says that words [start_word, end_word) of doc_id repeat those of
    source_id, an earlier document, with ``matched`` equal words: 50 words or
    more of which four fifths agree. It is the first document of those that
    share the seeds, or that share a link which the first does not tell. With
    ``within`` also repeats inside one document are told, each seed against its
    place before. Documents are in order of their ids; those without an id, and the
    different texts of one id, are documents each and come before, in any
    order. Repeated rows count once. Texts that are null or shorter than a seed
    have no passages; long texts are read whole. Columns other than doc_id and
    text are not read, and an empty table gives none.
    """
    with Scratch() as scratch:
        return materialise(_passages(documents, within, scratch), "shared-passages")


def _passages(documents: DataFrame, within: bool, scratch: Scratch) -> DataFrame:
    docs, renamed = _numbered(documents, scratch)
    seeds = scratch.keep(docs.select("text", "doc").mapInArrow(frugal(_seeds), "seed long, doc long, at int, reach int"), "seeds")
    leads = seeds.groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    leads = leads.where("n > 1" if within else "first < last").select("seed", "first")
    shared = scratch.keep(seeds.join(leads, "seed"), "shared")
    scratch.drop(seeds)
    places = shared.select("seed", F.col("doc").alias("lead"), F.col("at").alias("y"), F.col("reach").alias("lead_reach"))
    far = F.least("reach", "lead_reach").alias("far")

    def told(matches: DataFrame) -> DataFrame:
        """Passages of matches (doc, lead, at, y, far)."""
        matches = matches.groupBy("doc").agg(F.collect_list(F.struct("lead", "at", "y", "far")).alias("found"))
        found = scratch.keep(matches.mapInArrow(frugal(_chains), _CHAIN), "chains")
        needed = scratch.keep(found.select("doc").union(found.select("lead")).distinct(), "needed")
        texts = scratch.keep(docs.join(_small(needed), "doc", "left_semi"), "texts")
        pairs = found.join(texts, "doc").join(texts.select(F.col("doc").alias("lead"), F.col("text").alias("lead_text")), "lead")
        rows = pairs.select("doc", "lead", "xs", "ys", "ns", "text", "lead_text").mapInArrow(frugal(_aligned), "doc long, start long, end long, lead long, lead_start long, lead_end long, matched long")
        rows = scratch.keep(rows, "passages")
        scratch.drop(found, needed, texts)
        return rows

    matches = shared.where("doc > first").select("doc", "at", "reach", "seed", F.col("first").alias("lead")).join(places, ["seed", "lead"]).select("doc", "lead", "at", "y", far)
    if within:
        before = F.lag("at").over(W.partitionBy("seed", "doc").orderBy("at"))
        matches = matches.union(shared.select("doc", F.col("doc").alias("lead"), "at", before.alias("y"), F.lit(0).alias("far")).where("y is not null"))
    rows = told(matches)
    # documents of a link that no passage of theirs holds, with the link's first document
    known = rows.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("told"))
    by_doc = shared.groupBy("doc").agg(F.collect_list(F.struct("at", "seed")).alias("found")).join(known, "doc", "left")
    links = scratch.keep(by_doc.select("doc", "found", "told").mapInArrow(frugal(_links), "link long, doc long, open boolean"), "links")
    firsts = links.groupBy("link").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last").select("link", "lead")
    pairs = scratch.keep(links.where("open").select("link", "doc").join(firsts, "link").where("lead < doc").select("doc", "lead").distinct(), "pairs")
    rest = told(pairs.join(shared.select("doc", "seed", "at", "reach"), "doc").join(places, ["lead", "seed"]).select("doc", "lead", "at", "y", far))
    names, sources = _small(renamed), _small(renamed.select(F.col("doc").alias("lead"), F.col("doc_id").alias("source_id")))
    rows = rows.union(rest).distinct().join(names, "doc", "left").join(sources, "lead", "left")
    own = lambda number, name: F.when(F.col(number) >= HIGH, F.col(number)).otherwise(F.col(name)).alias(name)
    return rows.select(own("doc", "doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), own("lead", "source_id"), F.col("lead_start").alias("source_start"), F.col("lead_end").alias("source_end"), "matched")

"""Near-duplicate documents: ProbMinHash signatures, banding, exact verification.

A text is the multiset of its shingles of five words, weighted by how often
each occurs. ProbMinHash lets every shingle arrive in a Poisson process whose
rate is its weight; each arrival falls on one register of the signature, and a
register keeps the first. Arrivals later than the latest register stop a
shingle, so most arrive once. Two signatures agree in a register with the
texts' probability Jaccard similarity J.

Distinct word sequences (nodes) that agree in a band of registers share a
bucket. Exact similarities decide, in two steps. First every member is compared
with its bucket's leader, and linked nodes are joined to components. Buckets
whose members are of several components then are taken up once more: only nodes
of different components need comparing, so the members outside a bucket's
largest component are set against all others, both dealt into blocks of bounded
size. A task compares two blocks in memory, each pair in the first bucket that
it shares, and returns only links that join components. So no link is lost and no
bucket is cut. A bucket of n nodes without a large component is read n / 256
times, once for each of its blocks: as texts, n * n / 256 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text
from .components import components
from .store import Scratch, frugal, free_name, materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Registers are BANDS x ROWS; a pair at J = 0.8 misses all bands with probability 3e-6.
BANDS, ROWS = 32, 5
#: Nodes, and bytes of text, that a block holds, about.
BLOCK_NODES, BLOCK_BYTES = 256, 4 << 20
#: Lists of so few nodes are broadcast to pick out their texts; longer ones are shuffled.
SMALL_ROWS = 100_000
_EPS = 1e-9
#: A byte of a word.
_WORD = "[^\\t-\\r ]"
#: Stands for a null id, so that it sorts last.
NO_ID = 2**63 - 1


def weighted_shingles(hashes: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and the text's number."""
    kinds, counts, of = [hashes[:0]], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(at) - 1):
        h, n = np.unique(text.shingles(hashes[at[i] : at[i + 1]], k), return_counts=True)
        kinds.append(h)
        counts.append(n)
        of.append(np.full(len(h), i))
    return np.concatenate(kinds), np.concatenate(counts), np.concatenate(of)


def prob_min_hash(kinds: np.ndarray, weights: np.ndarray, of: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of weighted sets: ``of`` says which set an element is in. Sets must not be empty."""
    first = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    time, going, r = np.zeros(len(kinds)), np.arange(len(kinds)), 0
    while len(going):
        bits = text.salted(kinds[going], 2 * r + 1)
        time = time - np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[going]
        register = of[going] * m + (text.salted(kinds[going], 2 * r + 2) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = time == first[register]
        kept[register[won]] = kinds[going[won]]
        on = time < first.reshape(n, m).max(axis=1)[of[going]]
        time, going, r = time[on], going[on], r + 1
    return kept.reshape(n, m)


def prob_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets with sorted distinct elements."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    xa, xb = na[ia].astype(np.float64), nb[ib].astype(np.float64)
    only_a, only_b = na.sum() - xa.sum(), nb.sum() - xb.sum()
    ratio = xa / xb
    order = np.argsort(ratio, kind="stable")
    ratio, xa, xb = ratio[order], xa[order], xb[order]
    low = np.searchsorted(ratio, ratio, side="left")
    from_a = xa.sum() - np.concatenate(([0.0], np.cumsum(xa)))[low]
    from_b = np.concatenate(([0.0], np.cumsum(xb)))[low]
    return float((1 / ((only_a + from_a) / xa + (only_b + from_b) / xb)).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in text.chunks(texts):
            w = text.words(texts[a:b])
            sizes = np.diff(w.at)
            some = np.flatnonzero(sizes)
            digests = [hashlib.blake2b(w.hashes[w.at[i] : w.at[i + 1]].tobytes(), digest_size=16).digest() for i in some]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kinds, weights, of = weighted_shingles(w.hashes, w.at)
            place = np.full(b - a, -1)
            place[some] = np.arange(len(some))
            kept = prob_min_hash(kinds, weights, place[of], len(some), BANDS * ROWS)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for j in range(ROWS):
                keys = text.mix(keys * np.uint64(text.BASE) + kept.reshape(-1, BANDS, ROWS)[:, :, j])
            keys = text.mix(keys + np.arange(BANDS, dtype=np.uint64))
            rows = pa.array(some + a)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            size = pa.array(np.diff(w.buf_at)[some])
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array(halves[:, 0]), pa.array(halves[:, 1]), bands, size], ["did", "xx", "f1", "f2", "bands", "size"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sets(value: str, known=known) -> tuple[np.ndarray, np.ndarray]:
            if value not in known:
                if len(known) >= 16:
                    known.clear()
                known[value] = np.unique(text.shingles(text.words([value]).hashes, SHINGLE), return_counts=True)
            return known[value]

        out = [1 - prob_jaccard(*sets(x), *sets(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "d"])


class _Sets:
    """Weighted shingles of texts, by their shingles: which texts hold one, and its share in each."""

    def __init__(self, texts: list[str]):
        w = text.words(texts)
        self.own = [np.unique(text.shingles(w.hashes[a:b], SHINGLE), return_counts=True) for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
        sizes = np.array([len(k) for k, _ in self.own])
        kinds = np.concatenate([k for k, _ in self.own])
        of, share = np.repeat(np.arange(len(texts)), sizes), np.concatenate([n / n.sum() for _, n in self.own])
        order = np.argsort(kinds, kind="stable")
        self.of, self.share = of[order], share[order]
        self.kinds, self.first = np.unique(kinds[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def shared(self, kinds: np.ndarray, share: np.ndarray) -> np.ndarray:
        """For each text the least of the two shares that the common shingles make up: no less than the similarity."""
        place = np.minimum(np.searchsorted(self.kinds, kinds), len(self.kinds) - 1)
        hit = self.kinds[place] == kinds
        place, share = place[hit], share[hit]
        n = self.last[place] - self.first[place]
        at = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        of, size = self.of[at], len(self.own)
        return np.minimum(np.bincount(of, np.repeat(share, n), size), np.bincount(of, self.share[at], size))


_BLOCK = "array<struct<node:long,component:long,bands:array<long>,text:string>>"


def _block_links(similarity: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pydict()
                out += _joins(r["bucket"][0], r["one"][0], r["two"][0], similarity)
            cols = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["a", "b"])

    return frugal(links)


def _joins(bucket: int, one: list[dict], two: list[dict] | None, similarity: float) -> list[tuple[int, int]]:
    """Links between nodes of two blocks (or of one: ``two`` is empty) that join components not joined before."""
    alone = not two
    two = one if alone else two
    xs, ys = (np.array([m["bands"] for m in side], np.int64) for side in (one, two))
    component = {m["component"]: m["component"] for m in [*one, *two]}

    def root(c: int) -> int:
        while component[c] != c:
            component[c] = component[component[c]]
            c = component[c]
        return c

    band = int(np.flatnonzero(xs[0] == bucket)[0])
    # a pair counts in the first bucket that it shares
    need = ~(xs[:, None, :band] == ys[None, :, :band]).any(axis=2)
    cx, cy = (np.array([m["component"] for m in side], np.int64) for side in (one, two))
    need &= cx[:, None] != cy[None, :]
    if alone:
        need = np.triu(need, 1)
    if not need.any():
        return []
    theirs = _Sets([m["text"] for m in two])
    mine = theirs.own if alone else _Sets([m["text"] for m in one]).own
    found = []
    for i in np.flatnonzero(need.any(axis=1)).tolist():
        kinds, counts = mine[i]
        near = need[i] & (theirs.shared(kinds, counts / counts.sum()) >= similarity - _EPS)
        for j in np.flatnonzero(near).tolist():
            p, q = root(one[i]["component"]), root(two[j]["component"])
            if p != q and prob_jaccard(kinds, counts, *theirs.own[j]) >= similarity - _EPS:
                component[p] = q
                found.append((one[i]["node"], two[j]["node"]))
    return found


def _keyed(documents: DataFrame) -> DataFrame:
    """text, did (the id, or NO_ID for null) and xx (hash of the text): together they find a text again."""
    return documents.where("text is not null").select("text", _did(), F.xxhash64("text").alias("xx"))


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")


def classes(documents: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """Near-duplicate classes of texts with words: did, xx, class_size, rep (did and xx of the one that stays)."""
    with Scratch() as scratch:
        return materialise(_classes(documents, similarity, scratch), "classes")


def _classes(documents: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    far = 1 - similarity + _EPS
    keyed = _keyed(documents)
    signed = scratch.keep(keyed.select("text", "did", "xx").mapInArrow(frugal(_signatures), "did long, xx long, f1 long, f2 long, bands array<long>, size long"), "signatures")
    nodes = signed.groupBy("f1", "f2").agg(F.min(F.struct("did", "xx")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("size").alias("size"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.keep(rows.join(shared, "bucket"), "members")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of wanted nodes; only their texts are shuffled."""
        wanted = scratch.keep(wanted.distinct().join(nodes.select("node", "rep.did", "rep.xx"), "node"), "wanted")
        rows = keyed.join(F.broadcast(wanted) if wanted.count() <= SMALL_ROWS else wanted, ["did", "xx"]).select("node", "text")
        # repeated rows of one text count once; a table of its own can be split where one node is joined with many
        return scratch.keep(rows.dropDuplicates(["node"]), "texts")

    pairs = scratch.keep(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    one, two = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    compared = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(frugal(_distances), "a long, b long, d double")
    links = scratch.keep(compared.where(F.col("d") <= far).select("a", "b"), "links")
    placed = components(links)
    scratch.frames.append(placed)

    # buckets whose members are of several components: the largest against the rest, and the rest among itself
    here = members.select("bucket", "node").join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    here = scratch.keep(here.join(nodes.select("node", "size"), "node"), "here")
    by = here.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    split = by.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("all"), F.sum("size").alias("all_size"), F.max(F.struct("n", "component", "size"))["size"].alias("top_size")).where("parts > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_BYTES)).cast("int")

    split = split.select("bucket", F.col("top.component").alias("top"), blocks(F.col("top.n"), F.col("top_size")).alias("tops"), blocks(F.col("all") - F.col("top.n"), F.col("all_size") - F.col("top_size")).alias("rests"))
    dealt = here.join(split, "bucket").withColumn("rest", F.col("component") != F.col("top"))
    nth = F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops"))).cast("int")
    rest_with = F.sequence(F.lit(0), F.col("rests") + F.col("tops") - 1)
    dealt = dealt.withColumn("own", nth + F.when(F.col("rest"), 0).otherwise(F.col("rests"))).withColumn("other", F.explode(F.when(F.col("rest"), rest_with).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))))
    dealt = dealt.select("node", "component", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"))
    dealt = scratch.keep(dealt, "dealt")
    if dealt.take(1):
        texts = texts_of(dealt.select("node"))
        member = F.struct("node", "component", "bands", "text")
        filled = dealt.join(nodes.select("node", "bands"), "node").join(texts, "node").groupBy("bucket", "i", "j")
        filled = filled.agg(F.collect_list(F.when(F.col("first"), member)).alias("one"), F.collect_list(F.when(~F.col("first"), member)).alias("two")).where("size(one) > 0 and (i = j or size(two) > 0)")
        more = filled.select("bucket", "one", "two").mapInArrow(_block_links(similarity), "a long, b long")
        more = scratch.keep(more, "more-links")
        if more.take(1):
            placed = components(links.union(more))
            scratch.frames.append(placed)
    joined = nodes.select("node", "f1", "f2", "rep", "copies").join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = joined.groupBy("component").agg(F.min("rep").alias("rep"), F.sum("copies").alias("class_size"))
    of = joined.drop("rep").join(sums, "component").select("f1", "f2", "rep", "class_size")
    return signed.select("did", "xx", "f1", "f2").distinct().join(of, ["f1", "f2"]).select("did", "xx", "rep", "class_size")


def near_duplicates(documents: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, kept.

    Documents are in one class if a chain of links connects them; a link is a
    probability Jaccard similarity of at least ``similarity``, equal word
    sequences included. class_id is the class's smallest id (null if none of
    its documents has one); kept marks the row that stays, which has that id (rows
    with one id and one text are marked alike). Texts that are null or have no
    words are classes of their own, as is each repeated row of them. Texts of
    fewer than five words are one shingle. A long text is compared whole; blocks
    of long texts hold fewer of them. Columns other than doc_id and text are not
    read, so their names do not matter. An empty table gives an empty result.
    """
    ids = documents.select("doc_id", _did(), F.xxhash64("text").alias("xx"), F.col("text").isNull().alias("_null"))
    out = ids.join(classes(documents, similarity=similarity), ["did", "xx"], "left")
    out = out.withColumn("rep", F.when(~F.col("_null"), F.col("rep")))
    alone = F.col("rep").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id").cast("long")).otherwise(F.nullif(F.col("rep.did"), F.lit(NO_ID))).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | ((F.col("did") == F.col("rep.did")) & (F.col("xx") == F.col("rep.xx")))).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, of equal rows one; texts that are null or have no words all stay, as do all columns."""
    did, xx, again = (free_name(documents, c) for c in ("_did", "_xx", "_again"))
    stays = classes(documents, similarity=similarity).where("did = rep.did and xx = rep.xx").select(F.col("did").alias(did), F.col("xx").alias(xx)).distinct()
    worded = F.col("text").rlike(_WORD)
    d = documents.where(worded).withColumns({did: _did(), xx: F.xxhash64("text")}).join(stays, [did, xx], "left_semi")
    d = d.withColumn(again, F.row_number().over(W.partitionBy(did, xx).orderBy(F.lit(1)))).where(F.col(again) == 1)
    return d.select(*_all(documents)).unionByName(documents.where(~F.coalesce(worded, F.lit(False))))


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]

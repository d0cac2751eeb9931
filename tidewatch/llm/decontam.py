"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words under a fixed mask; words at the mask's gaps
may differ. Seeds of the benchmark's items are joined with those of the
documents; each hit proposes an alignment of a whole item with a place in a
document, and the alignment is a leak if at least the wanted share of the
item's words agree there. Items of fewer than LEAST words are hashed as a
whole, once for each choice of the words that may differ.

Most documents are ruled out before any seed is made, without loss: an item of
n words of which m may differ leaks only into documents that have k of any m + k
of its words. Those that the documents have least of are chosen, and looked up
word by word.

Everything runs as DataFrame code on words of the lower-cased text, split at
white space.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import free_name, materialise

SIMILARITY = 0.8
#: Masks (1: hashed). Together they hit every item of LEAST words or more of which a fifth at most differs (tests show it).
MASKS, LEAST = ("10111", "11011", "100111"), 7
#: Tables of so few rows (of a word or a hash each) are broadcast; larger ones are shuffled.
SMALL_ROWS = 100_000
#: So many of an item's chosen words (fewer in short items) must be in a document.
EXTRA = 4
SPACE = "[ \\t\\n\\u000B\\f\\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def seeds(hashes: Column, masks: Sequence[str] = MASKS) -> Column:
    """All seeds of an array of word hashes: array of (at, key)."""

    def under(mask: str) -> Column:
        on = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(hashes) - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(mask), *(F.get(hashes, i + j) for j in on)).alias("key")))

    return F.concat(*map(under, masks))


def short_masks(size: int, allowed: int) -> list[str]:
    """Masks for items of ``size`` words: all ways to leave out ``allowed`` of them."""
    return ["".join("0" if i in gaps else "1" for i in range(size)) for gaps in combinations(range(size), allowed)]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def leaks(documents: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, masks: Sequence[str] = MASKS) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, item_id, place (word), matched, item_words.

    The best alignment of the pair is told: the most words matched, then the
    first place. Null ids are ids like others; rows with one id and one text,
    and items with one id and one text, count once. Texts that are null or have no words hold
    nothing and leak nowhere. A long text is read whole. Columns other than
    the ids and texts are not read. Without documents or items there are no rows.
    """
    return _leaks(documents, benchmark, similarity, masks).drop("dk")


def _leaks(documents: DataFrame, benchmark: DataFrame, similarity: float, masks: Sequence[str]) -> DataFrame:
    allowed = F.floor(F.size("w") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    items = benchmark.where("text is not null").select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("ik"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = materialise(items.select("item_id", "ik", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("ih"), allowed.alias("m")), "items")
    longest = max(LEAST, *map(len, masks))
    sizes = items.where(F.size("ih") < longest).select(F.size("ih").alias("n"), "m").distinct().collect()  # fewer than a mask is long
    masks = [*masks, *(k for r in sizes for k in short_masks(r["n"], r["m"]))]
    keyed = documents.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    vocabulary = materialise(items.select(F.explode("w").alias("x")).distinct(), "vocabulary")
    often = keyed.select(F.explode(F.split(F.lower("text"), SPACE)).alias("x")).join(_small(vocabulary), "x", "left_semi").groupBy("x").agg(F.count("*").alias("n"))
    ranked = items.select("ik", "m", F.size("w").alias("n_words"), F.posexplode("w").alias("p", "x")).join(often, "x", "left")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("ik").orderBy(F.coalesce("n", F.lit(0)), "x", "p")))
    upto = F.least(F.col("n_words"), F.col("m") + EXTRA)
    telling = ranked.where(F.col("r") <= upto).groupBy("ik", (upto - F.col("m")).alias("need"), "x").agg(F.count("*").alias("weight"))
    telling = materialise(telling, "telling")
    near = keyed.select("dk", F.explode(F.split(F.lower("text"), SPACE)).alias("x")).join(_small(telling), "x").select("dk", "ik", "need", "x", "weight").distinct()
    near = near.groupBy("dk", "ik", "need").agg(F.sum("weight").alias("has")).where("has >= need").select("dk", "ik")
    near = materialise(near, "near")
    chosen = keyed.join(_small(near.select("dk").distinct()), "dk").select("dk", "doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("dh"))
    chosen = materialise(chosen, "chosen")
    item_seeds = items.select("ik", F.explode(seeds(F.col("ih"), masks)).alias("s")).select("ik", F.col("s.key").alias("key"), F.col("s.at").alias("q"))
    doc_seeds = chosen.select("dk", F.explode(seeds(F.col("dh"), masks)).alias("s")).select("dk", F.col("s.key").alias("key"), F.col("s.at").alias("p"))
    item_seeds = materialise(item_seeds, "item-seeds")
    doc_seeds = doc_seeds.join(_small(item_seeds.select("key").distinct()), "key", "left_semi")
    hits = doc_seeds.join(item_seeds, "key").select("dk", "ik", (F.col("p") - F.col("q")).alias("at")).join(near, ["dk", "ik"], "left_semi").distinct()
    aligned = hits.join(items.select("ik", "item_id", "ih"), "ik").join(chosen, "dk")
    begin = F.greatest(F.col("at"), F.lit(0))
    there = F.slice("dh", begin + 1, F.greatest(F.size("ih") + F.col("at") - begin, F.lit(0)))
    mine = F.slice("ih", begin - F.col("at") + 1, F.size("ih"))
    matched = F.aggregate(F.zip_with(mine, there, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    found = aligned.select("dk", "ik", "doc_id", "item_id", begin.alias("place"), matched.alias("matched"), F.size("ih").alias("item_words"))
    found = found.where(F.col("matched") >= F.col("item_words") * F.lit(similarity) - F.lit(1e-9))
    best = F.max_by(F.struct("doc_id", "item_id", "place", "matched", "item_words"), F.struct("matched", -F.col("place")))
    return found.groupBy("dk", "ik").agg(best.alias("b")).select("dk", "b.*")


def without_leaks(documents: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` without those that hold a benchmark item, with all their columns; null texts stay."""
    dk = free_name(documents, "_dk")
    bad = _leaks(documents, benchmark, similarity, MASKS).select(F.col("dk").alias(dk)).distinct()
    # few documents leak as a rule, but their number has no bound
    return documents.withColumn(dk, F.xxhash64("doc_id", "text")).join(_small(materialise(bad, "leaky")), dk, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))


#: The same in SQL: every alignment of every item that shares at least one word there.
LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS dw FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS iw FROM benchmark WHERE text IS NOT NULL
), dx AS (
  SELECT doc_id, unnest(dw) AS x, unnest(range(len(dw))) AS p FROM d
), ix AS (
  SELECT item_id, unnest(iw) AS x, unnest(range(len(iw))) AS q, len(iw) AS n FROM i
), m AS (
  SELECT doc_id, item_id, p - q AS place, count(*) AS matched, any_value(n) AS n
  FROM dx JOIN ix USING (x) GROUP BY ALL
), ok AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, place) AS r
  FROM m WHERE matched >= n * 0.8 - 1e-9
)
SELECT doc_id, item_id, greatest(place, 0)::INTEGER AS place, matched::INTEGER AS matched, n::INTEGER AS item_words FROM ok WHERE r = 1
"""

"""How filters of a corpus interact, over every order in which they can be applied.

All orders form a trie: a node is what the filters on its path have left, an
edge applies one more. Nodes with the same set of filters hold the same rows, so
a node is made once, when the walk first comes to it, and remembered. The walk
goes depth first: a node's survivors are its parent's persisted survivors
without those that its own last filter removes, they are persisted while the
walk is below them, and what every filter yet to come removes from them is
counted on the rows themselves. With n filters that is 2**n - 1 passes instead
of n! * n, each over the survivors only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Rows of one text are spread over so many keys where they look up the text's first document.
SALTS = 16
#: ASCII white space, as a pattern.
_BLANK = "[ \\t\\n\\u000B\\f\\r]+"
LETTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: under 100 words; under 80 % distinct words; over 10 % of A-Z; any of #$%&*|."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: part, fails_A to fails_E, good, toxic.

    A null text is empty and a null lang the empty part. E is a text that a smaller
    doc_id has as well, anywhere in the table: of several rows with one id and one
    text none fails for the other's sake, and a row without id fails nothing by
    E and is no one's smaller document. A document is good, or toxic, if any of
    its labels says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *(f.alias(f"fails_{k}") for k, f in text_failures(text).items()))
    first = documents.where(F.col("doc_id").isNotNull()).groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(F.col("doc_id").cast("long")).alias("first"), F.max(F.col("doc_id").cast("long")).alias("last")).where("first < last")
    # a third of all rows may be one text, so its rows look the first document up under several keys
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    d = d.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"), F.lit(0))).join(first, ["digest", "salt"], "left")
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    is_ = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return d.join(told, "doc_id", "left").select("part", *(f"fails_{k}" for k in "ABCD"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("fails_E"), is_("q").alias("good"), is_("t").alias("toxic"))


def edges(rows: DataFrame, filters: Sequence[str]) -> tuple[DataFrame, Scratch]:
    """Every edge of the trie, by part: part, mask (bit i: filters[i] is applied before), letter, there, removed, good_lost, toxic_lost.

    ``rows`` has part, good, toxic and fails_<letter> for each filter. Persisted
    rows that an executor loses are made again from the table of ``rows``.
    Returned with the tables it reads.
    """
    scratch, counts = Scratch(), {}
    start = scratch.keep(rows, "judged")

    def walk(survivors: DataFrame, mask: int) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(len(filters)) if not mask >> i & 1]
        n = lambda c: F.count(F.when(c, 1))
        sums = [F.count("*").alias("there")]
        for i in left:
            fails = F.col(f"fails_{filters[i]}")
            sums += [n(fails).alias(f"removed_{i}"), n(fails & F.col("good")).alias(f"good_{i}"), n(fails & F.col("toxic")).alias(f"toxic_{i}")]
        of_edge = [F.struct(F.lit(mask).alias("mask"), F.lit(filters[i]).alias("letter"), F.col("there"), *(F.col(f"{c}_{i}").alias(c) for c in ("removed", "good", "toxic"))) for i in left]
        counts[mask] = scratch.keep(survivors.groupBy("part").agg(*sums).select("part", F.explode(F.array(*of_edge)).alias("e")).select("part", "e.*").coalesce(1), f"edges-{mask}")
        for i in left:
            below = mask | 1 << i
            if below not in counts and below != (1 << len(filters)) - 1:
                walk(survivors.where(~F.col(f"fails_{filters[i]}")), below)
        survivors.unpersist()

    walk(start, 0)
    told = reduce(DataFrame.unionByName, counts.values())
    return told.select("part", "mask", "letter", "there", "removed", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost")), scratch


def interactions(rows: DataFrame, filters: Sequence[str] = LETTERS) -> DataFrame:
    """One row for each part, order of all ``filters`` (filter_order) and step (from 1); counts are of the part's documents.

    kept: left after the step. removed: by the step. redundant: failing the step's
    filter but removed by one before. unique_fails: failing this filter and no
    other. good_lost, toxic_lost: of those removed. shapley: what the filter
    removes, summed over all orders. Parts without survivors at a node count 0.
    Rows are counted one by one, so repeated rows count as often as they stand
    there. An empty table has no part and gives an empty result.
    """
    spark = rows.sparkSession
    filters = list(filters)
    known, scratch = edges(rows, filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(p), s + 1, sum(bit[f] for f in p[:s]), f) for p in permutations(filters) for s, f in enumerate(p)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, mask int, letter string")
    uses = spark.createDataFrame([(m, f, sum(s[2] == m and s[3] == f for s in steps)) for m, f in {(s[2], s[3]) for s in steps}], "mask int, letter string, uses long")
    every = (1 << len(filters)) - 1
    whole = known.where("mask = 0").select("part", "letter", F.col("removed").alias("failing"))
    only = reduce(Column.__or__, ((F.col("letter") == f) & (F.col("mask") == every ^ b) for f, b in bit.items()))
    of_filter = known.join(uses, ["mask", "letter"]).groupBy("part", "letter").agg(F.sum(F.col("removed") * F.col("uses")).alias("shapley"), F.sum(F.when(only, F.col("removed")).otherwise(0)).alias("unique_fails"))
    # every part stands at every edge, also where none of its documents is left
    nodes = whole.select("part", "letter", "failing").join(orders, "letter")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = nodes.join(known, ["part", "mask", "letter"], "left").join(of_filter, ["part", "letter"])
    out = out.select("part", "filter_order", "step", zero("there"), zero("removed"), "failing", "unique_fails", zero("good_lost"), zero("toxic_lost"), "shapley")
    out = out.select("part", "filter_order", "step", (F.col("there") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    return scratch.result(out, "interactions")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`interactions` of filters A to E over ``documents``.

    Whole texts are judged, however long, once, before the walk. Columns other
    than doc_id, text, lang and doc_id, quality, toxic are not read, whatever
    their names; see :func:`judged` for nulls, repeated rows and equal texts.
    """
    return interactions(judged(documents, labels))


_ORDERS = ", ".join(f"('{''.join(p)}', {s + 1}, {sum(1 << LETTERS.index(x) for x in p[:s])}, {1 << LETTERS.index(f)})" for p in permutations(LETTERS) for s, f in enumerate(p))
#: The rows of the query, in DuckDB: documents counted by the set of filters that they fail.
AUDIT_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), k AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS words FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(k.doc_id > first, FALSE)::INT AS fails
  FROM k LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), o(filter_order, step, mask, bit) AS (VALUES {_ORDERS}
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (mask | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & mask = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & mask > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & mask = 0 AND fails & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & mask = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM n CROSS JOIN o GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

"""Repeated runs of lines, found by a suffix array over line numbers.

Each distinct line is a number; a document is the sequence of its lines that
are not blank. Only lines that occur more than once can be in a repeated run, so
only their positions are sorted, and a suffix ends where such lines do. Prefix
doubling ranks all suffixes: in round k a suffix's rank among those with the
same first 2**k lines is refined by the rank of the suffix 2**k lines on. The
rank is the number of smaller suffixes, so a group is refined within its own
range of ranks: pairs of ranks are counted first, and only the counts of a
group are put in order. Rounds end when no group can be split.

The groups of round k are the intervals of the suffix array with longest common
prefixes of at least 2**k lines (or of all that a suffix has). In each, all but the first occurrence (by
doc_id, then line) are later copies, and so are the 2**k lines from there. The
union of these stretches is that of the later copies of all maximal repeated
runs, as every part of a run is itself a repeated run.

Everything runs as DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import discard, free_name, materialise

BLANKS = " \t\r\f\u000b"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(documents: DataFrame) -> DataFrame:
    """Lines that are not blank: doc_id, dk (document), ord (number among them), pos (number among all), two hashes, wordy."""
    d = documents.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(_trimmed(x).alias("x"), i.alias("pos")))
    d = d.select("doc_id", "dk", F.posexplode(F.filter(every, lambda s: s["x"] != "")).alias("ord", "s"))
    x = F.col("s.x")
    return d.select("doc_id", "dk", "ord", F.col("s.pos").alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), x.rlike("[ \\t]").alias("wordy"))


def repeated_runs(documents: DataFrame) -> tuple[DataFrame, int]:
    """Positions of repeated lines with their final rank and depth; and the number of rounds.

    depth is the largest power of two so that the run of that many lines from
    here, or of all up to the next line that is not repeated, has an earlier
    occurrence (0: not even the line has).
    """
    lines = materialise(_lines(documents), "lines")
    spot = F.struct("doc_id", "dk", "ord")
    kinds = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1")
    kinds = materialise(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    # rank: how many positions have a smaller line number
    part = F.shiftright("id", 33)
    sums = kinds.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.withColumn("part", part).withColumn("_in", inner).join(before, "part").select("h1", "h2", "first", (F.col("before") + F.col("_in")).alias("rank"))
    at = lines.join(kinds, ["h1", "h2"]).select("doc_id", "dk", F.col("ord").cast("long"), "pos", "wordy", "rank", F.when(F.struct("doc_id", "dk", "ord") > F.col("first"), 1).otherwise(0).cast("long").alias("depth"))
    at = at.dropDuplicates(["dk", "ord"])  # repeated rows are one document
    island = F.col("ord") - F.row_number().over(W.partitionBy("dk").orderBy("ord"))
    at = at.withColumn("_island", island)
    at = at.withColumn("left", F.count("*").over(W.partitionBy("dk", "_island").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, 0))).drop("_island")
    at = materialise(at, "positions")
    discard(lines)
    rounds = 0
    while True:
        reach = 1 << rounds
        there = F.max("rank").over(W.partitionBy("dk").orderBy("ord").rangeBetween(reach, reach))
        # a suffix that ends before the second half sorts first
        paired = at.withColumn("second", F.when(F.col("left") > reach, there).otherwise(F.lit(-1)))
        paired = materialise(paired, "pairs")
        groups = paired.groupBy("rank", "second").agg(F.count("*").alias("n"), F.min(spot).alias("first"))
        smaller = F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("second").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        groups = materialise(groups.withColumn("smaller", smaller), "groups")
        if not groups.where("n > 1 and second >= 0").take(1):
            discard(paired, groups)
            break
        longer = (F.col("second") >= 0) & (F.col("n") > 1) & (F.struct("doc_id", "dk", "ord") > F.col("first"))
        fresh = paired.join(groups, ["rank", "second"]).select("doc_id", "dk", "ord", "pos", "wordy", (F.col("rank") + F.col("smaller")).alias("rank"), F.when(longer, F.least(F.lit(2 * reach), F.col("left"))).otherwise(F.col("depth")).cast("long").alias("depth"), "left")
        fresh = materialise(fresh, "positions")
        for stale in (at, paired, groups):
            discard(stale)
        at, rounds = fresh, rounds + 1
    return at, rounds


def later_copies(documents: DataFrame) -> DataFrame:
    """Lines to delete: dk, removed (line numbers, from 0). A lone repeated line of one word stays."""
    at, _ = repeated_runs(documents)
    upto = F.max(F.when(F.col("depth") >= 2, F.col("ord") + F.col("depth"))).over(W.partitionBy("dk").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    gone = at.withColumn("_upto", upto).where((F.coalesce("_upto", F.lit(0)) > F.col("ord")) | ((F.col("depth") >= 1) & F.col("wordy")))
    return gone.groupBy("dk").agg(F.collect_set("pos").alias("removed"))


def _cut(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """``documents`` with later copies cut from ``text``, and the names of two columns more: lines, and lines removed."""
    dk, gone, lines, removed = (free_name(documents, c) for c in ("_dk", "_gone", "_lines", "_removed"))
    d = documents.withColumn(dk, F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    d = d.join(later_copies(documents).select(F.col("dk").alias(dk), F.col("removed").alias(gone)), dk, "left")
    split = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    cut = d.select(
        *(F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias(lines),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias(removed),
    )
    return cut, lines, removed


def without_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with later copies of repeated line runs cut from ``text``; other columns stay, whatever their names.

    A run of two lines or more counts, and a single line that holds two words;
    lines are compared without blanks around them; blank lines neither count
    nor break a run, and stay. The first copy, by doc_id (nulls first) and
    line, stays whole. Rows with one id and one text are one document and keep
    their lines alike. Null texts stay null and have no lines; an empty text is
    one blank line. A long text is taken whole, line by line. An empty table
    gives an empty table.
    """
    return _cut(documents)[0].select(*(F.col(f"`{c}`") for c in documents.columns))


def cleaned(documents: DataFrame) -> DataFrame:
    """:func:`without_repeats` with ``n_chars``, if there is one, brought up to date; a document that has lost all its lines goes."""
    d, _, removed = _cut(documents)
    d = d.where((F.col(removed) == 0) | (F.length(F.btrim("text", F.lit(BLANKS + "\n"))) > 0))
    return d.select(*(F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns))


def line_report(documents: DataFrame) -> DataFrame:
    """What is left of each document: doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    d, lines, removed = _cut(documents.select("doc_id", "text"))
    return d.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col(lines)).cast("long").alias("n_lines"), F.col(removed).alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: The same in SQL: a line goes if it, or a pair of neighbours it is in, occurred before.
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS x FROM l
), t AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord,
         lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y
  FROM b WHERE x <> ''
), c AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1 AS later,
         y IS NOT NULL AND row_number() OVER (PARTITION BY x, y ORDER BY doc_id, pos) > 1 AS later2
  FROM t
), g AS (
  SELECT doc_id, pos, later2 OR coalesce(lag(later2) OVER (PARTITION BY doc_id ORDER BY pos), false)
         OR (later AND regexp_matches(x, '[ \t]')) AS gone FROM c
), k AS (
  SELECT b.doc_id, b.pos, b.line, coalesce(g.gone, false) AS gone FROM b LEFT JOIN g USING (doc_id, pos)
), r AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""

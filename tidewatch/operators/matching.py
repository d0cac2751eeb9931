"""Joins by range, by containment and by likeness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..functions.similarity import name_similarity


def ip_number(ip: Column) -> Column:
    """IPv4 text to a number; null for anything else."""
    parts = F.split(ip, "\\.")
    n = sum((F.get(parts, i).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, 0).cast("long") * 256**3)
    return F.when(ip.rlike("^(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"), n)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _six_bits(ip: Column) -> Column:
    """The bits of an IPv6 address in lower case, whose dotted tail has become two groups."""
    none = F.array().cast("array<string>")
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", none).otherwise(F.split(side, ":"))
    bits = lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")

    def filled(sides: Column, left: Column, right: Column) -> Column:
        gap = 8 - F.size(left) - F.size(right)
        whole = F.when(F.size(sides) == 1, gap == 0).otherwise((F.size(sides) == 2) & (gap > 0)) & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(whole, F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), gap), right), bits), ""))

    return _let(F.split(ip, "::"), lambda s: _let(groups(F.get(s, 0)), lambda x: _let(groups(F.get(s, 1)), lambda y: filled(s, x, y))))


def ip_bits(ip: Column) -> Column:
    """The bits of an address as text: 32 of IPv4, 128 of IPv6 (a zone is left out); null for anything else."""
    group = lambda n: F.lower(F.hex(n))
    dotted = lambda x: F.regexp_extract(x, "^(.*:)([0-9]+(?:\\.[0-9]+){3})$", 2)
    # a dotted tail that is no address gives null
    plain = lambda x: _let(dotted(x), lambda t: F.when(t == "", x).otherwise(_let(ip_number(t), lambda n: F.concat(F.left(x, F.length(x) - F.length(t)), group(F.shiftright(n, 16)), F.lit(":"), group(n.bitwiseAND(F.lit(65535)))))))
    six = _let(_let(F.lower(F.regexp_replace(ip, "%[^%/\\s]+$", "")), plain), _six_bits)
    return F.when(ip.contains(":"), six).otherwise(F.lpad(F.conv(ip_number(ip).cast("string"), 10, 2), 32, "0"))


def cidr_ranges(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Adds prefix, lo and hi of IPv4 ranges, and net of IPv6 ranges: the bits that all their addresses share."""
    prefix = F.element_at(F.split(cidr, "/"), 2).cast("int")
    address = F.element_at(F.split(F.col(cidr), "/"), 1)
    size = F.pow(F.lit(2.0), 32 - prefix).cast("long")
    lo = F.floor(ip_number(address) / size) * size
    return ranges.withColumn("prefix", prefix).withColumn("lo", lo.cast("long")).withColumn("hi", (lo + size - 1).cast("long")).withColumn("net", F.when(address.contains(":"), _net(ip_bits(address), prefix)))


def _net(bits: Column, prefix: Column) -> Column:
    return F.substring(bits, F.lit(1), prefix)


def longest_prefix(events: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Each event with the columns of the narrowest range that holds its address, IPv4 or IPv6 (nulls if none does).

    Addresses are looked up once each. A range of prefix p holds an address exactly if the first p bits of both are
    equal (of IPv4: the address without its low 32 - p bits is the range's base), so each prefix length in use is one
    equi-join key: no range comparison, and any number of ranges.
    """
    addresses = events.select(F.col(ip).alias("_a")).distinct()
    value = F.struct(*(c for c in ranges.columns if c not in ("lo", "hi", "prefix", "net"))).alias("_v")
    kinds = ranges.select("prefix", F.col("lo").isNull().alias("six")).distinct().collect()  # 162 at most
    each = lambda six: F.explode(F.array(*(F.lit(k["prefix"]) for k in kinds if k["six"] == six)).cast("array<int>")).alias("prefix")
    four = addresses.withColumn("_ip", ip_number(F.col("_a"))).where("_ip is not null").select("_a", "_ip", each(False))
    four = four.withColumn("lo", F.col("_ip") - F.col("_ip") % F.pow(F.lit(2.0), 32 - F.col("prefix")).cast("long"))
    found = four.join(ranges.select("prefix", "lo", value), ["prefix", "lo"]).select("_a", "prefix", "_v")
    if any(k["six"] for k in kinds):
        six = addresses.where(F.col("_a").contains(":")).select("_a", ip_bits(F.col("_a")).alias("_bits")).select("_a", "_bits", each(True))
        six = six.select("_a", "prefix", _net(F.col("_bits"), F.col("prefix")).alias("net"))
        found = found.union(six.join(ranges.where("lo is null").select("prefix", "net", value), ["prefix", "net"]).select("_a", "prefix", "_v"))
    found = found.groupBy("_a").agg(F.max_by("_v", "prefix").alias("_v"))
    return events.join(found, events[ip] == found["_a"], "left").select(*(events[c] for c in events.columns), "_v.*")


def keyword_score(value: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords in a folded text, 1 at most."""
    folded = tx.fold(F.coalesce(value, F.lit("")))
    return F.least(F.lit(1.0), sum((F.when(folded.contains(k), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)))


def keyword_hits(value: Column, keywords: Sequence[str]) -> Column:
    folded = tx.fold(F.coalesce(value, F.lit("")))
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: folded.contains(k))


def name_forms(records: DataFrame, id_col: str, names: str = "names") -> DataFrame:
    """One row a name: id, form (fuzzy), normal (normalised)."""
    n = records.select(F.col(id_col).alias("rec_id"), F.explode(names).alias("name")).where("name is not null")
    return n.select("rec_id", tx.fuzzy_form(F.col("name")).alias("form"), tx.normalise(F.col("name")).alias("normal"))


def exact_token_matches(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """(q_id, rec_id) where all words of the query are words of one of the record's names."""
    words = lambda c: F.array_sort(F.array_distinct(tx.tokens(c)))
    q = queries.select("q_id", words(tx.normalise(F.col("name"))).alias("qt")).where(F.size("qt") > 0)
    f = forms.select("rec_id", words(F.col("normal")).alias("ft"))
    # sets of words are matched, each once, and then given to the queries and records that have them
    asked, named = q.select("qt").distinct(), f.select("ft").distinct()
    shared = asked.select("qt", F.explode("qt").alias("t")).join(named.select("ft", F.explode("ft").alias("t")), "t")
    found = shared.groupBy("qt", "ft").count().where(F.col("count") == F.size("qt")).select("qt", "ft")
    return _spread(q, found.join(f, "ft").select("qt", "rec_id").distinct(), "qt")


def _spread(queries: DataFrame, found: DataFrame, form: str) -> DataFrame:
    """(q_id, rec_id) of queries (q_id, form) and distinct (form, rec_id): every pair once.

    A query with one form, which is nearly each, has its records from one list and meets them
    once; the lists are joined as rows, each form's dealt in parts, so that no task takes all queries of a form.
    """
    parts = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    q = queries.select("q_id", form).distinct()
    many = q.groupBy("q_id").agg(F.count("*").alias("_n"), F.min(form).alias(form))
    one = many.where("_n = 1").select("q_id", form, F.pmod(F.xxhash64("q_id"), F.lit(parts)).alias("_part"))
    each = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    out = one.join(each, [form, "_part"]).select("q_id", "rec_id")
    several = many.where("_n > 1").select(F.col("q_id").alias("_several"))
    rest = q.join(several, q["q_id"].eqNullSafe(several["_several"]), "left_semi").join(found, form).select("q_id", "rec_id").distinct()
    return out.union(rest)


def blocking_candidates(queries: DataFrame, forms: DataFrame, shared_ngrams: int = 2, phonetic: bool = True) -> DataFrame:
    """(q_id, rec_id) that share a phonetic key, or enough 3-grams of one query word.

    Each distinct query word is looked up once, however many queries have it, and so is each distinct set of words.
    """
    q = queries.select("q_id", F.array_sort(F.array_distinct(tx.tokens(tx.fuzzy_form(F.col("name"))))).alias("qt")).where(F.size("qt") > 0)
    r = forms.withColumn("w", F.explode(tx.tokens(F.col("form")))).select("rec_id", "w").distinct()
    sets = q.select("qt").distinct().select("qt", F.explode("qt").alias("w"))
    asked = sets.select("w").distinct()
    grams = asked.select("w", F.explode(tx.ngrams(F.col("w"))).alias("g")).join(r.select("rec_id", F.explode(tx.ngrams(F.col("w"))).alias("g")).distinct(), "g")
    found = grams.groupBy("w", "rec_id").agg(F.count("*").alias("n")).where(F.col("n") >= shared_ngrams).select("w", "rec_id")
    if phonetic:
        found = found.union(asked.select("w", tx.phonetic(F.col("w")).alias("k")).join(r.select("rec_id", tx.phonetic(F.col("w")).alias("k")).distinct(), "k").select("w", "rec_id"))
    return _spread(q, sets.join(found, "w").select("qt", "rec_id").distinct(), "qt")


def screen(queries: DataFrame, records: DataFrame, *, fuzzy: float = 0.93, single: float = 0.96) -> DataFrame:
    """Names against a list: q_id, rec_id, match_type, match_score, confidence.

    queries: q_id, name, birth_year, country; records: rec_id, names, birth_year,
    country. An exact match has all its words in one name; a fuzzy one is alike
    enough; a query of one word must be more alike and agree in year or country.
    A known year or country that agrees raises the confidence, one that differs lowers it.
    """
    forms = name_forms(records, "rec_id")
    exact = exact_token_matches(queries, forms).withColumn("exact", F.lit(True))
    pairs = blocking_candidates(queries, forms).join(exact, ["q_id", "rec_id"], "full").withColumn("exact", F.coalesce("exact", F.lit(False)))
    q = queries.select("q_id", tx.fuzzy_form(F.col("name")).alias("qf"), F.col("birth_year").alias("qb"), F.upper("country").alias("qc"))
    r = records.select("rec_id", F.col("birth_year").alias("rb"), F.upper("country").alias("rc"))
    unsure = pairs.where("not exact").join(q.select("q_id", "qf"), "q_id").join(forms, "rec_id").select("q_id", "rec_id", "qf", "form")
    # each pair of distinct forms is scored once
    scored = unsure.select("qf", "form").distinct().withColumn("s", name_similarity("qf", "form"))
    likeness = unsure.join(scored, ["qf", "form"]).groupBy("q_id", "rec_id").agg(F.max("s").alias("score"))
    j = pairs.join(likeness, ["q_id", "rec_id"], "left").join(q, "q_id").join(r, "rec_id")
    j = j.withColumn("score", F.when(F.col("exact"), 1.0).otherwise(F.col("score")))
    year, land = F.col("qb") == F.col("rb"), F.when((F.col("rc") != "") & (F.col("qc") != ""), F.col("qc") == F.col("rc"))
    agrees = F.coalesce(year, F.lit(False)) | F.coalesce(land, F.lit(False))
    one = F.size(tx.tokens(F.col("qf"))) < 2
    j = j.where(F.col("exact") | F.when(one, (F.col("score") >= single) & agrees).otherwise(F.col("score") >= fuzzy))
    conf = F.col("score")
    for agreed, bonus, factor in ((year, 0.05, 0.75), (land, 0.03, 0.85)):
        conf = F.when(agreed, F.least(F.lit(1.0), conf + bonus)).when(~agreed, conf * factor).otherwise(conf)
    return j.select("q_id", "rec_id", F.when(F.col("exact"), "exact").otherwise("fuzzy").alias("match_type"), F.round("score", 4).alias("match_score"), F.round(conf, 4).alias("confidence"))


def screen_payments(payments: DataFrame, records: DataFrame, *, least: float = 0.45) -> DataFrame:
    """Customers and beneficiaries of payments against a list: tx_id, rec_id, matched_on, match_type, match_score, confidence.

    payments: tx_id, customer_name, birth_year, country, beneficiary_name, beneficiary_id. A customer is asked for with
    birth year and country, a beneficiary by name alone, and by its identifier where that has a space within.
    Each distinct question is asked once. A record and a name come once a payment, by the first question that finds
    them; hits of less confidence than ``least`` do not count. Null and empty names ask nothing.
    """
    role = lambda nth, name, year, land: F.struct(F.lit(nth).alias("nth"), name.alias("name"), year.cast("int").alias("birth_year"), land.cast("string").alias("country"))
    none, code = F.lit(None), F.col("beneficiary_id")
    roles = F.array(role(1, F.col("customer_name"), F.col("birth_year"), F.col("country")), role(2, F.col("beneficiary_name"), none, none), role(3, F.when(F.trim(code).contains(" "), code), none, none))
    asked = payments.select("tx_id", F.explode(roles).alias("r")).select("tx_id", "r.*").where("name <> ''")
    asked = asked.withColumn("q_id", F.sha2(F.to_json(F.struct("name", "birth_year", "country")), 256))
    hits = screen(asked.select("q_id", "name", "birth_year", "country").distinct(), records).where(F.col("confidence") >= least)
    found = asked.join(hits, "q_id").groupBy("tx_id", "rec_id", F.col("name").alias("matched_on"))
    return found.agg(F.min_by(F.struct("match_type", "match_score", "confidence"), "nth").alias("h")).select("tx_id", "rec_id", "matched_on", "h.*")


def confirm_payee(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """EXACT, CLOSE, NO_MATCH or UNKNOWN for (q_id, iban, name) against (iban, name); the registered name is masked."""
    clean = lambda c: F.upper(F.replace(F.col(c), F.lit(" "), F.lit("")))
    reg = registry.select(clean("iban").alias("_iban"), F.col("name").alias("_registered"))
    j = queries.withColumn("_iban", clean("iban")).join(reg, "_iban", "left")
    a, b = tx.fuzzy_form(F.coalesce("name", F.lit(""))), tx.fuzzy_form(F.coalesce("_registered", F.lit("")))
    j = j.withColumn("_a", a).withColumn("_b", b).withColumn("similarity", F.round(name_similarity("_a", "_b"), 4))
    known = (F.col("_a") != "") & (F.col("_b") != "")
    result = F.when(~known, "UNKNOWN").when((F.col("_a") == F.col("_b")) | (F.col("similarity") >= 0.97), "EXACT").when(F.col("similarity") >= 0.85, "CLOSE").otherwise("NO_MATCH")
    j = j.withColumn("result", result)
    return j.select("q_id", "result", F.when(known, F.col("similarity")).otherwise(0.0).alias("similarity"), F.when(F.col("result").isin("CLOSE", "NO_MATCH"), tx.mask_name(F.col("_registered"))).alias("registered_name_masked"))


def build_registry(payees: DataFrame, customers: DataFrame) -> DataFrame:
    """Payee accounts of a file, and those of customers that are not in it."""
    key = lambda d: d.withColumn("_k", F.upper(F.replace(F.col("iban"), F.lit(" "), F.lit(""))))
    own = key(customers.where("iban is not null and iban <> ''")).join(key(payees).select("_k"), "_k", "left_anti")
    return key(payees).unionByName(own, allowMissingColumns=True).drop("_k")


def consortium_hits(events: DataFrame, reports: DataFrame, kind: str, value: str, salt: str, own_bank: str) -> DataFrame:
    """tx_id and the other banks that reported the event's value, by salted digest."""
    e = events.select("tx_id", tx.digest(kind, F.col(value), salt).alias("digest"))
    r = reports.where(F.col("bank") != own_bank).select("digest", "bank").distinct()
    return e.join(r, "digest").groupBy("tx_id").agg(F.array_join(F.array_sort(F.collect_set("bank")), ",").alias("banks"))


def peer_average(records: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of the others of the group; one's own value if there are none."""
    w = W.partitionBy(group)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return records.withColumn("peer_average", F.when(n > 1, (total - F.col(value)) / (n - 1)).otherwise(F.col(value)))


#: Components of the vectors that a task takes from either side, and rows of them at most.
COMPONENTS, SLICE = 1 << 23, 65_536
#: Queries multiplied with a slice at once.
_AT_ONCE = 256


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]:
    """Lengths (0: no cosine) of a column of lists of doubles, and a function that gives rows of one length as unit vectors."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).to_numpy()
    starts = np.concatenate(([0], np.cumsum(sizes)))
    odd = np.concatenate(([0.0], np.cumsum(np.where(np.isfinite(flat), 0.0, 1.0))))
    good = odd[starts[1:]] == odd[starts[:-1]]
    norms = np.zeros(len(sizes))
    full = np.flatnonzero(sizes > 0)
    if len(full):
        with np.errstate(over="ignore", invalid="ignore"):
            norms[full] = np.sqrt(np.add.reduceat(flat * flat, starts[full]))
    good &= (norms > 0) & np.isfinite(norms)
    starts = starts[:-1]
    return np.where(good, sizes, 0), lambda rows, size: flat[starts[rows][:, None] + np.arange(size)] / norms[rows][:, None]


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        v_ids, q_ids = left.column("v_id").to_numpy(), right.column("q_id").to_numpy()
        v_sizes, v = _units(left.column("v"))
        q_sizes, q = _units(right.column("q"))
        found = [(0, v_ids[:0], np.zeros(0))]
        # by identifier, so that of equal cosines the first are those that stay
        order = np.argsort(v_ids, kind="stable")
        for size in np.unique(q_sizes):
            own = np.flatnonzero(q_sizes == size)
            like = order[v_sizes[order] == size] if size else order[:0]
            rest = order[v_sizes[order] != size] if size else order
            matrix = v(like, size)
            for a in range(0, len(own), _AT_ONCE):
                part = own[a : a + _AT_ONCE]
                cosines = np.floor(q(part, size) @ matrix.T * 1e6 + 0.5) / 1e6 if len(like) else np.zeros((len(part), 0))
                for row, i in enumerate(part):
                    c = np.where(v_ids[like] == q_ids[i], -np.inf, cosines[row])
                    if len(c) > k:
                        c[c < np.partition(c, len(c) - k)[len(c) - k]] = -np.inf
                    best = np.flatnonzero(c > -np.inf)
                    best = best[np.argsort(-c[best], kind="stable")][:k]
                    found.append((q_ids[i], v_ids[like[best]], c[best]))
                    if len(best) < k:
                        none = rest[v_ids[rest] != q_ids[i]][: k - len(best)]
                        found.append((q_ids[i], v_ids[none], np.full(len(none), np.nan)))
        who = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        ids, cosine = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        return pa.table({"q_id": pa.array(who, pa.int64()), "v_id": pa.array(ids, pa.int64()), "cosine": pa.array(cosine, pa.float64(), from_pandas=True)})

    return nearest


def cosine_neighbours(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector: str = "embedding", same: str | None = None) -> DataFrame:
    """The k nearest vectors by cosine (to 6 digits) of a stated query set, among rows equal in ``same``, or among all.

    Vectors are dealt into slices and queries into groups of bounded size, a hot value of
    ``same`` included; a task multiplies a slice with a group, block by block, and returns
    k rows a query, so no pair is a row. Equal cosines go to the smaller identifier. Null,
    empty and zero vectors, those with a null or non-finite component, and those of another
    length have no cosine and come last, with null. Null identifiers and null values of
    ``same`` take no part; a row is no neighbour of one with its own identifier; repeated rows count each.
    """
    spark = vectors.sparkSession
    doubles = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    key = F.col(same) if same else F.lit(0)
    v = vectors.where(F.col(id_col).isNotNull() & key.isNotNull())
    q = queries.where(F.col(id_col).isNotNull() & key.isNotNull())

    def parts(rows: DataFrame) -> int:
        t = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("c")).first()
        return max(1, -(-t["n"] // SLICE), -(-t["c"] // COMPONENTS))

    slices, groups = max(parts(v), spark.sparkContext.defaultParallelism), parts(q)
    deal = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = v.select(F.col(id_col).cast("long").alias("v_id"), doubles.alias("v"), key.alias("_k"), deal(slices).alias("_s"), each(groups).alias("_g"))
    q = q.select(F.col(id_col).cast("long").alias("q_id"), doubles.alias("q"), key.alias("_k"), deal(groups).alias("_g"), each(slices).alias("_s"))
    keys = ["_k", "_s", "_g"]
    j = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_nearest(k), "q_id long, v_id long, cosine double")
    w = W.partitionBy("q_id").orderBy(F.desc("cosine"), "v_id")
    kind = vectors.schema[id_col].dataType
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q_id").cast(kind).alias("q_id"), F.col("v_id").cast(kind).alias("v_id"), "cosine", "rank")

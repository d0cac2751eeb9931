"""Queries of validation, conversion, joins and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..functions.similarity import jaro_winkler_udf
from ..operators import matching as mt
from ..operators import normalize as nz
from .tables import EVENT_TX, ORDER_TX, event_tx, order_tx, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey AS tx_id, upper(CASE WHEN o_custkey % 5 = 0 THEN 'eur' WHEN o_custkey % 5 = 1 THEN 'usd' WHEN o_custkey % 5 = 2 THEN 'try' WHEN o_custkey % 5 = 3 THEN 'gbp' ELSE 'xxx' END) AS currency, round(round(o_totalprice::DECIMAL(18,2), 2) * CASE o_custkey % 5 WHEN 0 THEN 45 WHEN 1 THEN 40 WHEN 2 THEN 1 WHEN 3 THEN 52 END, 2)::DOUBLE AS amount_try, o_custkey % 5 < 4 AS supported FROM orders")
def c04_fx_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_custkey") % 5
    tx_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), F.upper(F.when(m == 0, "eur").when(m == 1, "usd").when(m == 2, "try").when(m == 3, "gbp").otherwise("xxx")).alias("currency"), F.col("o_totalprice").alias("amount"))
    return nz.convert(tx_).select("tx_id", "currency", F.col("amount_try").cast("double").alias("amount_try"), F.col("amount_try").isNotNull().alias("supported"))


@query(f"""WITH {ORDER_TX}, v AS (SELECT tx_id, concat_ws(';', CASE WHEN payee = '' THEN 'no payee' END, CASE WHEN device = '' THEN 'no device' END, CASE WHEN amount <= 0 OR amount > 4e5 THEN 'bad amount' END) AS problems FROM t)
SELECT tx_id, problems, problems = '' AS well_formed FROM v""")
def c02_integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"no payee": F.col("payee") == "", "no device": F.col("device") == "", "bad amount": (F.col("amount") <= 0) | (F.col("amount") > 4e5)}
    out = nz.problems(order_tx(spark, sf_dir), checks)
    return out.select("tx_id", F.array_join("problems", ";").alias("problems"), (F.size("problems") == 0).alias("well_formed"))


@query("SELECT c_custkey, n_name, o.orders, coalesce(o.total, 0) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE o.orders IS NOT NULL")
def d01_customer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their customer's record, which is the small side."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n_name", "orders", "total")


@query("SELECT o_orderkey, o_custkey, p.price FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1) p ON l_orderkey = o_orderkey WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def d05_recent_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return o.join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_custkey", "price")


@query("""WITH d AS (SELECT doc_id, ((doc_id * 37) % 101) / 101.0::DOUBLE AS risk FROM documents), a AS (
  SELECT doc_id, risk FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND risk BETWEEN 0.4 AND 0.6 ORDER BY doc_id DESC LIMIT 2000)
SELECT doc_id, round(risk, 6) AS risk FROM a ORDER BY round(abs(risk - 0.5), 9), doc_id LIMIT 20""")
def d08_active_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled decisions of middling risk, the newest 2000, and of those the 20 most in doubt."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 37 % 101 / F.lit(101.0)).alias("risk"))
    open_ = d.where("risk between 0.4 and 0.6").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(2000)
    return open_.orderBy(F.round(F.abs(F.col("risk") - 0.5), 9), "doc_id").limit(20).select("doc_id", F.round("risk", 6).alias("risk"))


@query("SELECT o_custkey, max(o_orderdate) AS last_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1")
def d10_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the greatest version of each key, without a join to a maximum."""
    v = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.max_by("o_orderkey", v).alias("last_order"), F.max_by("o_orderstatus", v).alias("last_status"))


#: Made up ranges for the addresses that the query makes up.
RANGES = [("10.0.0.0/8", "AA", 1, False), ("10.1.0.0/16", "BB", 2, True), ("10.1.2.0/24", "CC", 3, False), ("172.16.0.0/12", "DD", 4, True), ("192.168.4.0/22", "EE", 5, False)]
_IP_SQL = "CASE event_id % 4 WHEN 0 THEN '10.' || event_id % 3 || '.' || event_id % 5 || '.' || event_id % 250 WHEN 1 THEN '172.' || (14 + event_id % 20) || '.1.' || event_id % 200 WHEN 2 THEN '192.168.' || event_id % 12 || '.9' ELSE 'none' END"


@query(f"""WITH e AS (SELECT event_id AS tx_id, {_IP_SQL} AS ip FROM events), r(lo, hi, prefix, country, asn, vpn) AS (VALUES
  (167772160, 184549375, 8, 'AA', 1, false), (167837696, 167903231, 16, 'BB', 2, true), (167838208, 167838463, 24, 'CC', 3, false), (2886729728, 2887778303, 12, 'DD', 4, true), (3232236544, 3232237567, 22, 'EE', 5, false)),
n AS (SELECT tx_id, ip, CASE WHEN ip <> 'none' THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS v FROM e),
j AS (SELECT tx_id, ip, country, vpn, row_number() OVER (PARTITION BY tx_id ORDER BY prefix DESC NULLS LAST) AS k FROM n LEFT JOIN r ON v BETWEEN lo AND hi)
SELECT tx_id, ip, country, coalesce(vpn, false) AS vpn FROM j WHERE k = 1""")
def d12_ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.expr(_IP_SQL).alias("ip"))
    ranges = mt.cidr_ranges(spark.createDataFrame(RANGES, "cidr string, country string, asn int, vpn boolean"))
    return mt.longest_prefix(e, ranges).select("tx_id", "ip", "country", F.coalesce("vpn", F.lit(False)).alias("vpn"))


#: The same for IPv6, with addresses in several forms of writing, and IPv4 ones between them.
RANGES_6 = [("2001:db8::/32", "AA"), ("2001:DB8:0003::/48", "BB"), ("2001:db8:3:0:8000::/65", "CC"), ("2001:db8:5::/47", "DD"), ("2001:db8:2::7/128", "EE"), ("10.0.0.0/8", "FF")]
_IP6_SQL = "CASE event_id % 5 WHEN 0 THEN '2001:db8:' || (event_id % 7) || '::' || (event_id % 9) WHEN 1 THEN '2001:0DB8:000' || (event_id % 7) || ':0:8000:0:0:' || (event_id % 9) WHEN 2 THEN '2001:db9::' || (event_id % 9) WHEN 3 THEN '10.1.' || (event_id % 7) || '.1' ELSE '::1::2' END"


@query(f"""WITH e AS (SELECT event_id AS tx_id, event_id % 5 AS kind, event_id % 7 AS net, event_id % 9 AS last, {_IP6_SQL} AS ip FROM events)
SELECT tx_id, ip, CASE WHEN kind = 3 THEN 'FF' WHEN kind IN (2, 4) THEN NULL WHEN net = 3 THEN CASE kind WHEN 1 THEN 'CC' ELSE 'BB' END WHEN net IN (4, 5) THEN 'DD' WHEN kind = 0 AND net = 2 AND last = 7 THEN 'EE' ELSE 'AA' END AS country FROM e""")
def d12_ipv6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("tx_id"), F.expr(_IP6_SQL).alias("ip"))
    return mt.longest_prefix(e, mt.cidr_ranges(spark.createDataFrame(RANGES_6, "cidr string, country string"))).select("tx_id", "ip", "country")


KEYWORDS = {"error": 0.5, "queue": 0.25, "the": 0.1, "licens": 0.4, "ung": 0.2}


@query("SELECT doc_id, round(least(1, " + " + ".join(f"CASE WHEN contains(x, '{k}') THEN {w} ELSE 0 END" for k, w in KEYWORDS.items()) + ")::DOUBLE, 6) AS score, concat_ws(',', " + ", ".join(f"CASE WHEN contains(x, '{k}') THEN '{k}' END" for k in KEYWORDS) + ") AS hits FROM (SELECT doc_id, strip_accents(lower(text)) AS x FROM documents)")
def d13_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(mt.keyword_score(F.col("text"), KEYWORDS), 6).alias("score"), F.array_join(mt.keyword_hits(F.col("text"), list(KEYWORDS)), ",").alias("hits"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of parts as asked for (as they are, a letter short, or swapped and in capitals), and the list of distinct names."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    words = F.split(n, " ")
    asked = F.when(k % 3 == 0, n).when(k % 3 == 1, F.substring(n, F.lit(1), F.length(n) - 1)).otherwise(F.upper(F.array_join(F.reverse(words), " ")))
    q = p.select(k.alias("q_id"), asked.alias("name"), (k % 3).cast("int").alias("birth_year"), F.when(k % 2 == 0, "en").otherwise("tr").alias("country"))
    r = p.groupBy("p_name").agg(F.min("p_partkey").alias("rec_id")).select("rec_id", F.array("p_name").alias("names"), (F.col("rec_id") % 3).cast("int").alias("birth_year"), F.lit("en").alias("country"))
    return q, r


_ASKED = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) ELSE upper(array_to_string(list_reverse(string_split(p_name, ' ')), ' ')) END"
_NAMES_SQL = f"""aq AS (SELECT p_partkey AS q_id, lower({_ASKED}) AS name FROM part), ar AS (SELECT min(p_partkey) AS rec_id, lower(p_name) AS name FROM part GROUP BY p_name),
nq AS (SELECT q_id, list_distinct(list_filter(string_split(name, ' '), lambda t: t <> '')) AS qt FROM aq), nr AS (SELECT rec_id, list_distinct(list_filter(string_split(name, ' '), lambda t: t <> '')) AS rt FROM ar)"""


@query(f"WITH {_NAMES_SQL} SELECT q_id, rec_id FROM nq JOIN nr ON len(qt) > 0 AND list_has_all(rt, qt)")
def d15_exact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _names(spark, sf_dir)
    return mt.exact_token_matches(q, mt.name_forms(r, "rec_id"))


@query(f"""WITH {_NAMES_SQL}, q AS (SELECT q_id, unnest(qt) AS w FROM nq), r AS (SELECT rec_id, unnest(rt) AS w FROM nr), i AS (SELECT unnest(range(1, 80)) AS i),
qg AS (SELECT DISTINCT w, substr('_' || w || '_', i, 3) AS g FROM (SELECT DISTINCT w FROM q), i WHERE i <= greatest(1, length(w))), rg AS (SELECT DISTINCT rec_id, substr('_' || w || '_', i, 3) AS g FROM r, i WHERE i <= greatest(1, length(w))),
c AS (SELECT w, rec_id FROM qg JOIN rg USING (g) GROUP BY ALL HAVING count(*) >= 2) SELECT DISTINCT q_id, rec_id FROM q JOIN c USING (w)""")
def d16_ngram_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by shared 3-grams (the phonetic part has no SQL and is tested apart)."""
    q, r = _names(spark, sf_dir)
    return mt.blocking_candidates(q, mt.name_forms(r, "rec_id"), phonetic=False)


@query()
def d16_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _names(spark, sf_dir)
    return mt.blocking_candidates(q, mt.name_forms(r, "rec_id"))


@query()
def d17_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = _names(spark, sf_dir)
    return mt.screen(q, r)


@query()
def d18_both_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and beneficiaries of payments that are made from names of parts."""
    q, r = _names(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q_id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("beneficiary_name"), F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("beneficiary_id"))
    return mt.screen_payments(q.join(p, "q_id").select(F.col("q_id").alias("tx_id"), F.col("name").alias("customer_name"), "birth_year", "country", "beneficiary_name", "beneficiary_id"), r)


@query(f"WITH p AS ({ORACLES['d16_ngram_blocking']}) SELECT q_id, rec_id, round(jaro_winkler_similarity(a, b), 6) AS jw FROM p JOIN (SELECT p_partkey AS q_id, {_ASKED} AS a FROM part) USING (q_id) JOIN (SELECT min(p_partkey) AS rec_id, p_name AS b FROM part GROUP BY p_name) USING (rec_id)")
def m06_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity function on all blocked pairs; each pair of distinct names is scored once."""
    q, r = _names(spark, sf_dir)
    pairs = d16_ngram_blocking(spark, sf_dir)
    j = pairs.join(q.select("q_id", F.col("name").alias("a")), "q_id").join(r.select("rec_id", F.get("names", 0).alias("b")), "rec_id")
    scored = j.select("a", "b").distinct().withColumn("jw", F.round(jaro_winkler_udf("a", "b"), 6))
    return j.join(scored, ["a", "b"]).select("q_id", "rec_id", "jw")


@query(r"""WITH c AS (SELECT c_custkey AS q_id, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || 'x' ELSE 'Ayşe Yılmaz' END AS asked, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS registered FROM customer),
f AS (SELECT *, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(asked)), 'ı', 'i'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(registered), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM c),
s AS (SELECT *, CASE WHEN registered IS NULL THEN 0 ELSE round(greatest(jaro_winkler_similarity(a, b), CASE WHEN q_id % 3 = 2 THEN 0 ELSE 2 * length(b) / (length(a) + length(b)) END), 4) END AS similarity FROM f),
r AS (SELECT *, CASE WHEN registered IS NULL THEN 'UNKNOWN' WHEN a = b OR similarity >= 0.97 THEN 'EXACT' WHEN similarity >= 0.85 THEN 'CLOSE' ELSE 'NO_MATCH' END AS result FROM s)
SELECT q_id, result, similarity::DOUBLE AS similarity, CASE WHEN result IN ('CLOSE', 'NO_MATCH') THEN registered[1] || repeat('*', length(registered) - 1) END AS registered_name_masked FROM r""")
def d19_confirmation_of_payee(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    registry = c.select(F.concat(F.lit("TR "), F.col("c_custkey")).alias("iban"), F.col("c_name").alias("name"))
    asked = c.select(F.col("c_custkey").alias("q_id"), F.concat(F.lit("tr"), F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(F.col("c_custkey"))).alias("iban"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_name"), F.lit("x"))).otherwise(F.lit("Ayşe Yılmaz")).alias("name"))
    return mt.confirm_payee(asked, registry)


@query("""WITH e AS (SELECT event_id AS tx_id, json_extract_string(props, '$.k') AS v FROM events),
r AS (SELECT sha256('salt|iban|' || x) AS d, b FROM (VALUES ('3', 'BANK_A'), ('3', 'BANK_B'), ('7', 'BANK_B'), ('9', 'OWN'), ('11', 'BANK_C')) t(x, b))
SELECT tx_id, string_agg(DISTINCT b, ',' ORDER BY b) AS banks FROM e JOIN r ON sha256('salt|iban|' || v) = d WHERE b <> 'OWN' GROUP BY tx_id""")
def d20_consortium(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = spark.createDataFrame([("3", "BANK_A"), ("3", "BANK_B"), ("7", "BANK_B"), ("9", "OWN"), ("11", "BANK_C")], "x string, bank string").select(tx.digest("iban", F.col("x"), "salt").alias("digest"), "bank")
    return mt.consortium_hits(event_tx(spark, sf_dir), reported, "iban", "payee", "salt", "OWN")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), j AS (
  SELECT q.vec_id AS q_id, c.vec_id AS v_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS cosine
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.label = c.label AND q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, v_id) AS rank FROM j)
SELECT q_id, v_id, cosine, rank::INT AS rank FROM r WHERE rank <= 3""")
def d23_similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return mt.cosine_neighbours(v.where("vec_id % 50 = 0"), v, 3, same="label")


@query("WITH c AS (SELECT *, round(c_acctbal * 100)::BIGINT AS cents FROM customer) SELECT c_custkey, CASE WHEN count(*) OVER w > 1 THEN (sum(cents) OVER w - cents)::BIGINT / (count(*) OVER w - 1) ELSE cents::DOUBLE END AS peer_average FROM c WINDOW w AS (PARTITION BY c_nationkey)")
def d25_peer_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In whole cents, so that sums do not depend on their order."""
    c = table(spark, sf_dir, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    return mt.peer_average(c, "c_nationkey", "cents").select("c_custkey", F.col("peer_average").cast("double").alias("peer_average"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r > 1")
def d26_duplicate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r > 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def d27_without_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS normal,
  array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda p: p <> ''), lambda p: p[1] || repeat('*', greatest(1, length(p) - 1))), ' ') AS masked FROM documents""".replace("\\\\", "\\"))
def m02_name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.normalise(F.col("text")).alias("normal"), tx.mask_name(F.col("text")).alias("masked"))


@query("""WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 10000000000000000)::VARCHAR, 16, '4') AS pan, lpad((o_orderkey * 104729 % 1000000000000)::VARCHAR, 26, '0') AS bban FROM orders),
l AS (SELECT *, list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN pan[16 - i]::INT WHEN pan[16 - i]::INT > 4 THEN pan[16 - i]::INT * 2 - 9 ELSE pan[16 - i]::INT * 2 END)) % 10 = 0 AS luhn FROM d)
SELECT o_orderkey, luhn, lpad((98 - (bban || '292700')::HUGEINT % 97)::VARCHAR, 2, '0') AS check_digits, (bban || '2927' || lpad((98 - (bban || '292700')::HUGEINT % 97)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS iban FROM l""")
def m10_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 % 10**16).cast("string"), 16, "4").alias("pan"), F.lpad((F.col("o_orderkey") * 104729 % 10**12).cast("string"), 26, "0").alias("bban"))
    digits = tx.iban_check_digits(F.col("bban"))
    return o.select("o_orderkey", tx.luhn_valid(F.col("pan")).alias("luhn"), digits.alias("check_digits"), tx.iban_valid(F.concat(F.lit("TR"), digits, F.col("bban"))).alias("iban"))


def _redaction_sql() -> str:
    x = "text"
    for kind, pattern in tx.REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '[{kind}]', 'g')"
    return f"SELECT doc_id, {x} AS text FROM documents"


@query(_redaction_sql())
def m13_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS cell FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' ELSE '' END || text AS text FROM documents)")
def b15_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), F.col("text")).alias("text"))
    return d.select("doc_id", tx.csv_cell(F.col("text")).alias("cell"))


@query(f"WITH {EVENT_TX} SELECT tx_id, CASE WHEN payee = '' THEN NULL ELSE sha256('k|' || payee || '|' || amount::DECIMAL(18,2)::VARCHAR) END AS digest FROM t")
def h18_payload_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_tx(spark, sf_dir)
    return e.select("tx_id", F.sha2(F.concat_ws("|", F.lit("k"), "payee", F.col("amount").cast("decimal(18,2)").cast("string")), 256).alias("digest"))

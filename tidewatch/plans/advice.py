"""Queries of what is told of customers and payments: profile summaries, stored vectors and their context, names in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import profile as pf
from ..operators import vectors as vs
from ..storage import materialise
from .features import ORACLES as FEATURE_SQL
from .features import f22_decisions
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


@query(f"""WITH RECURSIVE {EVENT_TX}, u AS (SELECT cust, us, tx_id, amount, channel, device FROM t UNION ALL SELECT cust, max(us) + 1, 0, 0, 'error', '' FROM t GROUP BY cust),
o AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY us, tx_id) AS r, count(*) OVER (PARTITION BY cust) AS c FROM u),
f AS (
  SELECT o.cust, o.r, o.c, o.amount, o.channel, 0::DOUBLE AS n, 0::DOUBLE AS m, 0::DOUBLE AS x FROM o WHERE r = 1
  UNION ALL
  SELECT o.cust, o.r, o.c, o.amount, o.channel,
    CASE WHEN f.channel <> 'error' THEN f.n + 1 ELSE f.n END,
    CASE WHEN f.channel <> 'error' THEN f.m + greatest({pf.ALPHA}, 1 / (f.n + 1)) * (ln(1 + f.amount) - f.m) ELSE f.m END,
    CASE WHEN f.channel <> 'error' THEN greatest(f.x, f.amount) ELSE f.x END
  FROM f JOIN o ON o.cust = f.cust AND o.r = f.r + 1),
d AS (SELECT cust, count(DISTINCT CASE WHEN channel <> 'error' AND device <> '' THEN device END) AS n FROM t GROUP BY cust)
SELECT f.cust::VARCHAR AS cust, round(f.n, 1) AS observations, round(exp(f.m) - 1, 2) AS ewma_amount, round(f.x, 2) AS max_amount, least({pf.MAX_DEVICES}, d.n)::BIGINT AS devices FROM f JOIN d USING (cust) WHERE r = c""")
def q31_profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every customer after its last event; errors teach nothing."""
    none = F.lit(None).cast("double")
    return pf.profile_summaries(event_tx(spark, sf_dir).withColumns({"trusted": F.col("channel") != "error", "avg_amount": none, "typing": none}))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usual behaviour of the customers of orders; averages in whole cents, so that they do not depend on the order of sums."""
    t = order_tx(spark, sf_dir)
    mean = F.round(F.sum(F.round(F.col("amount") * 100).cast("long")).cast("decimal(38,0)") / F.count("*"), 0).cast("double") / 100
    texts = lambda c: F.array_sort(F.collect_set(c))
    return t.groupBy("cust").agg(mean.alias("average"), texts("channel").alias("devices"), texts("status").alias("locations"), texts((F.col("tx_id") % 24).cast("int")).alias("hours"))


def _bands(x: str, bands, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {limit} THEN '{name}'" for limit, name in bands) + f" ELSE '{last}' END"


_CUSTOMERS_SQL = f"""{ORDER_TX}, g AS (SELECT cust, round(sum(round(amount * 100)::BIGINT)::DECIMAL(38, 0) / count(*), 0)::DOUBLE / 100 AS average, string_agg(DISTINCT channel, ', ' ORDER BY channel) AS devices, string_agg(DISTINCT status, ', ' ORDER BY status) AS locations,
  string_agg(DISTINCT {_bands("tx_id % 24", dc.HOUR_BANDS, "akşam")}, ', ' ORDER BY {_bands("tx_id % 24", dc.HOUR_BANDS, "akşam")}) AS hours FROM t GROUP BY cust),
b AS (SELECT cust::VARCHAR AS id, cust, 'Müşteri genellikle ' || {_bands("average", dc.AMOUNT_BANDS, "çok büyük")} || ' tutarlı (ortalama ' || printf('%.2f', average) || ' TRY) işlem yapar. Cihazlar: ' || devices || '. Lokasyonlar: ' || locations || '. Saat bandı: ' || hours || '.' AS document FROM g)"""


def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the customers of orders: at first those with odd numbers, then all, of which the first stay as they are."""
    entries = materialise(vs.profile_entries(customers(spark, sf_dir)), "entries")
    later = entries.withColumn("document", F.concat("document", F.lit(" Yeni.")))
    return vs.upserted(materialise(vs.upserted(None, entries.where("cast(cust as long) % 2 = 1"), replace=False), "vectors"), later, replace=False)


def _length() -> Column:
    return F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6)


@query(f"WITH {_CUSTOMERS_SQL} SELECT id, 'profile' AS kind, document || CASE WHEN cust % 2 = 1 THEN '' ELSE ' Yeni.' END AS document, 1.0::DOUBLE AS length FROM b")
def q09_behaviour_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after two seedings; ids that it held before are passed over."""
    return profile_store(spark, sf_dir).select("id", "kind", "document", _length().alias("length"))


@query("""WITH c AS (SELECT 'case:' || o_orderkey AS id, o_custkey::VARCHAR AS cust, o_orderkey % 3 AS k, 'Case of ' || o_orderpriority || ' for ' || o_custkey AS document FROM orders WHERE o_orderstatus = 'F')
SELECT id, 'fraud_case' AS kind, cust, document || CASE WHEN k = 0 THEN ' closed again' ELSE '' END AS document, 1.0::DOUBLE AS length FROM c""")
def q10_case_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed cases of finished orders; a third of them comes once more and replaces its first form."""
    said = F.concat(F.lit("Case of "), "o_orderpriority", F.lit(" for "), F.col("o_custkey").cast("string"))
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("cust"), said.alias("document"))
    first = materialise(vs.upserted(None, vs.case_entries(c), replace=True), "cases")
    again = c.where("case_id % 3 = 0").withColumn("document", F.concat("document", F.lit(" closed again")))
    return vs.upserted(first, vs.case_entries(again), replace=True).select("id", "kind", "cust", "document", _length().alias("length"))


def _said(t: DataFrame) -> DataFrame:
    return t.select("tx_id", "cust", dc.transaction_document(F.col("amount"), F.col("device"), F.lit(None), F.col("channel"), F.col("tx_id") % 24).alias("document"))


@query()
def d24_behaviour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a payment beside its own customer's usual behaviour, with their distance."""
    store = materialise(profile_store(spark, sf_dir), "profiles")
    return vs.behaviour_context(store, _said(order_tx(spark, sf_dir))).select("tx_id", "context", "distance")


@query(f"""WITH {EVENT_TX}, {_CUSTOMERS_SQL.replace("t AS (", "ot AS (", 1).replace("FROM t GROUP", "FROM ot GROUP")}, d AS ({FEATURE_SQL["f22_decisions"]})
SELECT d.tx_id, d.decision, b.document || CASE WHEN b.cust % 2 = 1 THEN '' ELSE ' Yeni.' END AS context FROM d JOIN t USING (tx_id) LEFT JOIN b ON b.cust = t.cust""")
def q34_advice_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored decision with the usual behaviour of its customer, if there is one."""
    store = materialise(profile_store(spark, sf_dir), "profiles")
    decisions = f22_decisions(spark, sf_dir).select("tx_id", "decision")
    return vs.explained(decisions, store, _said(event_tx(spark, sf_dir))).select("tx_id", "decision", "context")


@query("SELECT doc_id, true AS came_back, false AS name_left FROM documents WHERE text IS NOT NULL")
def m14_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's first two words taken for its customer's name, which stands in capitals before it: no form of it is left, and the text comes back."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.regexp_extract("text", "^\\p{L}{3,} +\\p{L}{3,}(?![\\p{L}\\p{N}_])", 0).alias("name"))
    d = d.withColumn("text", F.concat(F.upper("name"), F.lit(" "), "text"))
    out = dc.pseudonymised(d.withColumn("names", F.array("name")), names="names")
    left = F.coalesce((F.col("name") != "") & F.regexp_like("redacted", F.concat(F.lit("(?iU)(?<!\\w)"), "name", F.lit("(?!\\w)"))), F.lit(False))
    return out.select("doc_id", (dc.restored(F.col("redacted"), F.col("tokens")) == F.col("text")).alias("came_back"), left.alias("name_left"))

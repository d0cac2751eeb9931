"""Queries of texts: reversible redaction, descriptions, embeddings, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import matching as mt
from ..storage import materialise
from .tables import ORDER_TX, order_tx, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of all documents, dealt to all cores: a file is read by as few tasks as it has row groups, and the patterns are the work."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return d.repartition(parts, F.xxhash64("doc_id", "text"))


@query("SELECT doc_id, true AS came_back, md5(text) AS digest FROM documents")
def m16_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction there and back, over whole texts (m13 to m17): every text comes back as it was."""
    d = dc.pseudonymised(texts(spark, sf_dir))
    back = dc.restored(F.col("redacted"), F.col("tokens"))
    return d.select("doc_id", F.equal_null(back, F.col("text")).alias("came_back"), F.md5(back).alias("digest"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b')))::INT AS mails FROM documents".replace("\\\\", "\\"))
def m13_mail_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different mail addresses were replaced in each text."""
    d = dc.pseudonymised(texts(spark, sf_dir))
    return d.select("doc_id", F.size(F.filter("tokens", lambda t: t["kind"] == "EPOSTA")).alias("mails"))


@query()
def m14_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons found in each text, as numbers of tokens by kind."""
    d = dc.pseudonymised(texts(spark, sf_dir))
    return d.select("doc_id", F.size(F.filter("tokens", lambda t: t["kind"] == "KISI")).alias("persons"), F.size("tokens").alias("tokens"))


_BAND = "CASE WHEN amount < 500 THEN 'çok küçük' WHEN amount < 2500 THEN 'küçük' WHEN amount < 10000 THEN 'orta' WHEN amount < 50000 THEN 'büyük' ELSE 'çok büyük' END"
_HOUR = "CASE WHEN h < 6 THEN 'gece' WHEN h < 12 THEN 'sabah' WHEN h < 18 THEN 'öğleden sonra' ELSE 'akşam' END"


@query(f"WITH {ORDER_TX}, x AS (SELECT *, tx_id % 24 AS h FROM t) SELECT tx_id, 'Müşteri ' || {_BAND} || ' tutarlı (' || round(amount::DECIMAL(18,2))::BIGINT || ' TRY) işlem yapar. Cihaz: ' || device || '. Lokasyon: . Kanal: ' || channel || '. Saat bandı: ' || {_HOUR} || '.' AS document FROM x")
def m19_transaction_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments as sentences (bands: m18)."""
    t = order_tx(spark, sf_dir)
    return t.select("tx_id", dc.transaction_document(F.col("amount"), F.col("device"), F.lit(None), F.col("channel"), F.col("tx_id") % 24).alias("document"))


@query()
def m20_hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of whole texts; the length of each is 1, or 0 without words."""
    e = dc.hash_embedding(table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text"), "key", "text")
    return e.select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 9).alias("length"), F.size(F.filter("embedding", lambda x: x != 0)).alias("slots"))


@query()
def d24_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth benchmark text and document the three likest documents, by hashed words."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    e = materialise(dc.with_embedding(d, "text").select("doc_id", "embedding"), "document-vectors")
    return mt.cosine_neighbours(e.where("doc_id % 50 = 0"), e, 3, id_col="doc_id")


@query("WITH c AS (SELECT o_orderkey, 'see CASE-' || (o_orderkey % 7) || ' and TX-' || (o_orderkey % 5) || ', CASE-' || (o_orderkey % 7) AS t FROM orders) SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 >= 3 THEN 'CASE-' || (o_orderkey % 7) END, CASE WHEN o_orderkey % 5 <> 1 THEN 'TX-' || (o_orderkey % 5) END) AS unknown FROM c")
def m25_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.concat(F.lit("see CASE-"), (k % 7).cast("string"), F.lit(" and TX-"), (k % 5).cast("string"), F.lit(", CASE-"), (k % 7).cast("string"))
    allowed = F.array(*map(F.lit, ("CASE-0", "CASE-1", "CASE-2", "TX-1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(dc.unknown_citations(said, allowed), ",").alias("unknown"))

"""A table of documents about customers and confirmed cases with their embeddings, kept by increments and asked for context.

Its columns are id, kind (``profile`` or ``fraud_case``), cust, document, embedding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents as dc


def profile_entries(customers: DataFrame) -> DataFrame:
    """id, kind, cust, document of customers (cust, average, devices, locations, hours). Null and empty ids give no entry."""
    c = F.col("cust").cast("string")
    text = dc.behaviour_document(F.col("average"), F.col("devices"), F.col("locations"), F.col("hours"))
    return customers.where(c != "").select(c.alias("id"), F.lit("profile").alias("kind"), c.alias("cust"), text.alias("document"))


def case_entries(cases: DataFrame) -> DataFrame:
    """id, kind, cust, document of confirmed cases (case_id, cust, document). Null ids give no entry."""
    return cases.where("case_id is not null").select(F.concat(F.lit("case:"), F.col("case_id").cast("string")).alias("id"), F.lit("fraud_case").alias("kind"), F.col("cust").cast("string").alias("cust"), "document")


def upserted(store: DataFrame | None, entries: DataFrame, *, replace: bool) -> DataFrame:
    """The store with the entries: those that it lacks or, with ``replace``, all of them, in place of their old rows.

    Only what goes in is embedded. Of entries with one id the one whose document
    sorts first goes in (null last); a null document has a zero vector.
    """
    fresh = entries.groupBy("id").agg(F.min_by(F.struct("kind", "cust", "document"), F.struct(F.col("document").isNull(), "document")).alias("e")).select("id", "e.*")
    if store is not None and not replace:
        fresh = fresh.join(store.select("id"), "id", "left_anti")
    embedded = dc.with_embedding(fresh, "document")
    if store is None:
        return embedded.select("id", "kind", "cust", "document", "embedding")
    kept = store.join(fresh.select("id"), "id", "left_anti") if replace else store
    return kept.unionByName(embedded)


def behaviour_context(store: DataFrame, payments: DataFrame) -> DataFrame:
    """Each payment (tx_id, cust, document) with its own customer's profile: context, and distance (1 - cosine, to 6 digits).

    Nulls where the customer has no profile. The join is by customer, so no payment meets
    another's profile, and payments are embedded where they meet it; without words there is no
    cosine, and the distance is 1.
    """
    own = store.where("kind = 'profile'").select(F.col("cust").alias("_cust"), F.col("document").alias("context"), F.col("embedding").alias("_p"))
    j = payments.join(own, payments["cust"].cast("string") == own["_cust"], "left").drop("_cust")
    dot = F.aggregate(F.zip_with("_p", "_e", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return dc.with_embedding(j, "document", "_e").select(*payments.columns, "context", F.round(1 - dot, 6).alias("distance"))


def explained(decisions: DataFrame, store: DataFrame, payments: DataFrame) -> DataFrame:
    """What an advisor is shown of stored decisions (tx_id, decision, risk_score, reasons): these, and the customer's usual behaviour.

    Decisions without a stored payment give no row.
    """
    return decisions.join(behaviour_context(store, payments).select("tx_id", "cust", "context", "distance"), "tx_id")

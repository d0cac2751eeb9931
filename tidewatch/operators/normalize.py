"""Payments made uniform: defaults, checks, currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units of the base currency for one of each.
RATES = {"TRY": "1", "EUR": "45", "USD": "40", "GBP": "52", "CHF": "47", "AED": "10.9"}


def convert(tx: DataFrame, rates: dict[str, str] = RATES) -> DataFrame:
    """Adds amount_try: the amount to cents, times the rate, to cents, both half up; null for an unknown currency."""
    rate = F.element_at(F.create_map(*(x for k, v in rates.items() for x in (F.lit(k), F.lit(v).cast("decimal(12,6)")))), F.upper("currency"))
    return tx.withColumn("amount_try", F.round(F.col("amount").cast("decimal(18,2)") * rate, 2).cast("decimal(18,2)"))


def problems(tx: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds the texts of the checks that a row fails; a check that gives null is passed."""
    return tx.withColumn("problems", F.filter(F.array(*(F.when(c, F.lit(t)) for t, c in checks.items())), lambda x: x.isNotNull()))


# What a request must keep to.
MAX_AMOUNT, MAX_ID, MAX_PURPOSE = 1e8, 64, 160


def cleaned_text(x: Column) -> Column:
    """A text without control characters and outer blanks."""
    return F.trim(F.regexp_replace(x, "\\p{Cntrl}", ""))


def request_checks() -> dict[str, Column]:
    """Checks of a payment request by the field that fails; missing fields fail, but for an empty country and purpose."""
    def sized(c: str, low: int, high: int) -> Column:
        return F.coalesce(F.length(cleaned_text(F.col(c))).between(low, high), F.lit(low == 0))

    amount = F.col("amount")
    return {
        "transaction_id": ~sized("transaction_id", 1, MAX_ID),
        "customer_id": ~sized("customer_id", 1, MAX_ID),
        "amount": ~F.coalesce((amount > 0) & (amount <= MAX_AMOUNT), F.lit(False)),
        "currency": ~F.coalesce(F.upper("currency").rlike("^[A-Z]{2,3}$"), F.lit(False)),
        "country": ~F.coalesce(F.upper("country").rlike("^([A-Z]{2})?$"), F.lit(True)),
        "purpose": ~sized("purpose", 0, MAX_PURPOSE),
    }


def split_valid(tx: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows to set aside with their problems."""
    all_rows = problems(tx, checks)
    return all_rows.where(F.size("problems") == 0).drop("problems"), all_rows.where(F.size("problems") > 0)


def normalise(raw: DataFrame) -> DataFrame:
    """Defaults and upper case; the payee is the IBAN, else the id, else ''; control characters go from texts."""
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\p{Cntrl}", "")
    payee = F.coalesce(F.nullif(text("beneficiary_iban"), F.lit("")), F.nullif(text("beneficiary_id"), F.lit("")), F.lit(""))
    return raw.select(
        F.col("transaction_id").alias("tx_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("customer_id").alias("cust"),
        "amount",
        F.upper(F.coalesce("currency", F.lit("TRY"))).alias("currency"),
        payee.alias("payee"),
        text("device_id").alias("device"),
        text("location").alias("location"),
        text("channel").alias("channel"),
        F.upper(text("country")).alias("country"),
        text("purpose").alias("purpose"),
        text("ip_address").alias("ip"),
        "session",
    )


def strip_labels(tx: DataFrame) -> DataFrame:
    return tx.drop("label", "typology", "exclude_from_training", "label_noise")


def mask_values(payload: Column) -> Column:
    """A map of strings with its values hidden."""
    return F.transform_values(payload, lambda k, v: F.when(v.isNotNull(), F.lit("•••")))

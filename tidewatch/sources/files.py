"""Readers of the engine's inputs, all with fixed schemas, and their shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import fold
from ..operators.rules import Rule


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "t": T.TimestampNTZType(), "as": T.ArrayType(T.StringType()), "ai": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


SESSION = _struct("device_fingerprint:s is_emulator:b is_rooted:b remote_access_tool:b active_call:b paste_used:b is_vpn_or_tor:b ip_asn:l typing_cadence_ms:d session_duration_s:d login_to_transfer_s:d")
TRANSACTION = T.StructType([*_struct("transaction_id:s ts:t customer_id:s amount:d currency:s device_id:s location:s beneficiary_id:s beneficiary_iban:s beneficiary_name:s ip_address:s channel:s country:s purpose:s").fields, T.StructField("session", SESSION), *_struct("label:i typology:s exclude_from_training:b label_noise:b").fields])
CUSTOMER = _struct("customer_id:s name:s home_city:s home_country:s known_device_ids:as known_locations:as typical_hours:ai known_channels:as avg_amount:d currency:s birth_year:i vulnerable:b iban:s segment:s typing_ms:d")
SANCTION = _struct("id:s name:s aliases:as country:s program:s pep:b birth_date:s birth_year:i nationality:s")
PAYSIM = _struct("step:i type:s amount:d nameOrig:s oldbalanceOrg:d newbalanceOrig:d nameDest:s oldbalanceDest:d newbalanceDest:d isFraud:i isFlaggedFraud:i")


def json_array(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    """A JSON array of objects, or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    return spark.read.schema(schema).json(path)


def back_test_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, y int, f map<string,double>").json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType = PAYSIM, where: Column | None = None) -> DataFrame:
    """A CSV file with a header; ``where`` is pushed to the reader, which drops other lines while it parses."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows if where is None else rows.where(where)


def ulb(spark: SparkSession, path: str) -> DataFrame:
    """The public card set: V1 to V28, Amount, y, and ``row``, the line's place, which stands for the time.

    The class is quoted in some copies. One file is one split here, so the place of a line is its order.
    """
    schema = _struct(" ".join(["Time:d", *(f"V{i}:d" for i in range(1, 29)), "Amount:d", "Class:s"]))
    rows = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("y", F.regexp_replace("Class", "[^0-9]", "").cast("int")).drop("Class")


def _whole(spark: SparkSession, path: str) -> str:
    """A small file's text, by a path that Spark can read."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def rule_file(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a YAML file (a few dozen, kept on the driver), checked for their form only."""
    import yaml

    rows = yaml.safe_load(_whole(spark, path)).get("rules") or []
    return [Rule(r["id"], str(r["when"]), float(r["score"]), r.get("reason_template") or "", r.get("action_hint"), r.get("severity") or "medium", tuple(r.get("tags") or ())) for r in rows]


def keyword_file(spark: SparkSession, path: str) -> dict[str, float]:
    """Keywords of a YAML file with their weights; keys are folded, and of two that fold to one the heavier counts."""
    import yaml

    given = yaml.safe_load(_whole(spark, path)).get("keywords") or {}
    folded: dict[str, float] = {}
    rows = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()], "k string, w double")
    for r in rows.select(fold(F.col("k")).alias("k"), "w").collect():
        folded[r["k"]] = max(folded.get(r["k"], 0.0), r["w"])
    return folded


IP_RANGES = "ranges array<struct<cidr:string,country:string,asn:int,org:string,vpn:boolean,tor:boolean>>"


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """cidr, country, vpn, tor of a JSON file."""
    return spark.read.schema(IP_RANGES).option("multiLine", True).json(path).select(F.explode("ranges").alias("r")).select("r.cidr", "r.country", F.coalesce("r.vpn", F.lit(False)).alias("vpn"), F.coalesce("r.tor", F.lit(False)).alias("tor"))


def sanctions(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, names (name and aliases), birth_year, country of a JSON list, ready to be screened against."""
    r = json_array(spark, path, SANCTION)
    year = F.coalesce("birth_year", F.substring("birth_date", 1, 4).cast("int"))
    return r.select(F.col("id").alias("rec_id"), F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n.isNotNull()).alias("names"), year.alias("birth_year"), F.coalesce("nationality", "country").alias("country"))


def drifted(tx: DataFrame, drift: float, order: str = "us") -> DataFrame:
    """Amounts that grow by ``drift`` from the first payment to the last, in order, as a simulated stream sends them."""
    from ..storage import running_sums

    placed = running_sums(tx, [F.col(order), F.col("tx_id")], {"_nth": F.lit(1)})
    total = tx.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("_n"))
    return placed.crossJoin(F.broadcast(total)).withColumn("amount", F.col("amount") * (1 + F.lit(drift) * (F.col("_nth") - 1) / F.col("_n"))).drop("_nth", "_n")


def traffic(spark: SparkSession, rate: int, anomaly_rate: float = 0.05, customers: int = 100) -> DataFrame:
    """An endless stream of made-up payments, of which a share is unusual: tx_id, ts, cust, amount, odd."""
    s = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(salt), "value"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    odd = u(1) < anomaly_rate
    return s.select(F.col("value").alias("tx_id"), F.col("timestamp").alias("ts"), F.floor(u(2) * customers).alias("cust"), F.round(F.when(odd, 20_000 + 80_000 * u(3)).otherwise(50 + 950 * u(3)), 2).alias("amount"), odd.alias("odd"))


def sampled(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Whole keys by hash: all rows of a key or none (a sampling operator)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(2.0**53)
    return rows.where(u < share)


def spread_within_step(rows: DataFrame, step: str, order: str) -> DataFrame:
    """Adds offset_s: the rows of a step, in order, evenly over an hour."""
    w = W.partitionBy(step)
    return rows.withColumn("offset_s", F.round(3600 * (F.row_number().over(w.orderBy(order)) - 1) / F.count("*").over(w), 3))


# Channel and purpose of each type of the public set.
PAYSIM_TYPES = {"CASH_IN": ("atm", "cash in"), "CASH_OUT": ("atm", "cash out"), "DEBIT": ("card", "debit"), "PAYMENT": ("web", "payment"), "TRANSFER": ("mobile", "transfer")}


def paysim(rows: DataFrame, start_us: int = 1_704_067_200_000_000) -> DataFrame:
    """The public set as payments: an hourly step with an even spread in it becomes the time."""
    r = rows.withColumn("_i", F.monotonically_increasing_id())
    r = spread_within_step(r, "step", "_i")
    kind = lambda i: F.element_at(F.create_map(*(x for k, v in PAYSIM_TYPES.items() for x in (F.lit(k), F.lit(v[i])))), F.col("type"))
    return r.select(F.col("_i").alias("tx_id"), (F.lit(start_us) + (F.col("step") - 1).cast("long") * 3_600_000_000 + (F.col("offset_s") * 1_000_000).cast("long")).alias("us"), F.col("nameOrig").alias("cust"), "amount", F.col("nameDest").alias("payee"), kind(0).alias("channel"), kind(1).alias("purpose"), F.lit("").alias("device"), F.col("isFraud").alias("label"))


def elliptic(spark: SparkSession, classes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with a label (1 illicit, 0 licit, -1 unknown) and edges of the public graph."""
    c = spark.read.schema("txId long, class string").csv(classes, header=True)
    e = spark.read.schema("txId1 long, txId2 long").csv(edges, header=True)
    return c.select(F.col("txId").alias("node"), F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0).otherwise(-1).alias("label")), e.select(F.col("txId1").alias("src"), F.col("txId2").alias("dst"))


def rebase(tx: DataFrame, end_us: int) -> DataFrame:
    """All times moved so that the last one is ``end_us``."""
    last = tx.agg(F.max("us").alias("_last"))
    return tx.crossJoin(F.broadcast(last)).withColumn("us", F.col("us") + (F.lit(end_us) - F.col("_last"))).drop("_last")


def json_object(text: Column, schema: str) -> Column:
    """The first {...} in a text that parses, fenced ones first."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    plain = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    return F.coalesce(F.from_json(F.nullif(fenced, F.lit("")), schema), F.from_json(F.nullif(plain, F.lit("")), schema))


def jurisdictions(lists: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
    """Country codes of the named lists (name, countries) and of further ones."""
    spark = lists.sparkSession
    own = lists.where(F.col("name").isin(*names)).select(F.explode("countries").alias("code"))
    return own.union(spark.createDataFrame([(x,) for x in extra], "code string")).select(F.upper("code").alias("code")).distinct()

"""Given tables read as raw accounts and transactions.

A customer is an account, its nation the bank, and 40 entities own all accounts. A line item is a
transaction from the customer of its order to the customer whose key is the line's supplier key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitgraph.operators.build import build_graph
from remitgraph.plans.staging import stage
from remitgraph.plans.tables import GraphTables

# Fixed values of the mapping.
ENTITIES, NAMES = 40, 39


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entity_id(key: str):
    return F.concat(F.lit("E"), F.col(key) % ENTITIES)


def entity_name(key: str):
    return F.concat(F.lit("Corporation #"), F.col(key) % ENTITIES % NAMES)


def customers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey")


def raw_accounts(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select(
        F.col("n_name").alias("Bank Name"),
        F.col("c_nationkey").alias("Bank ID"),
        F.col("c_custkey").cast("string").alias("Account Number"),
        entity_id("c_custkey").alias("Entity ID"),
        entity_name("c_custkey").alias("Entity Name"),
    )


def known_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Raw accounts without every 25th customer."""
    return raw_accounts(spark, d).filter(F.col("Account Number").cast("bigint") % 25 != 0)


def dirty_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers in one account file: shared numbers, blank and missing names."""
    nation = table(spark, d, "nation")
    banked = lambda df, key: df.join(nation.withColumnRenamed("n_nationkey", key), key)
    customer = banked(table(spark, d, "customer"), "c_nationkey")
    supplier = banked(table(spark, d, "supplier"), "s_nationkey")
    key = F.col("c_custkey")
    return customer.select(
        F.when(key % 25 != 0, F.col("n_name")).alias("Bank Name"),
        F.col("c_nationkey").alias("Bank ID"),
        key.cast("string").alias("Account Number"),
        F.concat(F.lit("C"), key).alias("Entity ID"),
        F.when((F.col("c_mktsegment") == "MACHINERY") & (key % 10 == 0), "")
        .otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("Entity Name"),
    ).unionByName(supplier.select(
        F.col("n_name").alias("Bank Name"),
        F.col("s_nationkey").alias("Bank ID"),
        F.col("s_suppkey").cast("string").alias("Account Number"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("Entity ID"),
        F.col("s_name").alias("Entity Name"),
    ))


def time_text(name: str):
    return F.translate(F.substring(F.col(name).cast("string"), 1, 16), "-", "/")


def raw_transactions(spark: SparkSession, d: str, dirty: bool = False) -> DataFrame:
    """One raw transaction per line item.

    ``dirty``: some times do not parse, some receivers are missing. Senders are joined with the orders and
    receivers, evaluated first, with the line items as they are read: these are shuffled once, by their order.
    """
    customer, lines = table(spark, d, "customer"), table(spark, d, "lineitem")

    def side(prefix: str) -> DataFrame:
        return customer.select(
            F.col("c_custkey").alias(f"{prefix}_key"), F.col("c_nationkey").alias(f"{prefix}_bank"))

    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("from_key"),
        "o_orderstatus", "o_orderpriority").join(side("from"), "from_key")
    keys = lines.select(F.col("l_suppkey").alias("to_key")).distinct()
    receivers = stage(side("to").join(keys, "to_key", "left_semi"), "receivers")
    rows = lines.withColumn("to_key", F.col("l_suppkey")).join(receivers, "to_key").join(orders, "l_orderkey")
    time, receiver = time_text("l_shipdate"), F.col("to_key").cast("string")
    if dirty:
        bad_time = (F.col("l_tax") == 0.08) & (F.col("l_quantity") == 50)
        lost = (F.col("l_linenumber") == 7) & (F.col("l_quantity") == 1)
        time, receiver = F.when(bad_time, "not-a-time").otherwise(time), F.when(~lost, receiver)
    return rows.select(
        time.alias("Timestamp"),
        F.col("from_bank").alias("From Bank"), F.col("from_key").cast("string").alias("Account2"),
        F.col("to_bank").alias("To Bank"), receiver.alias("Account4"),
        F.col("l_quantity").alias("Amount Received"), F.col("l_linestatus").alias("Receiving Currency"),
        F.col("l_extendedprice").alias("Amount Paid"), F.col("o_orderstatus").alias("Payment Currency"),
        F.col("o_orderpriority").alias("Payment Format"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("Is Laundering"),
    )


# Questions need the account table several times; what reads all transactions several times needs both.
FOR_QUESTIONS = ("accounts",)
FOR_WRITING = ("base", "accounts")


def graph(spark: SparkSession, d: str, staged: tuple[str, ...] = FOR_QUESTIONS) -> GraphTables:
    return build_graph(
        raw_accounts(spark, d), raw_transactions(spark, d), money="decimal", staged=staged)


def dirty_graph(spark: SparkSession, d: str, staged: tuple[str, ...] = FOR_QUESTIONS) -> GraphTables:
    """Dirty transactions against an account table that lacks every 25th customer."""
    built = build_graph(
        known_accounts(spark, d), raw_transactions(spark, d, dirty=True), money="decimal", staged=staged)
    known = built.accounts.filter(F.col("entity_id").isNotNull())
    return built.with_(accounts=known)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests made from the entity names in the customer table.

    Every ordered pair of names, every name, four values of ``top_n``, one unsupported request,
    one with a name missing. The number of names, and so of pairs, is fixed by the mapping.
    """
    names = table(spark, d, "customer").select(entity_name("c_custkey").alias("name")).distinct()
    number = F.substring_index("name", "#", -1).cast("bigint")
    a = names.select(number.alias("a"), F.col("name").alias("source_entity_name"))
    pairs = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(NAMES - 1)))).select(
        (F.col("a") * 100 + F.col("b")).alias("request_id"),
        F.lit("ENTITY_RELATIONSHIP").alias("intent"), "source_entity_name",
        F.concat(F.lit("Corporation #"), "b").alias("target_entity_name"))
    singles = names.select(
        (number + 10_000).alias("request_id"), F.lit("ENTITY_LAUNDERING_TRANSACTIONS").alias("intent"),
        F.col("name").alias("entity_name"))
    rest = spark.createDataFrame([
        (20_000, "TOP_LAUNDERING_SENDERS", None, None),
        (20_001, "TOP_LAUNDERING_SENDERS", None, 0),
        (20_002, "TOP_LAUNDERING_SENDERS", None, 5),
        (20_003, "TOP_LAUNDERING_SENDERS", None, 99),
        (20_004, "UNSUPPORTED", None, None),
        (20_005, "ENTITY_RELATIONSHIP", "Corporation #1", None),
    ], "request_id bigint, intent string, source_entity_name string, top_n int")
    empty = spark.createDataFrame([], "request_id bigint, intent string, source_entity_name string, "
                                      "target_entity_name string, entity_name string, top_n int")
    for part in (pairs, singles, rest):
        empty = empty.unionByName(part, allowMissingColumns=True)
    return empty

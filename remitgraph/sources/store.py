"""The stored form of a graph: Parquet, laid out for the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from remitgraph.operators import build
from remitgraph.operators.retrieve import account_banks, account_bucket, known_ends, owners
from remitgraph.plans.staging import COMPRESSION, packed, stage, unpacked
from remitgraph.plans.tables import GraphTables

OF_ACCOUNTS = ("accounts", "banks", "entities", "owns", "held_at")

EDGES = ("sent", "received_by")
LOOKUPS = ("account_owners", "account_banks")
BUCKETS = 64
PARTITIONS = ("is_laundering", "sender_bucket")
NOT_ASKED = ("sender_bucket", "amount_received", "receiving_currency", "label")  # no question reads these from the copy


def write_graph(
    graph: GraphTables, path: str, buckets: int = BUCKETS, derive_edges: bool = False
) -> GraphTables:
    """Write a graph to a fresh folder and return it as read back.

    Transactions are partitioned by label (the labelled ones are few and are all that most
    questions read) and by a hash of the sending account, so a question about named senders
    reads only their buckets. Each bucket is written by several tasks if one account fills it. The labelled
    ones are stored once more by a hash of the receiving account, for questions that start there.
    Owner and bank of every account are stored as lookups, sorted by name and by account, so
    that Parquet statistics skip most of a file.

    With ``derive_edges`` the SENT and RECEIVED_BY edges are those of the transactions just written: they
    are read from these and take no room of their own.

    Identical transactions have one id and are stored once; a graph built with ``occurrence`` gives
    copies ids of their own and so keeps them.
    """
    spark = graph.accounts.sparkSession

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", COMPRESSION).parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    graph = graph.with_(**{name: keep(name, getattr(graph, name)) for name in OF_ACCOUNTS},
                        account_owners=None, account_banks=None)
    graph = graph.with_(
        account_owners=keep("account_owners", owners(graph).orderBy("entity_name", "account_key")),
        account_banks=keep("account_banks", account_banks(graph).orderBy("account_key")))

    def write_transactions(rows: DataFrame) -> DataFrame:
        writer = laid_out(graph.with_(transactions=rows), buckets).write.mode("overwrite").option("compression", COMPRESSION)
        writer.partitionBy(*PARTITIONS).parquet(f"{path}/transactions")
        return _transactions(spark, path)

    # Nodes are merged by key and edges by their ends, as when a graph is loaded.
    written = write_transactions(graph.transactions)
    if not repeated_ids(written).isEmpty():  # ids that do not tell transactions apart: any row of each
        written = write_transactions(graph.transactions.dropDuplicates(["transaction_id"]))
    received = packed(written.filter("is_laundering").drop(*NOT_ASKED).withColumn(
        "receiver_bucket", account_bucket("to_account_key", buckets)), "transaction_id")
    # rebalance: AQE cuts a partition that one hot account fills, and joins small ones.
    received = unpacked(received.hint("rebalance", F.col("receiver_bucket")), "transaction_id").sortWithinPartitions(
        "receiver_bucket", "to_account_key")
    received.write.option("compression", COMPRESSION).partitionBy("receiver_bucket").parquet(f"{path}/labelled_received")
    if not derive_edges:
        for name in EDGES:
            keep(name, getattr(graph, name).distinct())
    keep("layout", spark.range(1).select(F.lit(buckets).alias("sender_buckets"), F.lit(derive_edges).alias("derived_edges")))
    return read_graph(spark, path)


def laid_out(graph: GraphTables, buckets: int) -> DataFrame:
    """Transactions as they are stored, copies once, by a single shuffle.

    Ranges of label, bucket and id are cut from a sample, so that one hot account fills several of them. All
    copies of a transaction meet in one range, where one of them is kept.
    """
    rows = known_ends(graph).withColumn("sender_bucket", account_bucket("from_account_key", buckets))
    place = [*PARTITIONS, "transaction_id"]
    once = packed(rows, "transaction_id").repartitionByRange(*place).dropDuplicates(place)
    return unpacked(once, "transaction_id").sortWithinPartitions(*PARTITIONS, "from_account_key")


def repeated_ids(transactions: DataFrame) -> DataFrame:
    """Ids of more than one row. Counted by their hashes first, which are all that is shuffled of the others."""
    hashed = transactions.select("transaction_id", F.xxhash64("transaction_id").alias("hash"))
    found = stage(hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "hashes")
    return hashed.join(found, "hash", "left_semi").groupBy("transaction_id").agg(F.count("*").alias("n")).filter("n > 1")


def _transactions(spark: SparkSession, path: str) -> DataFrame:
    # A partition column is read from folder names, where a boolean looks like text.
    found = spark.read.parquet(f"{path}/transactions").schema
    stated = StructType([
        StructField(f.name, BooleanType()) if f.name == "is_laundering" else f for f in found
    ])
    return spark.read.schema(stated).parquet(f"{path}/transactions")


def received_schema(transactions: DataFrame) -> StructType:
    """That of the copy by receiver; stated, since there may be no labelled transfer at all."""
    return StructType([f for f in transactions.schema if f.name not in NOT_ASKED]).add("receiver_bucket", IntegerType())


def read_graph(spark: SparkSession, path: str) -> GraphTables:
    layout = spark.read.parquet(f"{path}/layout").first().asDict()
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in OF_ACCOUNTS}
    tables["transactions"] = _transactions(spark, path)
    if layout.get("derived_edges"):
        tables |= {"sent": build.sent(tables["transactions"]), "received_by": build.received_by(tables["transactions"])}
    else:
        tables |= {name: spark.read.parquet(f"{path}/{name}") for name in EDGES}
    tables |= {name: spark.read.parquet(f"{path}/{name}") for name in LOOKUPS}
    tables["labelled_received"] = spark.read.schema(received_schema(tables["transactions"])).parquet(f"{path}/labelled_received")
    return GraphTables(**tables, sender_buckets=layout["sender_buckets"])

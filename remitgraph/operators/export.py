"""Export of the graph tables as files, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitgraph.functions import columns as c
from remitgraph.operators.validate import union_all
from remitgraph.plans.tables import GraphTables
from remitgraph.sources.files import read_text_table, write_table

# table -> (exported columns, sort columns)
EXPORT_LAYOUT = {
    "accounts": (["account_key", "account_number"], ["account_key"]),
    "banks": (["bank_id", "name"], ["bank_id"]),
    "entities": (["id", "name"], ["id"]),
    "transactions": (
        ["transaction_id", "timestamp", "amount_received", "receiving_currency", "amount_paid",
         "payment_currency", "payment_format", "is_laundering"],
        ["transaction_id"],
    ),
    "owns": (["entity_id", "account_key"], ["entity_id", "account_key"]),
    "held_at": (["account_key", "bank_id"], ["account_key"]),
    "sent": (["account_key", "transaction_id"], ["transaction_id"]),
    "received_by": (["transaction_id", "account_key"], ["transaction_id"]),
}


def _exported(table: str, name: str) -> Column:
    if (table, name) == ("transactions", "timestamp"):
        return c.iso_time(name).alias(name)
    return F.col(name)


def export_frames(graph: GraphTables, order: str | None = "global") -> dict[str, DataFrame]:
    """The eight tables as they are written.

    ``order="global"`` sorts whole tables (a range shuffle; a spread column breaks ties, so copies
    of one id can go to several tasks); ``"files"`` sorts within each output file without a
    shuffle; ``None`` leaves the order open.
    """
    frames = {}
    for table, (names, keys) in EXPORT_LAYOUT.items():
        df = getattr(graph, table).select(*[_exported(table, n) for n in names])
        if order == "global":
            spread = df.withColumn("_spread", F.monotonically_increasing_id())
            df = spread.orderBy(*keys, "_spread").drop("_spread")
        elif order == "files":
            df = df.sortWithinPartitions(*keys)
        frames[table] = df
    return frames


def write_export(
    graph: GraphTables, out: str, version: str, fmt: str = "csv",
    order: str | None = "files", compression: str | None = None,
) -> str:
    """Write the bundle below ``out/version``, one directory per table; returns that folder.

    ``compression`` is that of the files (``"gzip"``: ``part-*.csv.gz``), which are read back alike. Ids in plain
    text take most of a bundle, and half of their room is saved.
    """
    folder = f"{out.rstrip('/')}/{version}"
    for table, df in export_frames(graph, order).items():
        write_table(df, f"{folder}/{table}", fmt, compression)
    return folder


def read_export(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The eight exported tables; CSV comes back as text."""
    if fmt != "csv":
        return {t: spark.read.format(fmt).load(f"{folder}/{t}") for t in EXPORT_LAYOUT}
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    frames = {}
    for table in EXPORT_LAYOUT:
        single = f"{folder}/{table}.csv"
        path = single if fs.exists(hadoop.Path(single)) else f"{folder}/{table}"
        frames[table] = read_text_table(spark, path)
    return frames


def export_validation(written: dict[str, DataFrame], expected: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows expected from the source, rows found in the files, whether they agree."""

    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        return union_all([
            df.agg(F.lit(t).alias("table_name"), F.count("*").alias(name),
                   F.lit(",".join(df.columns)).alias(f"{name}_columns"))
            for t, df in tables.items()
        ])

    both = counts(expected, "expected_rows").join(counts(written, "actual_rows"), "table_name", "left")
    return both.select(
        "table_name", "expected_rows", "actual_rows",
        F.coalesce(F.col("expected_rows") == F.col("actual_rows"), F.lit(False)).alias("count_matches"),
        F.col("actual_rows_columns").alias("columns"),
    )

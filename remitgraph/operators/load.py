"""Typed upsert of exported rows into stored tables.

Nodes go first, then edges. A repeated key overwrites earlier values in row order, including with
null; an edge is kept once, and only if both its nodes exist. Nothing is changed in place: the
result is a new set of tables, to be written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitgraph.functions import columns as c
from remitgraph.operators.validate import union_all
from remitgraph.plans.staging import COMPRESSION, computed_once, packed, unpacked
from remitgraph.plans.tables import EDGE_ENDS, NODE_KEYS, GraphTables

SEQ = "load_seq"
ID = NODE_KEYS["transactions"][1]  # the one long key; it is packed for every shuffle

# table -> {column: conversion}; the first column is the key.
NODE_TYPES = {
    "accounts": {"account_key": c.text, "account_number": c.text},
    "banks": {"bank_id": lambda x: c.text(x).try_cast("bigint"), "name": c.text},
    "entities": {"id": c.text, "name": c.text},
    "transactions": {
        "transaction_id": c.text,
        "timestamp": c.local_time,
        "amount_received": c.double,
        "receiving_currency": c.text,
        "amount_paid": c.double,
        "payment_currency": c.text,
        "payment_format": c.text,
        "is_laundering": c.text_flag,
    },
}

_END_TYPES = {"bank_id": NODE_TYPES["banks"]["bank_id"]}


def file_sequence(batch: int) -> Column:
    """Order of rows read from text files: batch, file, block in the file, position in the block."""
    return F.struct(
        F.lit(batch).alias("batch"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )


def with_sequence(read: DataFrame, batch: int) -> DataFrame:
    """Number rows of a file scan so that a later row wins over an earlier one."""
    return read.withColumn(SEQ, file_sequence(batch))


def typed_nodes(table: str, rows: DataFrame) -> DataFrame:
    """Incoming text rows with a usable key, converted to the stored types."""
    types = NODE_TYPES[table]
    kept = [SEQ] if SEQ in rows.columns else []
    typed = rows.select(*[convert(name).alias(name) for name, convert in types.items()], *kept)
    key = next(iter(types))
    typed = computed_once(typed, *[n for n in (key,) if n == ID])
    return typed.filter(c.present(key) if key != "bank_id" else F.col(key).isNotNull())


def typed_edges(table: str, rows: DataFrame) -> DataFrame:
    _, ends = EDGE_ENDS[table]
    typed = rows.select(*[_END_TYPES.get(end, c.text)(end).alias(end) for end, _ in ends])
    return computed_once(typed, *[n for n in typed.columns if n == ID]).dropna()


def upsert_nodes(existing: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """One row per key: the incoming row with the largest ``load_seq``, else the stored one.

    An aggregate, so copies of a key are reduced to one per task before the shuffle.
    """
    columns = [n for n in incoming.columns if n != SEQ]
    ids = [ID] if key == ID else []
    row = F.struct(F.lit(0).alias("_"), *[n for n in columns if n != key])
    latest = incoming.select(key, F.lit(1).alias("age"), F.col(SEQ).alias("seq"), row.alias("row"))
    if existing is not None:
        none = F.lit(None).cast(latest.schema["seq"].dataType)
        stored = existing.select(key, F.lit(0).alias("age"), none.alias("seq"), row.alias("row"))
        latest = stored.unionByName(latest)
    merged = packed(latest, *ids).groupBy(key).agg(F.max_by("row", F.struct("age", "seq")).alias("row"))
    return unpacked(merged, *ids).select(*[F.col(key) if n == key else F.col(f"row.{n}").alias(n) for n in columns])


def merge_edges(
    existing: DataFrame | None, incoming: DataFrame, left_nodes: DataFrame, right_nodes: DataFrame
) -> DataFrame:
    """Stored edges plus incoming ones whose two nodes exist, each pair once.

    The node tables are single-column frames named after the edge ends. Only incoming edges are
    checked; stored ones were checked when they came in.
    """
    left, right = incoming.columns
    ids = [n for n in (left, right) if n == ID]
    checked = packed(incoming, *ids)
    # Transactions last: edges are then where copies of them are dropped.
    for nodes in sorted((left_nodes, right_nodes), key=lambda nodes: nodes.columns[0] == ID):
        end = nodes.columns[0]
        checked = checked.join(packed(nodes, *[n for n in ids if n == end]), end, "left_semi")
    edges = checked if existing is None else packed(existing, *ids).unionByName(checked)
    return unpacked(edges.select(left, right).distinct(), *ids)


def node_keys(graph_tables: dict[str, DataFrame], end: str, table: str) -> DataFrame:
    _, key = NODE_KEYS[table]
    return graph_tables[table].select(F.col(key).alias(end))


def load_graph(
    incoming: dict[str, DataFrame], path: str, existing: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Load the eight exported tables on top of stored ones (or of nothing) into a new version.

    Node frames carry ``load_seq``. Nodes are written first; edges are then checked against what
    was written. Returns the tables as read back from ``path``. Transactions have their stored
    properties only, see ``as_graph`` for the form the retrieval functions take.
    """
    existing = existing or {}
    loaded: dict[str, DataFrame] = {}

    def keep(table: str, df: DataFrame) -> None:
        df.write.option("compression", COMPRESSION).parquet(f"{path}/{table}")
        loaded[table] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{table}")

    for table, types in NODE_TYPES.items():
        rows = typed_nodes(table, incoming[table])
        keep(table, upsert_nodes(existing.get(table), rows, next(iter(types))))
    for table, (_, ends) in EDGE_ENDS.items():
        sides = [node_keys(loaded, end, nodes) for end, nodes in ends]
        keep(table, merge_edges(existing.get(table), typed_edges(table, incoming[table]), *sides))
    return loaded


def as_graph(loaded: dict[str, DataFrame]) -> GraphTables:
    """Put the account keys back on the transactions, from the SENT and RECEIVED_BY edges.

    Both joins are on the transaction id. A transaction with several senders or receivers gives
    one row for each combination; one with a side missing keeps a null there.
    """
    sender = loaded["sent"].withColumnRenamed("account_key", "from_account_key")
    receiver = loaded["received_by"].withColumnRenamed("account_key", "to_account_key")
    transactions = packed(loaded["transactions"], ID)
    for side in (sender, receiver):
        transactions = transactions.join(packed(side, ID), ID, "left")
    return GraphTables(**{**loaded, "transactions": unpacked(transactions, ID)})


def load_report(incoming: dict[str, DataFrame]) -> DataFrame:
    """Per node table: rows offered, rows with a blank key, rows whose key is not convertible."""
    frames = []
    for table, types in NODE_TYPES.items():
        key, convert = next(iter(types.items()))
        blank = c.missing(key)
        frames.append(incoming[table].agg(
            F.lit(table).alias("table_name"),
            F.count("*").alias("offered_rows"),
            F.count_if(blank).alias("blank_keys"),
            F.count_if(~blank & convert(key).isNull()).alias("unusable_keys"),
        ))
    return union_all(frames)


def graph_counts(graph: GraphTables) -> DataFrame:
    """Rows per node label and per edge type, ordered."""
    nodes = [
        getattr(graph, t).agg(F.count("*").alias("rows")).select(
            F.lit("node").alias("kind"), F.lit(label).alias("name"), "rows")
        for t, (label, _) in NODE_KEYS.items()
    ]
    edges = [
        getattr(graph, t).agg(F.count("*").alias("rows")).select(
            F.lit("relationship").alias("kind"), F.lit(kind).alias("name"), "rows")
        for t, (kind, _) in EDGE_ENDS.items()
    ]
    return union_all(nodes + edges).orderBy("kind", "name")

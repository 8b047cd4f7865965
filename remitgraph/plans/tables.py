"""The data model: four node tables, four edge tables, and their schemas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Labels written on nodes and names of the edge types.
ACCOUNT, BANK, ENTITY, TRANSACTION = "Account", "Bank", "Entity", "Transaction"
OWNS, HELD_AT, SENT, RECEIVED_BY = "OWNS", "HELD_AT", "SENT", "RECEIVED_BY"

# Headings of the two raw files. The transaction file has two columns called ``Account``.
RAW_ACCOUNT_HEADINGS = ["Bank Name", "Bank ID", "Account Number", "Entity ID", "Entity Name"]
RAW_TRANSACTION_HEADINGS = [
    "Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received",
    "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering",
]

SCHEMAS = {
    "accounts": "account_key string, account_number string, bank_id bigint, bank_name string, "
                "entity_id string, entity_name string, label string",
    "banks": "bank_id bigint, name string, label string",
    "entities": "id string, name string, label string",
    "transactions": "transaction_id string, timestamp timestamp_ntz, from_account_key string, "
                    "to_account_key string, amount_received double, receiving_currency string, "
                    "amount_paid double, payment_currency string, payment_format string, "
                    "is_laundering boolean, label string",
    "owns": "entity_id string, account_key string",
    "held_at": "account_key string, bank_id bigint",
    "sent": "account_key string, transaction_id string",
    "received_by": "transaction_id string, account_key string",
}

REQUEST_SCHEMA = (
    "request_id bigint, intent string, source_entity_name string, target_entity_name string, "
    "entity_name string, top_n int"
)

# name -> (label, key column)
NODE_KEYS = {
    "accounts": (ACCOUNT, "account_key"),
    "banks": (BANK, "bank_id"),
    "entities": (ENTITY, "id"),
    "transactions": (TRANSACTION, "transaction_id"),
}

# name -> (type, ((edge column, node table), (edge column, node table)))
EDGE_ENDS = {
    "owns": (OWNS, (("entity_id", "entities"), ("account_key", "accounts"))),
    "held_at": (HELD_AT, (("account_key", "accounts"), ("bank_id", "banks"))),
    "sent": (SENT, (("account_key", "accounts"), ("transaction_id", "transactions"))),
    "received_by": (RECEIVED_BY, (("transaction_id", "transactions"), ("account_key", "accounts"))),
}


TABLES = list(SCHEMAS)


@dataclass(frozen=True)
class GraphTables:
    """Eight lazy DataFrames that together form one graph.

    A stored graph also has the two lookups that paths are completed with, written once, flags on
    its transactions that say which of them have both ends, the number of buckets of the sending account
    that they are divided into, and a copy of the labelled ones in as many buckets of the receiving account.
    """

    accounts: DataFrame
    banks: DataFrame
    entities: DataFrame
    transactions: DataFrame
    owns: DataFrame
    held_at: DataFrame
    sent: DataFrame
    received_by: DataFrame
    account_owners: DataFrame | None = None
    account_banks: DataFrame | None = None
    labelled_received: DataFrame | None = None
    sender_buckets: int | None = None

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, getattr(self, name)) for name in TABLES)

    @property
    def stored(self) -> bool:
        """Whether the transactions say what is known of their ends, as ``write_graph`` stores them."""
        return "between_owners" in self.transactions.columns

    def with_(self, **tables: DataFrame) -> GraphTables:
        return replace(self, **tables)

    def register(self, prefix: str = "") -> None:
        """Make every table available to ``spark.sql`` as a temporary view."""
        for name, df in self.items():
            df.createOrReplaceTempView(prefix + name)


def empty_graph(spark: SparkSession) -> GraphTables:
    return GraphTables(**{name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()})

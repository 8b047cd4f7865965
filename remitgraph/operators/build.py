"""Raw accounts and transactions to the eight graph tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitgraph.functions import columns as c
from remitgraph.plans.staging import stage
from remitgraph.plans.tables import ACCOUNT, BANK, ENTITY, TRANSACTION, GraphTables

# target column -> (heading in the raw file, conversion)
Spec = dict[str, tuple[str, Callable[[str], Column]]]

ACCOUNT_SPEC: Spec = {
    "account_number": ("Account Number", c.text),
    "bank_id": ("Bank ID", c.long),
    "bank_name": ("Bank Name", c.text),
    "entity_id": ("Entity ID", c.text),
    "entity_name": ("Entity Name", c.text),
}

TRANSACTION_SPEC: Spec = {
    "timestamp_raw": ("Timestamp", c.text),
    "from_bank_id": ("From Bank", c.long),
    "from_account_number": ("from_account", c.text),
    "to_bank_id": ("To Bank", c.long),
    "to_account_number": ("to_account", c.text),
    "amount_received": ("Amount Received", c.double),
    "receiving_currency": ("Receiving Currency", c.text),
    "amount_paid": ("Amount Paid", c.double),
    "payment_currency": ("Payment Currency", c.text),
    "payment_format": ("Payment Format", c.text),
    "is_laundering_raw": ("Is Laundering", lambda h: F.col(h).try_cast("int")),
}

# Order of the parts of a transaction id. It is fixed: ids depend on it.
ID_PARTS = list(TRANSACTION_SPEC)
AMOUNTS = ("amount_received", "amount_paid")

# Identical rows beyond this many are written out by several tasks.
COPIES_PER_TASK = 1_000_000


def conform(raw: DataFrame, spec: Spec) -> DataFrame:
    """Select, rename and convert raw columns as the spec says."""
    return raw.select(*[convert(f"`{h}`").alias(name) for name, (h, convert) in spec.items()])


def name_account_sides(raw: DataFrame) -> DataFrame:
    """Name the two ``Account`` columns by side.

    The file has two columns with the same heading; the CSV reader tells them apart by adding
    their position. The first in order of appearance is the sender.
    """
    if {"from_account", "to_account"} <= set(raw.columns):
        return raw
    found = [name for name in raw.columns if re.fullmatch(r"Account\d*", name)]
    if len(found) != 2:
        raise ValueError(f"expected two account columns, found {found}")
    return raw.withColumnsRenamed(dict(zip(found, ("from_account", "to_account"))))


def clean_accounts(raw: DataFrame) -> DataFrame:
    return conform(raw, ACCOUNT_SPEC).filter(c.present("account_number"))


def transaction_accounts(raw: DataFrame) -> DataFrame:
    """Distinct complete (bank, account) pairs on either side of any transaction."""
    return account_pairs(transaction_base(raw))


def account_pairs(base: DataFrame) -> DataFrame:
    def pair(side: str) -> Column:
        return F.struct(
            F.col(f"{side}_bank_id").alias("bank_id"),
            F.col(f"{side}_account_number").alias("account_number"),
        )

    pairs = base.select(F.inline(F.array(pair("from"), pair("to"))))
    return pairs.filter(F.col("bank_id").isNotNull() & c.present("account_number")).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, nulls last.

    An aggregate rather than a window: copies of a key are reduced before the shuffle.
    """
    parts = [x for name in order for x in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))]
    best = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{name}").alias(name) for name in order])


def account_metadata(accounts: DataFrame) -> DataFrame:
    """One metadata row per (bank, account); of several the first by entity, then names."""
    best = first_by(
        accounts, ["bank_id", "account_number"], ["entity_id", "entity_name", "bank_name"]
    )
    return best.select("bank_id", "account_number", "bank_name", "entity_id", "entity_name")


def account_nodes(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Accounts that take part in a transaction, with their metadata where known."""
    joined = pairs.join(metadata, ["bank_id", "account_number"], "left")
    return joined.select(
        c.account_key("bank_id", "account_number").alias("account_key"),
        "account_number", "bank_id", "bank_name", "entity_id", "entity_name",
        F.lit(ACCOUNT).alias("label"),
    )


def _named_nodes(accounts: DataFrame, key: str, name: str, as_key: str, label: str) -> DataFrame:
    # The distinct step reduces each task to its few different names by hashing; the minimum of a
    # string alone would sort every row first. Null only if no row has a name.
    pairs = accounts.select(F.col(key).alias(as_key), F.col(name).alias("name")).distinct()
    return pairs.groupBy(as_key).agg(F.min("name").alias("name")).withColumn("label", F.lit(label))


def bank_nodes(accounts: DataFrame) -> DataFrame:
    return _named_nodes(accounts, "bank_id", "bank_name", "bank_id", BANK)


def entity_nodes(accounts: DataFrame) -> DataFrame:
    return _named_nodes(accounts, "entity_id", "entity_name", "id", ENTITY)


def transaction_base(raw: DataFrame) -> DataFrame:
    """Typed transaction columns plus both account keys."""
    return with_keys(conform(name_account_sides(raw), TRANSACTION_SPEC))


def with_keys(typed: DataFrame) -> DataFrame:
    """Typed transaction columns plus what follows from them."""
    return typed.withColumns({
        "timestamp": c.raw_time("timestamp_raw"),
        "from_account_key": c.account_key("from_bank_id", "from_account_number"),
        "to_account_key": c.account_key("to_bank_id", "to_account_number"),
        "is_laundering": F.col("is_laundering_raw") == 1,
    })


def transaction_id(money: str = "double") -> Column:
    """Id of a transaction row: a hash of its eleven cleaned fields.

    ``money="double"`` hashes amounts in the text form of a double; ``"decimal"`` in two-decimal
    text, which other engines write the same way.
    """
    as_text = {"double": F.col, "decimal": c.money_text}[money]
    return c.row_id(*[as_text(p) if p in AMOUNTS else p for p in ID_PARTS])


def transaction_nodes(
    base: DataFrame, money: str = "double", occurrence: bool = False
) -> DataFrame:
    """Transaction nodes. Identical rows share an id unless ``occurrence`` numbers them."""
    nodes = base.select(
        transaction_id(money).alias("transaction_id"),
        "timestamp", "from_account_key", "to_account_key",
        "amount_received", "receiving_currency", "amount_paid", "payment_currency",
        "payment_format", "is_laundering",
        F.lit(TRANSACTION).alias("label"),
    )
    if not occurrence:
        return nodes
    if money != "double":
        raise ValueError("numbering copies needs ids over the full amounts (money='double')")
    return number_copies(nodes, "transaction_id")


def number_copies(nodes: DataFrame, key: str, per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Append ``-2``, ``-3``, ... to the key of the second, third, ... identical row.

    Copies are counted (reduced before the shuffle) and written out again from the count, so no
    task ever sorts or holds a group of copies; large groups are cut into ranges first and the
    ranges spread over all tasks.
    """
    counted = nodes.groupBy(*nodes.columns).agg(F.count("*").alias("copies"))
    few = counted.filter(F.col("copies") <= per_task).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))
    )
    ranges = counted.filter(F.col("copies") > per_task).withColumn(
        "start", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies", F.lit(per_task).cast("bigint")))
    )
    end = F.least(F.col("copies"), F.col("start") + per_task - 1)
    many = ranges.repartition(key, "start").withColumn("copy", F.explode(F.sequence("start", end)))
    numbered = F.when(F.col("copy") == 1, F.col(key)).otherwise(
        F.concat_ws("-", key, F.col("copy").cast("string"))
    )
    kept = [numbered.alias(key) if name == key else F.col(name) for name in nodes.columns]
    return few.select(*kept).unionByName(many.select(*kept))


def owns(accounts: DataFrame) -> DataFrame:
    return accounts.select("entity_id", "account_key").distinct()


def held_at(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_key", "bank_id").distinct()


def sent(transactions: DataFrame) -> DataFrame:
    return transactions.select(F.col("from_account_key").alias("account_key"), "transaction_id")


def received_by(transactions: DataFrame) -> DataFrame:
    return transactions.select("transaction_id", F.col("to_account_key").alias("account_key"))


def build_graph(
    raw_accounts: DataFrame,
    raw_transactions: DataFrame,
    money: str = "double",
    occurrence: bool = False,
    staged: tuple[str, ...] = (),
) -> GraphTables:
    """All eight tables, lazily.

    Tables named in ``staged`` (of ``base``, ``accounts``, ``transactions``) are written once to
    the shared folder and the rest reads them: ``base`` and ``accounts`` when every table will be written
    or many questions are asked, ``accounts`` for a single one. What follows from a column, as
    keys and ids do, is not staged with ``base``: ids are most of the room that ``transactions`` take.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        return stage(df, name) if name in staged else df

    base = with_keys(keep("base", conform(name_account_sides(raw_transactions), TRANSACTION_SPEC)))
    metadata = account_metadata(clean_accounts(raw_accounts))
    nodes = keep("accounts", account_nodes(account_pairs(base), metadata))
    transactions = keep("transactions", transaction_nodes(base, money, occurrence))
    return GraphTables(
        accounts=nodes,
        banks=bank_nodes(nodes),
        entities=entity_nodes(nodes),
        transactions=transactions,
        owns=owns(nodes),
        held_at=held_at(nodes),
        sent=sent(transactions),
        received_by=received_by(transactions),
    )

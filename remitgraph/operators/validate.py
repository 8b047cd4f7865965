"""Data-quality checks. Each returns a DataFrame; only the gates run jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from remitgraph.functions import columns as c
from remitgraph.plans.staging import packed, stage
from remitgraph.plans.tables import EDGE_ENDS, NODE_KEYS, GraphTables


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _distinct(*cols: str) -> Column:
    return F.count_distinct(*[F.col(x) for x in cols])


def account_summary(accounts: DataFrame) -> DataFrame:
    return accounts.agg(
        F.count("*").alias("total_rows"),
        _distinct("account_number").alias("distinct_account_numbers"),
        _distinct("bank_id", "account_number").alias("distinct_bank_account_pairs"),
        _distinct("entity_id").alias("distinct_entities"),
        _distinct("bank_id").alias("distinct_banks"),
    )


def account_node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("account_node_rows"),
        _distinct("account_key").alias("distinct_account_keys"),
        _distinct("bank_id", "account_number").alias("distinct_bank_account_pairs"),
        _distinct("account_number").alias("distinct_account_numbers"),
        _distinct("entity_id").alias("connected_entities"),
        _distinct("bank_id").alias("connected_banks"),
    )


def distinct_members(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows ``(key, member_of, member, row_count)``: the different values of each column per key.

    Grouped by key *and* value, so the work of one key is spread over its values and repeated
    values are reduced before the shuffle. A null value is kept as a member.
    """
    sides = [F.struct(F.lit(v).alias("member_of"), F.col(v).cast("string").alias("member"))
             for v in values]
    long_form = df.select(key, F.inline(F.array(*sides)))
    return long_form.groupBy(key, "member_of", "member").agg(F.count("*").alias("row_count"))


def group_values(df: DataFrame, key: str, counts: dict[str, str], having: Column | None = None) -> DataFrame:
    """Rows ``(key, row_count, a count of each column's different values, member_of, member, member_rows)``.

    ``counts`` names the count of each column; ``having`` is a condition on them. Every different value
    of a key is a row of its own, so no key is ever gathered; null is not a value.
    """
    members = distinct_members(df, key, list(counts))
    first = next(iter(counts))
    of = {v: (F.col("member_of") == v) & F.col("member").isNotNull() for v in counts}
    groups = members.groupBy(F.col(key).alias("_key")).agg(
        F.sum(F.when(F.col("member_of") == first, F.col("row_count"))).alias("row_count"),
        *[F.count_if(of[v]).alias(count) for v, count in counts.items()])
    groups = groups if having is None else groups.filter(having)
    values = members.filter("member is not null").withColumnRenamed("row_count", "member_rows")
    return (groups.join(values, F.col("_key").eqNullSafe(F.col(key)))
            .select(key, "row_count", *counts.values(), "member_of", "member", "member_rows"))


def _several(counts: dict[str, str]) -> Column:
    return c.any_of([F.col(count) > 1 for count in counts.values()])


def identity_conflicts(accounts: DataFrame) -> DataFrame:
    """Account numbers used at several banks or by several entities, with a row for each of those."""
    counts = {"bank_id": "number_of_banks", "entity_id": "number_of_entities"}
    return group_values(accounts, "account_number", counts, _several(counts))


def name_conflicts(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """Ids that come with more than one name, with a row for each name."""
    counts = {name: "number_of_names"}
    found = group_values(nodes, key, counts, _several(counts))
    return found.select(key, "number_of_names", F.col("member").alias(name), "member_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows without a value, per column (null, or empty text)."""
    return df.agg(*[
        F.count_if(c.missing(F.col(x).cast("string"), trim=False)).alias(f"missing_{x}")
        for x in columns
    ])


def incomplete_metadata(nodes: DataFrame) -> DataFrame:
    parts = ["bank_name", "entity_id", "entity_name"]
    return nodes.filter(c.any_of([F.col(p).isNull() for p in parts]))


def require_empty(df: DataFrame, message: str) -> None:
    """Gate: raise with the message when the DataFrame has a row."""
    if not df.isEmpty():
        raise ValueError(message)


def require_consistent_names(nodes: DataFrame) -> None:
    """Gate before bank and entity nodes are used: one name per bank id and per entity id."""
    for key, name, what in (("bank_id", "bank_name", "a bank id"), ("entity_id", "entity_name", "an entity id")):
        names = nodes.groupBy(key).agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
        require_empty(names.filter("lo <> hi"), f"{what} has several names")


def measured(df: DataFrame, rules: dict[str, Column], name: str = "gated") -> tuple[DataFrame, dict[str, int]]:
    """The staged table, and how many of its rows break each rule: counted while it is written, in no pass of its own.

    A rule is a condition that holds for a bad row. A task that runs again may count its rows again, so a
    count is exact where it is 0, and at least the number of bad rows where it is not.
    """
    seen = Observation()
    counts = [F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(rules.values())]
    kept = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), name)
    return kept, {rule: seen.get[f"c{i}"] for i, rule in enumerate(rules)}


def gated(df: DataFrame, rules: dict[str, Column], name: str = "gated") -> DataFrame:
    """The staged table, if no row of it breaks a rule; else an error that says how many break which."""
    kept, broken = measured(df, rules, name)
    if any(broken.values()):
        raise ValueError("; ".join(f"{n} rows: {rule}" for rule, n in broken.items() if n))
    return kept


def names_per_key(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key with its first name and whether it has others (``several``): what banks and entities are made of."""
    pairs = nodes.select(key, name).distinct()  # hashed in every task, before anything is sorted
    return pairs.groupBy(key).agg(F.min(name).alias("name"), F.coalesce(F.min(name) < F.max(name), F.lit(False)).alias("several"))


def transaction_summary(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count("*").alias("transaction_node_rows"),
        _distinct("transaction_id").alias("distinct_transaction_ids"),
        F.count_if(F.col("timestamp").isNull()).alias("invalid_timestamps"),
        F.count_if(F.col("from_account_key") == F.col("to_account_key")).alias("self_transfers"),
        F.count_if(F.col("is_laundering")).alias("laundering_transactions"),
    )


def unknown_accounts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account keys used by a transaction but absent from the accounts; a null key is unknown."""
    used = transactions.select(
        F.explode(F.array("from_account_key", "to_account_key")).alias("account_key")
    ).distinct()
    return used.join(accounts.select("account_key"), "account_key", "left_anti")


def node_summary(nodes: DataFrame, key: str, name: str = "name") -> DataFrame:
    return nodes.agg(
        F.count("*").alias("node_rows"),
        _distinct(key).alias("distinct_ids"),
        F.count_if(c.missing(name)).alias("missing_names"),
    )


def expected_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        _distinct("bank_id").alias("expected_banks"),
        _distinct("entity_id").alias("expected_entities"),
    )


def relationship_summary(graph: GraphTables) -> DataFrame:
    """Per edge type: rows and different pairs, a pair with a null end counted like any other."""
    frames = []
    for table, (kind, ends) in EDGE_ENDS.items():
        pairs = getattr(graph, table).groupBy(*[end for end, _ in ends]).agg(F.count("*").alias("n"))
        frames.append(pairs.agg(
            F.lit(kind).alias("relationship_type"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count("*").alias("distinct_relationships"),
        ))
    return union_all(frames)


def missing_endpoints(graph: GraphTables) -> DataFrame:
    """Per edge type and side: edges whose node does not exist (a null end is missing).

    Edges are counted per end before the anti join, so an account with a third of all
    transactions is one row by the time it is shuffled. Nodes are never broadcast: what Spark takes for the
    size of a staged table is that of its compressed files, without the ids that follow from its rows.
    """
    frames = []
    for table, (kind, ends) in EDGE_ENDS.items():
        for end, node_table in ends:
            _, key = NODE_KEYS[node_table]
            ids = [end] if node_table == "transactions" else []
            nodes = packed(getattr(graph, node_table).select(F.col(key).alias(end)), *ids)
            per_end = packed(getattr(graph, table).select(end), *ids).groupBy(end).agg(F.count("*").alias("n"))
            lost = per_end.join(nodes.hint("merge"), end, "left_anti")
            frames.append(lost.agg(
                F.lit(kind).alias("relationship_type"),
                F.lit(node_table).alias("missing_node"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("missing_rows"),
            ))
    return union_all(frames)


def check_constraints(graph: GraphTables) -> DataFrame:
    """Keys that occur on several nodes of one label; absent keys are allowed."""
    frames = []
    for table, (label, key) in NODE_KEYS.items():
        keys = getattr(graph, table).select(F.col(key).cast("string").alias("key"))
        repeated = duplicate_keys(keys.filter(F.col("key").isNotNull()), ["key"])
        frames.append(repeated.select(F.lit(label).alias("label"), "key", "copies"))
    return union_all(frames)


def reconcile_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare two manifests ``(file_name, file_size)`` by name, then by size."""
    left = expected.select(F.col("file_name"), F.col("file_size").alias("expected_size"))
    right = actual.select(F.col("file_name"), F.col("file_size").alias("actual_size"))
    left, right = left.withColumn("in_expected", F.lit(True)), right.withColumn("in_actual", F.lit(True))
    both = left.join(right, "file_name", "full_outer")
    status = (
        F.when(F.col("in_actual").isNull(), "MISSING")
        .when(F.col("in_expected").isNull(), "UNEXPECTED")
        .when(F.col("expected_size").eqNullSafe(F.col("actual_size")), "MATCH")
        .otherwise("SIZE_DIFFERS")
    )
    return both.select("file_name", "expected_size", "actual_size", status.alias("status"))


def require_same_files(expected: DataFrame, actual: DataFrame) -> None:
    """Gate: raise unless both manifests hold the same names with the same sizes."""
    differing = reconcile_manifest(expected, actual).filter(F.col("status") != "MATCH")
    require_empty(differing, "the copied files differ from the exported files")

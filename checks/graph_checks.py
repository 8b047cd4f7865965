"""Cleaning, graph construction and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapping as m
from checks.registry import check
from checks.sql import ACC, DIRTY, DIRTY_ACC, DIRTY_RAW, GRAPH, KNOWN, PAIRS, RAW, TX, nodes, with_
from remitgraph.operators import build, export, validate
from remitgraph.plans.tables import GraphTables


def dirty_clean(spark, d):
    return build.clean_accounts(m.dirty_accounts(spark, d))


def base(spark, d, dirty=False):
    return build.transaction_base(m.raw_transactions(spark, d, dirty))


def transactions(spark, d, dirty=False):
    return build.transaction_nodes(base(spark, d, dirty), money="decimal")


# --- construction ---------------------------------------------------------------------------

check("n1_clean_accounts", with_(DIRTY_ACC) + """
SELECT account_number, bank_id, bank_name, entity_id, entity_name FROM dacc""")(dirty_clean)

check("n2_transaction_accounts", with_(DIRTY_RAW, PAIRS) + "SELECT * FROM pairs")(
    lambda s, d: build.transaction_accounts(m.raw_transactions(s, d, dirty=True)))

METADATA = with_(DIRTY_ACC) + """
SELECT bank_id, account_number, bank_name, entity_id, entity_name FROM (
  SELECT *, row_number() OVER (PARTITION BY bank_id, account_number
    ORDER BY entity_id NULLS LAST, entity_name NULLS LAST, bank_name NULLS LAST) AS rn FROM dacc)
WHERE rn = 1"""
check("n3_account_metadata", METADATA)(lambda s, d: build.account_metadata(dirty_clean(s, d)))


@check("n4_account_nodes", with_(ACC, KNOWN, RAW, PAIRS, nodes("known")) + """
SELECT *, 'Account' AS label FROM node""")
def n4(spark, d):
    known = build.clean_accounts(m.known_accounts(spark, d))
    pairs = build.transaction_accounts(m.raw_transactions(spark, d))
    return build.account_nodes(pairs, build.account_metadata(known))


check("n5_bank_nodes", with_(DIRTY_ACC) + """
SELECT bank_id, min(bank_name) AS name, 'Bank' AS label FROM dacc GROUP BY bank_id""")(
    lambda s, d: build.bank_nodes(dirty_clean(s, d)))

check("n6_entity_nodes", with_(ACC) + """
SELECT entity_id AS id, min(entity_name) AS name, 'Entity' AS label FROM acc GROUP BY entity_id""")(
    lambda s, d: build.entity_nodes(build.clean_accounts(m.raw_accounts(s, d))))

check("n7_transaction_base", with_(DIRTY_RAW) + """
SELECT time_text AS timestamp_raw, from_bank AS from_bank_id, from_number AS from_account_number,
       to_bank AS to_bank_id, to_number AS to_account_number, amount_received, receiving_currency,
       amount_paid, payment_currency, payment_format, code AS is_laundering_raw,
       try_strptime(time_text, '%Y/%m/%d %H:%M') AS "timestamp",
       from_bank || '|' || from_number AS from_account_key,
       to_bank || '|' || to_number AS to_account_key, code = 1 AS is_laundering
FROM raw""")(lambda s, d: base(s, d, dirty=True))

check("n8_transaction_nodes", with_(DIRTY_RAW, TX) + "SELECT *, 'Transaction' AS label FROM tx")(
    lambda s, d: transactions(s, d, dirty=True))

check("n8_numbered_copies", """
WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN copy = 1 THEN l_orderkey || '/' || l_linenumber
            ELSE l_orderkey || '/' || l_linenumber || '-' || copy END AS id
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM c)""")(
    lambda s, d: build.number_copies(m.table(s, d, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id")), "id"))

check("e1_owns", GRAPH + "SELECT DISTINCT entity_id, account_key FROM node")(
    lambda s, d: m.graph(s, d).owns)
check("e2_held_at", GRAPH + "SELECT DISTINCT account_key, bank_id FROM node")(
    lambda s, d: m.graph(s, d).held_at)
check("e3_sent", DIRTY + "SELECT from_account_key AS account_key, transaction_id FROM tx")(
    lambda s, d: build.sent(transactions(s, d, dirty=True)))
check("e4_received_by", DIRTY + "SELECT transaction_id, to_account_key AS account_key FROM tx")(
    lambda s, d: build.received_by(transactions(s, d, dirty=True)))

EXPORT_SQL = {
    "accounts": "SELECT account_key, account_number FROM node",
    "banks": "SELECT bank_id, min(bank_name) AS name FROM node GROUP BY bank_id",
    "entities": "SELECT entity_id AS id, min(entity_name) AS name FROM node GROUP BY entity_id",
    "transactions": """
SELECT transaction_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", amount_received,
       receiving_currency, amount_paid, payment_currency, payment_format, is_laundering FROM tx""",
    "owns": "SELECT DISTINCT entity_id, account_key FROM node",
    "held_at": "SELECT DISTINCT account_key, bank_id FROM node",
    "sent": "SELECT from_account_key AS account_key, transaction_id FROM tx",
    "received_by": "SELECT transaction_id, to_account_key AS account_key FROM tx",
}
for _table, _sql in EXPORT_SQL.items():
    check(f"e5_export_{_table}", GRAPH + _sql)(
        lambda s, d, t=_table: export.export_frames(m.graph(s, d))[t])

# --- validation -----------------------------------------------------------------------------

check("v1_account_summary", with_(DIRTY_ACC) + """
SELECT count(*) AS total_rows, count(DISTINCT account_number) AS distinct_account_numbers,
       count(DISTINCT (bank_id, account_number)) AS distinct_bank_account_pairs,
       count(DISTINCT entity_id) AS distinct_entities, count(DISTINCT bank_id) AS distinct_banks
FROM dacc""")(lambda s, d: validate.account_summary(dirty_clean(s, d)))

check("v2_identity_conflicts", with_(DIRTY_ACC) + """
SELECT k.*, v.member_of, v.member, count(*) AS member_rows
FROM (SELECT account_number, count(*) AS row_count, count(DISTINCT bank_id) AS number_of_banks,
             count(DISTINCT entity_id) AS number_of_entities
      FROM dacc GROUP BY account_number
      HAVING count(DISTINCT bank_id) > 1 OR count(DISTINCT entity_id) > 1) k
JOIN (SELECT account_number, 'bank_id' AS member_of, CAST(bank_id AS VARCHAR) AS member FROM dacc
      UNION ALL SELECT account_number, 'entity_id', entity_id FROM dacc) v
  ON v.account_number = k.account_number AND v.member IS NOT NULL
GROUP BY ALL""")(lambda s, d: validate.identity_conflicts(dirty_clean(s, d)))

check("v2_identity_members", with_(DIRTY_ACC) + """
SELECT account_number, 'bank_id' AS member_of, CAST(bank_id AS VARCHAR) AS member, count(*) AS row_count
FROM dacc GROUP BY ALL
UNION ALL
SELECT account_number, 'entity_id', entity_id, count(*) FROM dacc GROUP BY ALL""")(
    lambda s, d: validate.distinct_members(dirty_clean(s, d), "account_number", ["bank_id", "entity_id"]))

check("v3_duplicate_records", with_(DIRTY_ACC) + """
SELECT bank_id, account_number, entity_id, 2 * count(*) AS copies FROM dacc
GROUP BY bank_id, account_number, entity_id""")(  # every record is there twice
    lambda s, d: validate.duplicate_keys(
        dirty_clean(s, d).unionByName(dirty_clean(s, d)), ["bank_id", "account_number", "entity_id"]))

check("v4_missing_counts", with_(DIRTY_ACC) + """
SELECT count(*) FILTER (bank_id IS NULL) AS missing_bank_id,
       count(*) FILTER (bank_name IS NULL OR bank_name = '') AS missing_bank_name,
       count(*) FILTER (entity_id IS NULL OR entity_id = '') AS missing_entity_id,
       count(*) FILTER (entity_name IS NULL OR entity_name = '') AS missing_entity_name
FROM dacc""")(lambda s, d: validate.missing_counts(
    dirty_clean(s, d), ["bank_id", "bank_name", "entity_id", "entity_name"]))

check("v5_account_node_summary", GRAPH + """
SELECT count(*) AS account_node_rows, count(DISTINCT account_key) AS distinct_account_keys,
       count(DISTINCT (bank_id, account_number)) AS distinct_bank_account_pairs,
       count(DISTINCT account_number) AS distinct_account_numbers,
       count(DISTINCT entity_id) AS connected_entities, count(DISTINCT bank_id) AS connected_banks
FROM node""")(lambda s, d: validate.account_node_summary(m.graph(s, d).accounts))

check("v6_incomplete_metadata", with_(ACC, KNOWN, RAW, PAIRS, nodes("known")) + """
SELECT *, 'Account' AS label FROM node
WHERE bank_name IS NULL OR entity_id IS NULL OR entity_name IS NULL""")(
    lambda s, d: validate.incomplete_metadata(n4(s, d)))

check("v7_bank_name_conflicts", """
SELECT bank_id, number_of_names, c_mktsegment AS bank_name, count(*) AS member_rows
FROM (SELECT c_nationkey AS bank_id, count(DISTINCT c_mktsegment) AS number_of_names FROM customer
      GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1) JOIN customer ON c_nationkey = bank_id
GROUP BY ALL""")(
    lambda s, d: validate.name_conflicts(
        m.table(s, d, "customer").select(
            F.col("c_nationkey").alias("bank_id"), F.col("c_mktsegment").alias("bank_name")),
        "bank_id", "bank_name"))

check("v7_entity_name_conflicts", with_(ACC) + """
SELECT k.entity_id, k.number_of_names, a.bank_name AS entity_name, count(*) AS member_rows
FROM (SELECT entity_id, count(DISTINCT bank_name) AS number_of_names FROM acc
      GROUP BY entity_id HAVING count(DISTINCT bank_name) > 1) k JOIN acc a ON a.entity_id = k.entity_id
GROUP BY ALL""")(  # names of banks stand in for those of entities, which are consistent
    lambda s, d: validate.name_conflicts(
        build.clean_accounts(m.raw_accounts(s, d)).select("entity_id", F.col("bank_name").alias("entity_name")),
        "entity_id", "entity_name"))

@check("v8_gate_outcomes", with_(ACC, DIRTY_RAW, TX).rstrip() + """, gates AS (
  SELECT 'banks' AS gate, 'several names' AS rule, count(*) AS broken
  FROM (SELECT bank_id FROM acc GROUP BY bank_id HAVING count(DISTINCT bank_name) > 1)
  UNION ALL SELECT 'entities', 'several names', count(*)
  FROM (SELECT entity_id FROM acc GROUP BY entity_id HAVING count(DISTINCT entity_name) > 1)
  UNION ALL SELECT 'segments', 'several names', count(*)
  FROM (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1)
  UNION ALL SELECT 'transactions', 'no time', count(*) FILTER ("timestamp" IS NULL) FROM tx
  UNION ALL SELECT 'transactions', 'no receiver', count(*) FILTER (to_account_key IS NULL) FROM tx)
SELECT gate, rule, broken, CASE WHEN sum(broken) OVER (PARTITION BY gate) = 0 THEN 'passed' ELSE 'stopped' END AS outcome FROM gates""")
def v8(spark, d):
    """Gates measured while the tables are written; names of segments stand in for inconsistent ones of banks."""
    accounts = build.clean_accounts(m.raw_accounts(spark, d))
    segments = m.table(spark, d, "customer").select("c_nationkey", "c_mktsegment")
    several = {"several names": F.col("several")}
    tables = {
        "banks": (validate.names_per_key(accounts, "bank_id", "bank_name"), several),
        "entities": (validate.names_per_key(accounts, "entity_id", "entity_name"), several),
        "segments": (validate.names_per_key(segments, "c_nationkey", "c_mktsegment"), several),
        "transactions": (transactions(spark, d, dirty=True), {
            "no time": F.col("timestamp").isNull(), "no receiver": F.col("to_account_key").isNull()}),
    }
    rows = []
    for gate, (df, rules) in tables.items():
        _, broken = validate.measured(df, rules)
        rows += [(gate, rule, n, "stopped" if any(broken.values()) else "passed") for rule, n in broken.items()]
    return spark.createDataFrame(rows, "gate string, rule string, broken bigint, outcome string")


check("v9_duplicate_transaction_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")(
    lambda s, d: validate.duplicate_keys(m.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))

check("v9_duplicate_account_keys", GRAPH + """
SELECT account_key, count(*) AS copies FROM node GROUP BY account_key HAVING count(*) > 1""")(
    lambda s, d: validate.duplicate_keys(m.graph(s, d).accounts, ["account_key"]))

check("v10_transaction_summary", with_(DIRTY_RAW, TX) + """
SELECT count(*) AS transaction_node_rows, count(DISTINCT transaction_id) AS distinct_transaction_ids,
       count(*) FILTER ("timestamp" IS NULL) AS invalid_timestamps,
       count(*) FILTER (from_account_key = to_account_key) AS self_transfers,
       count(*) FILTER (is_laundering) AS laundering_transactions
FROM tx""")(lambda s, d: validate.transaction_summary(transactions(s, d, dirty=True)))


@check("v11_unknown_accounts", DIRTY + """
SELECT account_key FROM (SELECT from_account_key AS account_key FROM tx UNION SELECT to_account_key FROM tx) u
WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.account_key = u.account_key)""")
def v11(spark, d):
    graph = m.dirty_graph(spark, d)
    return validate.unknown_accounts(graph.transactions, graph.accounts)


check("v12_bank_summary", with_(DIRTY_ACC) + """
SELECT count(*) AS node_rows, count(DISTINCT bank_id) AS distinct_ids,
       count(*) FILTER (name IS NULL OR trim(name) = '') AS missing_names
FROM (SELECT bank_id, min(bank_name) AS name FROM dacc GROUP BY bank_id)""")(
    lambda s, d: validate.node_summary(build.bank_nodes(dirty_clean(s, d)), "bank_id"))
check("v12_entity_summary", with_(DIRTY_ACC) + """
SELECT count(*) AS node_rows, count(DISTINCT entity_id) AS distinct_ids,
       count(*) FILTER (name IS NULL OR trim(name) = '') AS missing_names
FROM (SELECT entity_id, min(entity_name) AS name FROM dacc GROUP BY entity_id)""")(
    lambda s, d: validate.node_summary(build.entity_nodes(dirty_clean(s, d)), "id"))

check("v13_expected_counts", with_(ACC, KNOWN, RAW, PAIRS, nodes("known")) + """
SELECT count(DISTINCT bank_id) AS expected_banks, count(DISTINCT entity_id) AS expected_entities
FROM node""")(lambda s, d: validate.expected_counts(n4(s, d)))


def edge_sql(template: str) -> str:
    """One branch per edge type over the dirty graph."""
    edges = {
        "OWNS": "SELECT DISTINCT entity_id AS a, account_key AS b FROM all_node",
        "HELD_AT": "SELECT DISTINCT account_key AS a, CAST(bank_id AS VARCHAR) AS b FROM all_node",
        "SENT": "SELECT from_account_key AS a, transaction_id AS b FROM tx",
        "RECEIVED_BY": "SELECT transaction_id AS a, to_account_key AS b FROM tx",
    }
    return DIRTY + " UNION ALL ".join(template.format(kind=k, edge=e) for k, e in edges.items())


check("v14_relationship_summary", edge_sql("""
SELECT '{kind}' AS relationship_type, (SELECT count(*) FROM ({edge})) AS row_count,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM ({edge}))) AS distinct_relationships"""))(
    lambda s, d: validate.relationship_summary(m.dirty_graph(s, d, m.FOR_WRITING)))

_ENDS = [
    ("OWNS", "entities", "entity_id", "SELECT DISTINCT entity_id, account_key FROM all_node",
     "SELECT entity_id FROM all_node"),
    ("OWNS", "accounts", "account_key", "SELECT DISTINCT entity_id, account_key FROM all_node",
     "SELECT account_key FROM node"),
    ("HELD_AT", "accounts", "account_key", "SELECT account_key, bank_id FROM all_node",
     "SELECT account_key FROM node"),
    ("HELD_AT", "banks", "bank_id", "SELECT account_key, bank_id FROM all_node",
     "SELECT bank_id FROM all_node"),
    ("SENT", "accounts", "from_account_key", "SELECT * FROM tx", "SELECT account_key FROM node"),
    ("SENT", "transactions", "transaction_id", "SELECT * FROM tx", "SELECT transaction_id FROM tx"),
    ("RECEIVED_BY", "transactions", "transaction_id", "SELECT * FROM tx", "SELECT transaction_id FROM tx"),
    ("RECEIVED_BY", "accounts", "to_account_key", "SELECT * FROM tx", "SELECT account_key FROM node"),
]
check("v15_missing_endpoints", DIRTY + " UNION ALL ".join(f"""
SELECT '{kind}' AS relationship_type, '{node}' AS missing_node,
       (SELECT count(*) FROM ({edge}) e WHERE e.{end} IS NULL OR e.{end} NOT IN (
          SELECT x FROM ({known}) AS q(x) WHERE x IS NOT NULL)) AS missing_rows"""
    for kind, node, end, edge, known in _ENDS))(
    lambda s, d: validate.missing_endpoints(m.dirty_graph(s, d, m.FOR_WRITING)))


@check("v17_reconcile_manifest", """
WITH e AS (SELECT 'f' || c_custkey AS file_name, CAST(c_nationkey AS BIGINT) AS file_size FROM customer),
     a AS (SELECT 'f' || (s_suppkey * 20) AS file_name, CAST(s_nationkey AS BIGINT) AS file_size FROM supplier)
SELECT coalesce(e.file_name, a.file_name) AS file_name, e.file_size AS expected_size,
       a.file_size AS actual_size,
       CASE WHEN a.file_name IS NULL THEN 'MISSING' WHEN e.file_name IS NULL THEN 'UNEXPECTED'
            WHEN e.file_size = a.file_size THEN 'MATCH' ELSE 'SIZE_DIFFERS' END AS status
FROM e FULL JOIN a ON e.file_name = a.file_name""")
def v17(spark, d):
    def manifest(table, key, size):
        return m.table(spark, d, table).select(
            F.concat(F.lit("f"), key).alias("file_name"), F.col(size).cast("bigint").alias("file_size"))

    return validate.reconcile_manifest(
        manifest("customer", F.col("c_custkey"), "c_nationkey"),
        manifest("supplier", F.col("s_suppkey") * 20, "s_nationkey"))


@check("v18_check_constraints", """
SELECT 'Account' AS label, CAST(c_nationkey AS VARCHAR) AS key, count(*) AS copies FROM customer
GROUP BY c_nationkey HAVING count(*) > 1
UNION ALL
SELECT 'Transaction', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL
SELECT 'Entity', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) > 1""")
def v18(spark, d):
    """Keys that are not unique on purpose; the banks of this graph are."""
    customer, line = m.table(spark, d, "customer"), m.table(spark, d, "lineitem")
    tables = dict(
        accounts=customer.select(F.col("c_nationkey").cast("string").alias("account_key")),
        banks=m.table(spark, d, "nation").select(F.col("n_nationkey").alias("bank_id")),
        entities=customer.select(F.col("c_mktsegment").alias("id")),
        transactions=line.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("transaction_id")),
    )
    edges = dict.fromkeys(("owns", "held_at", "sent", "received_by"))
    return validate.check_constraints(GraphTables(**tables, **edges))

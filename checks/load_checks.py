"""Typed upsert, edge merge, files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import mapping as m
from checks.graph_checks import DIRTY_ACC, EXPORT_SQL, dirty_clean
from checks.registry import check
from checks.sql import ACC, DIRTY, GRAPH, RAW, with_
from remitgraph.operators import export, load
from remitgraph.plans.staging import shared_folder
from remitgraph.plans.tables import EDGE_ENDS, NODE_KEYS, RAW_TRANSACTION_HEADINGS
from remitgraph.sources import files, keyed, sampling, store


def fresh_folder(spark) -> str:
    return f"{shared_folder(spark)}/remitgraph/files-{uuid.uuid4().hex}"


# --- upsert ---------------------------------------------------------------------------------


L1 = """
WITH i AS (SELECT s_nationkey || '|' || s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS v
           FROM supplier WHERE s_suppkey % 10 <> 0),
     e AS (SELECT c_nationkey || '|' || c_custkey AS k, c_name AS v FROM customer)
SELECT coalesce(i.k, e.k) AS account_key, CASE WHEN i.k IS NOT NULL THEN i.v ELSE e.v END AS account_number
FROM e FULL JOIN i ON e.k = i.k"""


def supplier_accounts(spark, d):
    key = F.col("s_suppkey")
    return m.table(spark, d, "supplier").select(
        F.when(key % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_nationkey", F.lit("|"), key))
        .alias("account_key"),
        F.when(key % 7 != 0, F.concat("s_name", F.lit(" "))).alias("account_number"),
        key.alias(load.SEQ))


def customer_accounts(spark, d):
    return m.table(spark, d, "customer").select(
        F.concat_ws("|", "c_nationkey", "c_custkey").alias("account_key"),
        F.col("c_name").alias("account_number"))


@check("l1_upsert_accounts", L1)
def l1(spark, d):
    return load.upsert_nodes(
        customer_accounts(spark, d), load.typed_nodes("accounts", supplier_accounts(spark, d)), "account_key")


def fresh_store(spark):
    return keyed.open_store(spark, fresh_folder(spark), parts=8, buckets=4)


@check("l1_incremental_accounts", L1)
def l1_incremental(spark, d):
    """Customers first, then suppliers as a batch that overwrites some of them."""
    into = fresh_store(spark)
    keyed.load_batch(into, {"accounts": customer_accounts(spark, d).withColumn(load.SEQ, F.lit(1))})
    keyed.load_batch(into, {"accounts": supplier_accounts(spark, d)})
    return into.read("accounts")


def bank_rows(spark, d):
    bad = F.col("c_custkey") % 25 == 0
    return m.table(spark, d, "customer").select(
        F.concat(F.when(bad, "x").otherwise(" "), "c_nationkey").alias("bank_id"),
        F.concat("c_mktsegment", F.lit(" ")).alias("name"), F.col("c_custkey").alias(load.SEQ))


@check("l2_upsert_banks", """
SELECT CAST(n_nationkey + 100 AS BIGINT) AS bank_id, n_name AS name FROM nation
UNION ALL
SELECT c_nationkey, max_by(c_mktsegment, c_custkey) FROM customer WHERE c_custkey % 25 <> 0 GROUP BY c_nationkey
UNION ALL
SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (
  SELECT c_nationkey FROM customer WHERE c_custkey % 25 <> 0)""")
def l2(spark, d):
    nation = m.table(spark, d, "nation")
    existing = nation.select(F.inline(F.array(*[
        F.struct((F.col("n_nationkey") + shift).cast("bigint").alias("bank_id"), F.col("n_name").alias("name"))
        for shift in (0, 100)])))
    return load.upsert_nodes(existing, load.typed_nodes("banks", bank_rows(spark, d)), "bank_id")


@check("l2_load_report", """
SELECT 'accounts' AS table_name, count(*) AS offered_rows, 0 AS blank_keys, 0 AS unusable_keys FROM customer
UNION ALL
SELECT 'banks', count(*), 0, count(*) FILTER (c_custkey % 25 = 0) FROM customer
UNION ALL
SELECT 'entities', count(*), count(*) FILTER (c_mktsegment = 'MACHINERY'), 0 FROM customer
UNION ALL
SELECT 'transactions', count(*), 0, 0 FROM lineitem""")
def l2_report(spark, d):
    customer = m.table(spark, d, "customer")
    return load.load_report({
        "accounts": customer.select(F.col("c_name").alias("account_key")),
        "banks": bank_rows(spark, d),
        "entities": customer.select(F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise("x").alias("id")),
        "transactions": m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("transaction_id")),
    })


@check("l3_upsert_entities", """
SELECT 'E' || (c_custkey % 40) AS id, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1""")
def l3(spark, d):
    rows = m.table(spark, d, "customer").select(
        m.entity_id("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias(load.SEQ))
    return load.upsert_nodes(None, load.typed_nodes("entities", rows), "id")


L4 = """
SELECT l_orderkey || '/' || l_linenumber AS transaction_id,
       CASE WHEN l_tax > 0 THEN l_shipdate END AS "timestamp", l_quantity AS amount_received,
       l_linestatus AS receiving_currency, l_extendedprice AS amount_paid,
       l_linestatus AS payment_currency, l_returnflag AS payment_format,
       l_returnflag IN ('R', 'A') AS is_laundering
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
        l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC,
        l_linestatus DESC, l_tax DESC) AS rn FROM lineitem) WHERE rn = 1"""


def line_transactions(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", " TRUE ").when(F.col("l_returnflag") == "A", "1").otherwise("no")
    return m.table(spark, d, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.when(F.col("l_tax") > 0, F.substring(F.col("l_shipdate").cast("string"), 1, 19)).otherwise(" ")
        .alias("timestamp"),
        F.col("l_quantity").cast("string").alias("amount_received"),
        F.concat("l_linestatus", F.lit(" ")).alias("receiving_currency"),
        F.col("l_extendedprice").cast("string").alias("amount_paid"),
        F.col("l_linestatus").alias("payment_currency"), F.col("l_returnflag").alias("payment_format"),
        flag.alias("is_laundering"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                 "l_returnflag", "l_linestatus", "l_tax").alias(load.SEQ))


@check("l4_upsert_transactions", L4)
def l4(spark, d):
    return load.upsert_nodes(None, load.typed_nodes("transactions", line_transactions(spark, d)), "transaction_id")


@check("l4_incremental_transactions", L4)
def l4_incremental(spark, d):
    """The same rows as two batches, the later ones second."""
    rows, into = line_transactions(spark, d), fresh_store(spark)
    later = F.col(load.SEQ)["l_shipdate"] >= "1995-06-17"
    for part in (~later, later):
        keyed.load_batch(into, {"transactions": rows.filter(part)})
    return into.read("transactions")


def loaded(spark, d):
    """The dirty graph exported and loaded into an empty store."""
    frames = export.export_frames(m.dirty_graph(spark, d, m.FOR_WRITING), order=None)
    return load.load_graph({
        t: df.withColumn(load.SEQ, F.lit(1)) if t in NODE_KEYS else df for t, df in frames.items()
    }, fresh_folder(spark))


LOADED = {
    "owns": "SELECT DISTINCT entity_id, account_key FROM node",
    "held_at": "SELECT DISTINCT account_key, bank_id FROM node",
    "sent": """SELECT DISTINCT from_account_key AS account_key, transaction_id FROM tx
WHERE from_account_key IN (SELECT account_key FROM node)""",
    "received_by": """SELECT DISTINCT transaction_id, to_account_key AS account_key FROM tx
WHERE to_account_key IN (SELECT account_key FROM node)""",
}


def merged(spark, d, table):
    graph = m.dirty_graph(spark, d)
    rows = load.typed_edges(table, export.export_frames(graph, order=None)[table])
    tables = dict(graph.items())
    sides = [load.node_keys(tables, end, node) for end, node in EDGE_ENDS[table][1]]
    return load.merge_edges(None, rows, *sides)


for _i, (_table, _sql) in enumerate(LOADED.items()):
    check(f"l{_i + 5}_merge_{_table}", DIRTY + _sql)(lambda s, d, t=_table: merged(s, d, t))

def loaded_in_batches(spark, d, table):
    """Nodes, then the edges in two batches that overlap."""
    frames = export.export_frames(m.dirty_graph(spark, d, m.FOR_WRITING), order=None)
    into = fresh_store(spark)
    nodes = {end_table for _, end_table in EDGE_ENDS[table][1]}
    keyed.load_batch(into, {t: frames[t].withColumn(load.SEQ, F.lit(1)) for t in nodes})
    some = F.pmod(F.xxhash64(*frames[table].columns), F.lit(3))
    for part in (some < 2, some > 0):
        keyed.load_batch(into, {table: frames[table].filter(part)})
    return into.read(table)


for _i, (_table, _sql) in enumerate(LOADED.items()):
    check(f"l{_i + 5}_incremental_{_table}", DIRTY + _sql)(lambda s, d, t=_table: loaded_in_batches(s, d, t))

check("l9_graph_counts", DIRTY + " UNION ALL ".join([
    "SELECT 'node' AS kind, 'Account' AS name, count(DISTINCT account_key) AS rows FROM node",
    # The null entity of accounts without metadata is dropped by the load.
    "SELECT 'node', 'Entity', count(DISTINCT entity_id) FROM all_node",
    "SELECT 'node', 'Bank', count(DISTINCT bank_id) FROM all_node",
    "SELECT 'node', 'Transaction', count(DISTINCT transaction_id) FROM tx",
    *[f"SELECT 'relationship', '{t.upper()}', count(*) FROM ({sql})" for t, sql in LOADED.items()],
]))(lambda s, d: load.graph_counts(load.as_graph(loaded(s, d))))

check("l9_loaded_transactions", DIRTY + """
SELECT DISTINCT transaction_id, "timestamp", amount_received, receiving_currency, amount_paid,
       payment_currency, payment_format, is_laundering,
       CASE WHEN from_account_key IN (SELECT account_key FROM node) THEN from_account_key END AS from_account_key,
       CASE WHEN to_account_key IN (SELECT account_key FROM node) THEN to_account_key END AS to_account_key
FROM tx""")(lambda s, d: load.as_graph(loaded(s, d)).transactions)


# --- files ----------------------------------------------------------------------------------

TEXT_ACCOUNTS = with_(ACC) + """
SELECT bank_name, CAST(bank_id AS VARCHAR) AS bank_id, account_number, entity_id, entity_name FROM acc"""
ACCOUNT_NAMES = ["bank_name", "bank_id", "account_number", "entity_id", "entity_name"]


@check("s1_csv_scan_duplicate_headings", with_(RAW) + """
SELECT time_text, CAST(from_bank AS VARCHAR) AS from_bank, from_number, CAST(to_bank AS VARCHAR) AS to_bank,
       to_number, payment_format, CAST(code AS VARCHAR) AS code FROM raw""")
def s1(spark, d):
    return two_headings(spark, d).select(
        F.col("Timestamp").alias("time_text"), F.col("From Bank").alias("from_bank"),
        F.col("from_account").alias("from_number"), F.col("To Bank").alias("to_bank"),
        F.col("to_account").alias("to_number"), F.col("Payment Format").alias("payment_format"),
        F.col("Is Laundering").alias("code"))


check("s1_csv_scan_all_columns", with_(RAW) + "SELECT * FROM raw")(
    lambda s, d: two_headings(s, d).select(
        F.col("Timestamp").alias("time_text"), F.col("From Bank").cast("bigint").alias("from_bank"),
        F.col("from_account").alias("from_number"), F.col("To Bank").cast("bigint").alias("to_bank"),
        F.col("to_account").alias("to_number"), F.col("Amount Received").cast("double").alias("amount_received"),
        F.col("Receiving Currency").alias("receiving_currency"), F.col("Amount Paid").cast("double").alias("amount_paid"),
        F.col("Payment Currency").alias("payment_currency"), F.col("Payment Format").alias("payment_format"),
        F.col("Is Laundering").cast("int").alias("code")))


def two_headings(spark, d):
    """Written with two equal headings (first line of every file) and read back by name."""
    folder = fresh_folder(spark)
    raw = m.raw_transactions(spark, d)
    line = F.concat_ws(",", *[F.col(x).cast("string") for x in raw.columns])
    part = F.pmod(F.xxhash64(*raw.columns), F.lit(8))
    lines = raw.select(line.alias("value"), part.alias("part"), F.lit(1).alias("at"))
    heading = spark.range(8).select(
        F.lit(",".join(RAW_TRANSACTION_HEADINGS)).alias("value"), F.col("id").alias("part"), F.lit(0).alias("at"))
    rows = heading.unionByName(lines).repartition("part").sortWithinPartitions("part", "at")
    rows.drop("at").write.partitionBy("part").text(folder)
    return files.read_raw_transactions(spark, folder)


def written_accounts(spark, d, name="Accounts-Small.csv"):
    folder = fresh_folder(spark)
    files.write_table(m.raw_accounts(spark, d).toDF(*ACCOUNT_NAMES), f"{folder}/{name}", "csv")
    return folder


check("s2_csv_scan_text", TEXT_ACCOUNTS)(
    lambda s, d: files.read_text_table(s, written_accounts(s, d) + "/Accounts-Small.csv"))


@check("s3_matching_files", """
SELECT 'Banks_Small' AS table_name, count(*) AS row_count,
       (SELECT count(*) FROM (DESCRIBE nation)) AS column_count FROM nation
UNION ALL SELECT 'Regions_Small', count(*), (SELECT count(*) FROM (DESCRIBE region)) FROM region""")
def s3(spark, d):
    """The files of two of three tables; each keeps its own columns."""
    from remitgraph.operators.profile import shapes

    folder = fresh_folder(spark)
    for name, table in (("Banks_Small", "nation"), ("Regions_Small", "region"), ("Banks_Large", "nation")):
        df = m.table(spark, d, table)
        files.write_table(df.coalesce(1), f"{folder}/{name}", "csv")  # one file, as these tables are small
    found = files.read_matching(spark, folder, "PART-*.csv")
    return shapes({n.split("/")[0]: df for n, df in found.items() if "_Small/" in n})


@check("s3_matching_rows", """
SELECT 'Banks_Small' AS table_name, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation
UNION ALL SELECT 'Regions_Small', CAST(r_regionkey AS VARCHAR), r_name FROM region""")
def s3_rows(spark, d):
    """What the files whose names match hold; names are matched regardless of case."""
    folder = fresh_folder(spark)
    for name, table in (("Banks_Small", "nation"), ("Regions_Small", "region"), ("Banks_Large", "nation")):
        df = m.table(spark, d, table)
        files.write_table(df.coalesce(1), f"{folder}/{name}", "csv")  # one file, as these tables are small
    found = {n: df for n, df in files.read_matching(spark, folder, "PART-*.CSV").items() if "_Small/" in n}
    parts = [df.select(F.lit(n.split("/")[0]).alias("table_name"), F.col(df.columns[0]).alias("key"), F.col(df.columns[1]).alias("name"))
             for n, df in sorted(found.items())]
    return parts[0].unionByName(parts[1])


RANK = "md5('42|' || transaction_id)"
check("s4_sample", GRAPH + f"SELECT transaction_id FROM tx WHERE {RANK} < '028f5c28f5c2'")(
    lambda s, d: sampling.repeatable_sample(m.graph(s, d).transactions, ["transaction_id"], 0.01)
    .select("transaction_id"))
check("s4_sample_capped", GRAPH + f"""
SELECT transaction_id FROM tx WHERE {RANK} < '800000000000' ORDER BY {RANK}, transaction_id LIMIT 5000""")(
    lambda s, d: sampling.repeatable_sample(
        m.graph(s, d).transactions, ["transaction_id"], 0.5, limit=5000).select("transaction_id"))
check("s4_random_sample")(
    lambda s, d: sampling.random_sample(m.table(s, d, "lineitem"), 0.01, 42, 50_000))


@check("s5_csv_sink_blanks", with_(DIRTY_ACC) + """
SELECT account_number, CAST(bank_id AS VARCHAR) AS bank_id, bank_name, entity_id,
       CASE WHEN entity_name <> '' THEN entity_name END AS entity_name FROM dacc""")
def s5(spark, d):
    """Null and empty text are both blank in the file and both null when read."""
    folder = fresh_folder(spark)
    files.write_table(dirty_clean(spark, d), folder, "csv")
    return files.read_text_table(spark, folder)


@check("s6_single_csv", GRAPH + "SELECT CAST(bank_id AS VARCHAR) AS bank_id, min(bank_name) AS name FROM node GROUP BY bank_id")
def s6(spark, d):
    path = fresh_folder(spark) + "/banks"
    files.write_table(export.export_frames(m.graph(spark, d))["banks"], path, "csv")
    return files.read_text_table(spark, path)


def bundle(spark, d, compression=None):
    graph = m.graph(spark, d, m.FOR_WRITING)
    return graph, export.write_export(graph, fresh_folder(spark), "v2", compression=compression)


@check("s7_export_bundle", GRAPH + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS expected_rows, count(*) AS actual_rows, true AS count_matches "
    f"FROM ({sql})" for t, sql in EXPORT_SQL.items()))
def s7(spark, d):
    """Also the reconciliation of a written bundle with its source."""
    graph, folder = bundle(spark, d, "gzip")
    expected = export.export_frames(graph, order=None)
    return export.export_validation(export.read_export(spark, folder), expected).drop("columns")


@check("v16_export_validation", GRAPH + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS actual_rows, "
    f"'{','.join(export.EXPORT_LAYOUT[t][0])}' AS columns FROM ({sql})" for t, sql in EXPORT_SQL.items()))
def v16(spark, d):
    graph, folder = bundle(spark, d)
    expected = export.export_frames(graph, order=None)
    return export.export_validation(export.read_export(spark, folder), expected).select(
        "table_name", "actual_rows", "columns")


check("s8_file_manifest")(lambda s, d: files.copy_manifest(s, bundle(s, d)[1]))


@check("s8_folder_sizes", """
SELECT 'priority=' || o_orderpriority AS folder, CAST(sum(strlen(o_orderkey || ',' || o_custkey || ',' || o_orderstatus) + 1) AS BIGINT) AS bytes
FROM orders GROUP BY o_orderpriority""")
def s8_sizes(spark, d):
    """The manifest of text files whose sizes follow from the rows, by folder; names hold blanks."""
    folder = fresh_folder(spark)
    m.table(spark, d, "orders").select(
        F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"),
        F.col("o_orderpriority").alias("priority")).write.partitionBy("priority").text(folder)
    return files.copy_manifest(spark, folder).groupBy(F.substring_index("file_name", "/", 1).alias("folder")).agg(
        F.sum("file_size").cast("bigint").alias("bytes"))


@check("s9_inline_rows", with_(RAW) + """
SELECT v.name, count(*) AS n FROM raw JOIN (VALUES ('O', 'Open'), ('F', 'Final'), ('P', 'Partial')) v(code, name)
ON raw.payment_currency = v.code GROUP BY v.name""")
def s9(spark, d):
    names = files.inline_rows(
        spark, [("O", "Open"), ("F", "Final"), ("P", "Partial")], "code string, name string")
    raw = m.raw_transactions(spark, d)
    return raw.join(names, raw["Payment Currency"] == names.code).groupBy("name").agg(F.count("*").alias("n"))


@check("s10_typed_read", GRAPH + """
SELECT transaction_id, "timestamp", amount_received, receiving_currency, amount_paid, payment_currency,
       payment_format, is_laundering FROM tx""")
def s10(spark, d):
    """Written as CSV, read as text, converted on the way in."""
    _, folder = bundle(spark, d, "gzip")
    rows = load.with_sequence(export.read_export(spark, folder)["transactions"], 1)
    return load.upsert_nodes(None, load.typed_nodes("transactions", rows), "transaction_id")


@check("s11_stored_graph", GRAPH + """
SELECT *, 'Transaction' AS label, true AS from_owned, true AS to_owned, true AS from_banked, true AS to_banked,
       from_account_key <> to_account_key AS between_owners FROM tx""")
def s11(spark, d):
    stored = store.write_graph(m.graph(spark, d, m.FOR_WRITING), fresh_folder(spark), buckets=8, derive_edges=True)
    return stored.transactions.drop("sender_bucket")

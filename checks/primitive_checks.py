"""The single steps the operators are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import mapping as m
from checks.graph_checks import base, dirty_clean, transactions
from checks.question_checks import FACTS, NOT_SELF, ask
from checks.registry import check
from checks.sql import ACC, DIRTY, DIRTY_ACC, DIRTY_RAW, GRAPH, KNOWN, PAIRS, PATH, RAW, TX, with_
from remitgraph.functions import columns as c
from remitgraph.operators import build, load, profile, retrieve
from remitgraph.operators.validate import group_values, union_all
from remitgraph.plans.staging import both_ways, top_per_group

# --- profiling ------------------------------------------------------------------------------

_SHAPES = {"customer": 5, "supplier": 4, "orders": 6, "lineitem": 11, "nation": 3}
check("f1_shapes", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}" for t, n in _SHAPES.items()))(
    lambda s, d: profile.shapes({t: m.table(s, d, t) for t in _SHAPES}))

check("f2_column_types", with_(DIRTY_ACC) + """
SELECT unnest([0, 1, 2, 3, 4]) AS position,
       unnest(['account_number', 'bank_id', 'bank_name', 'entity_id', 'entity_name']) AS column_name,
       unnest(['string', 'bigint', 'string', 'string', 'string']) AS data_type,
       unnest([count(account_number), count(bank_id), count(bank_name), count(entity_id), count(entity_name)]) AS filled_rows
FROM dacc""")(lambda s, d: profile.column_types(dirty_clean(s, d)))

check("f3_preview", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")(
    lambda s, d: profile.preview(m.table(s, d, "orders"), 5, [F.desc("o_orderdate"), "o_orderkey"]))


def _summary(name: str) -> str:
    return f"""SELECT '{name}' AS column_name, count({name}) AS "count", round(avg({name}), 6) AS mean,
  round(stddev_samp({name}), 6) AS std, CAST(min({name}) AS DOUBLE) AS "min",
  round(quantile_cont({name}, 0.25), 6) AS p25, round(quantile_cont({name}, 0.5), 6) AS p50,
  round(quantile_cont({name}, 0.75), 6) AS p75, CAST(max({name}) AS DOUBLE) AS "max" FROM lineitem"""


_NUMERIC = ["l_extendedprice", "l_quantity", "l_discount", "l_suppkey"]


@check("f4_numeric_summary", " UNION ALL ".join(_summary(n) for n in _NUMERIC))
def f4(spark, d):
    rows = profile.numeric_summary(m.table(spark, d, "lineitem"), _NUMERIC)
    return rows.withColumns({n: F.round(n, 6) for n in ("mean", "std", "p25", "p50", "p75")})


# --- columns --------------------------------------------------------------------------------

check("c1_select_rename", with_(ACC) + """
SELECT account_number, bank_id, bank_name, entity_id, entity_name FROM acc""")(
    lambda s, d: build.conform(m.raw_accounts(s, d), build.ACCOUNT_SPEC))

check("c2_trim", "SELECT c_custkey, c_name, c_mktsegment FROM customer")(
    lambda s, d: m.table(s, d, "customer").select(
        "c_custkey", c.text(F.concat(F.lit("  "), "c_name")).alias("c_name"),
        c.text(F.concat("c_mktsegment", F.lit(" "))).alias("c_mktsegment")))

check("c3_casts", """
SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS as_long, CAST(NULL AS BIGINT) AS bad_long,
       o_totalprice AS as_double, CAST(NULL AS DOUBLE) AS bad_double, CAST(o_custkey AS VARCHAR) AS as_text,
       CAST(left(o_orderpriority, 1) AS INTEGER) AS as_int, o_custkey <> 0 AS as_flag FROM orders""")(
    lambda s, d: m.table(s, d, "orders").select(
        "o_orderkey", c.long(F.substring("o_orderpriority", 1, 1)).alias("as_long"),
        c.long("o_orderpriority").alias("bad_long"),
        c.double(F.col("o_totalprice").cast("string")).alias("as_double"),
        c.double("o_orderstatus").alias("bad_double"), F.col("o_custkey").cast("string").alias("as_text"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("as_int"),
        F.col("o_custkey").cast("boolean").alias("as_flag")))

check("c4_drop_blank_keys", with_(DIRTY_ACC) + "SELECT account_number, entity_name FROM dacc WHERE trim(entity_name) <> ''")(
    lambda s, d: dirty_clean(s, d).filter(c.present("entity_name")).select("account_number", "entity_name"))

check("c5_account_key", with_(DIRTY_RAW) + """
SELECT from_bank || '|' || from_number AS from_account_key, to_bank || '|' || to_number AS to_account_key FROM raw""")(
    lambda s, d: base(s, d, dirty=True).select("from_account_key", "to_account_key"))

check("c6_parse_time", with_(DIRTY_RAW) + """
SELECT time_text AS timestamp_raw, try_strptime(time_text, '%Y/%m/%d %H:%M') AS "timestamp" FROM raw""")(
    lambda s, d: base(s, d, dirty=True).select("timestamp_raw", "timestamp"))

check("c7_code_flag", with_(RAW) + "SELECT code = 1 AS flag, count(*) AS n FROM raw GROUP BY 1")(
    lambda s, d: m.raw_transactions(s, d).groupBy(c.code_flag("Is Laundering").alias("flag")).agg(F.count("*").alias("n")))

check("c8_constants", GRAPH + "SELECT transaction_id, 'Transaction' AS label FROM tx")(
    lambda s, d: m.graph(s, d).transactions.select("transaction_id", "label"))

check("c9_null_mark", with_(DIRTY_RAW) + "SELECT coalesce(to_number, '<NULL>') AS receiver, count(*) AS n FROM raw GROUP BY 1")(
    lambda s, d: base(s, d, dirty=True).groupBy(c.or_null_mark("to_account_number").alias("receiver"))
    .agg(F.count("*").alias("n")))

check("c10_row_id", with_(DIRTY_RAW, TX) + "SELECT transaction_id FROM tx")(
    lambda s, d: base(s, d, dirty=True).select(build.transaction_id("decimal").alias("transaction_id")))

check("c11_iso_time", "SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS t FROM lineitem")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", c.iso_time("l_shipdate").alias("t")))

check("c12_flag", "SELECT sum(CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END)::BIGINT AS n, l_returnflag FROM lineitem GROUP BY l_returnflag")(
    lambda s, d: m.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum(c.flag(F.col("l_tax") == 0.08)).alias("n")))

_MIXED = "CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'BUILDING' THEN '' WHEN 'FURNITURE' THEN '  ' ELSE c_name END"


@check("c13_missing", f"""
SELECT c_custkey, v IS NULL OR v = '' AS missing, v IS NULL OR trim(v) = '' AS missing_trimmed
FROM (SELECT c_custkey, {_MIXED} AS v FROM customer)""")
def c13(spark, d):
    mixed = F.expr(_MIXED)
    return m.table(spark, d, "customer").select(
        "c_custkey", c.missing(mixed, trim=False).alias("missing"), c.missing(mixed).alias("missing_trimmed"))


check("c14_direction", """
SELECT l_orderkey, l_linenumber, CASE WHEN o_custkey = l_suppkey THEN 'OUTGOING' ELSE 'INCOMING' END AS direction
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")(
    lambda s, d: m.table(s, d, "lineitem").join(
        m.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber",
        c.direction("l_suppkey", "o_custkey", "OUTGOING", "INCOMING").alias("direction")))

check("c15_same_name", """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) = 'nation_3'""")(
    lambda s, d: m.customers(s, d).filter(c.same_name("n_name", F.lit("Nation_3"))).select("c_custkey", "n_name"))

check("c16_equality", GRAPH + "SELECT transaction_id FROM tx WHERE is_laundering AND payment_currency = 'F'")(
    lambda s, d: m.graph(s, d).transactions.filter(F.col("is_laundering") & (F.col("payment_currency") == "F"))
    .select("transaction_id"))

check("c17_local_time", """
SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN NULL ELSE l_shipdate END AS t FROM lineitem""")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", c.local_time(
        F.when(F.col("l_returnflag") == "N", "  ").when(F.col("l_returnflag") == "A", "unknown")
        .when(F.col("l_linenumber") > 3, c.iso_time("l_shipdate"))
        .otherwise(F.concat(F.lit(" "), F.col("l_shipdate").cast("string")))).alias("t")))

check("c18_text_flag", "SELECT l_orderkey, l_returnflag IN ('R', 'A') AS flag FROM lineitem")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", c.text_flag(
        F.when(F.col("l_returnflag") == "R", " TRUE ").when(F.col("l_returnflag") == "A", "1")
        .when(F.col("l_linenumber") > 3, "yes")).alias("flag")))

check("c19_clamp", """
SELECT l_orderkey, least(greatest(coalesce(CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) - 10 END, 5), 1), 20) AS n
FROM lineitem""")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", c.clamp(
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int") - 10)).alias("n")))

# --- joins ----------------------------------------------------------------------------------


@check("j1_left_join_two_keys", with_(ACC, KNOWN, RAW, PAIRS) + """
SELECT bank_id, account_number, bank_name, entity_id, entity_name
FROM pairs LEFT JOIN (SELECT bank_id, account_number, bank_name, entity_id, entity_name FROM known) USING (bank_id, account_number)""")
def j1(spark, d):
    pairs = build.transaction_accounts(m.raw_transactions(spark, d))
    metadata = build.account_metadata(build.clean_accounts(m.known_accounts(spark, d)))
    return build.account_nodes(pairs, metadata).drop("account_key", "label")


check("j2_left_anti", DIRTY + """
SELECT transaction_id FROM tx WHERE to_account_key IS NULL OR NOT EXISTS (
  SELECT 1 FROM node WHERE account_key = to_account_key)""")(
    lambda s, d: (lambda g: g.received_by.join(g.accounts, "account_key", "left_anti").select("transaction_id"))(
        m.dirty_graph(s, d)))

check("j3_one_hop", GRAPH + "SELECT account_key, entity_id, entity_name FROM node")(ask(retrieve.owners))

check("j4_entity_paths", PATH + f"SELECT s_id, r_id, from_account_key, to_account_key, {FACTS} FROM path WHERE {NOT_SELF}")(
    lambda s, d: retrieve.entity_paths(m.graph(s, d)).select(
        F.col("sender_entity_id").alias("s_id"), F.col("receiver_entity_id").alias("r_id"), "from_account_key",
        "to_account_key", "transaction_id", "timestamp", "amount", "currency", "payment_format", "is_laundering"))


@check("j5_paths_with_banks", PATH + f"SELECT transaction_id, s_bank, r_bank FROM path WHERE {NOT_SELF}")
def j5(spark, d):
    graph = m.graph(spark, d)
    banks = retrieve.account_banks(graph)
    sender = banks.select(F.col("account_key").alias("from_account_key"), F.col("bank_name").alias("s_bank"))
    receiver = banks.select(F.col("account_key").alias("to_account_key"), F.col("bank_name").alias("r_bank"))
    paths = retrieve.entity_paths(graph)
    return paths.join(sender, "from_account_key").join(receiver, "to_account_key").select(
        "transaction_id", "s_bank", "r_bank")


check("j6_either_direction", PATH + f"""
SELECT transaction_id, CASE WHEN s_name = 'Corporation #3' THEN 'SOURCE_TO_TARGET' ELSE 'TARGET_TO_SOURCE' END AS direction
FROM path WHERE (s_name = 'Corporation #3' AND r_name = 'Corporation #4') OR (s_name = 'Corporation #4' AND r_name = 'Corporation #3')""")(
    lambda s, d: retrieve.pair_rows(m.graph(s, d), "Corporation #3", "Corporation #4").select(
        "transaction_id", "direction"))


@check("j7_both_endpoints", DIRTY + """
SELECT DISTINCT from_account_key AS account_key, transaction_id FROM tx
WHERE from_account_key IN (SELECT account_key FROM node) AND transaction_id IN (SELECT transaction_id FROM tx WHERE is_laundering)""")
def j7(spark, d):
    graph = m.dirty_graph(spark, d)
    labelled = graph.transactions.filter("is_laundering").select("transaction_id")
    return load.merge_edges(None, graph.sent, graph.accounts.select("account_key"), labelled)


@check("j8_requests_as_parameters", GRAPH + """
SELECT 10000 + (CAST(substr(entity_name, 14) AS BIGINT)) AS request_id, account_key FROM node""")
def j8(spark, d):
    asked = m.requests(spark, d).filter("intent = 'ENTITY_LAUNDERING_TRANSACTIONS'").select("request_id", "entity_name")
    return retrieve.owners(m.graph(spark, d)).join(asked, "entity_name").select("request_id", "account_key")


# --- aggregation ----------------------------------------------------------------------------

check("a1_distinct_counts", GRAPH + """
SELECT count(*) AS rows, count(DISTINCT transaction_id) AS ids,
       count(DISTINCT (from_account_key, to_account_key)) AS pairs, count(DISTINCT payment_format) AS formats FROM tx""")(
    lambda s, d: m.graph(s, d).transactions.agg(
        F.count("*").alias("rows"), F.count_distinct("transaction_id").alias("ids"),
        F.count_distinct("from_account_key", "to_account_key").alias("pairs"),
        F.count_distinct("payment_format").alias("formats")))

check("a2_group_counts_and_sets", with_(ACC) + """
SELECT g.*, a.entity_id, count(*) AS entity_rows
FROM (SELECT bank_id, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM acc GROUP BY bank_id) g
JOIN acc a ON a.bank_id = g.bank_id GROUP BY ALL""")(
    lambda s, d: group_values(build.clean_accounts(m.raw_accounts(s, d)), "bank_id", {"entity_id": "entities"})
    .select("bank_id", F.col("row_count").alias("rows"), "entities", F.col("member").alias("entity_id"),
            F.col("member_rows").alias("entity_rows")))

check("a3_having", GRAPH + """
SELECT from_account_key, count(*) AS n FROM tx GROUP BY from_account_key HAVING count(*) > 50""")(
    lambda s, d: m.graph(s, d).transactions.groupBy("from_account_key").agg(F.count("*").alias("n")).filter("n > 50"))

check("a4_group_count", GRAPH + "SELECT payment_format, payment_currency, count(*) AS n FROM tx GROUP BY ALL")(
    lambda s, d: m.graph(s, d).transactions.groupBy("payment_format", "payment_currency").agg(F.count("*").alias("n")))

check("a5_conditional_counts", DIRTY + """
SELECT count(*) FILTER ("timestamp" IS NULL) AS no_time, count(*) FILTER (to_account_key IS NULL) AS no_receiver,
       count(*) FILTER (from_account_key = to_account_key) AS self_transfers FROM tx""")(
    lambda s, d: transactions(s, d, dirty=True).agg(
        F.sum(c.flag(F.col("timestamp").isNull())).alias("no_time"),
        F.count_if(F.col("to_account_key").isNull()).alias("no_receiver"),
        F.sum(c.flag(F.col("from_account_key") == F.col("to_account_key"))).alias("self_transfers")))

check("a6_totals_per_currency", GRAPH + """
SELECT entity_id, entity_name, payment_currency AS currency, count(*) AS transaction_count,
       CAST(sum(CAST(amount_paid AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM tx JOIN node ON account_key = from_account_key WHERE is_laundering GROUP BY ALL""")(ask(retrieve.sender_totals))

check("a7_rollup", GRAPH + """
SELECT entity_id, CAST(sum(n) AS BIGINT) AS transactions, count(*) AS currencies FROM (
  SELECT entity_id, payment_currency, count(*) AS n FROM tx JOIN node ON account_key = from_account_key
  WHERE is_laundering GROUP BY ALL) GROUP BY entity_id""")(
    lambda s, d: retrieve.sender_totals(m.graph(s, d)).groupBy("entity_id").agg(
        F.sum("transaction_count").alias("transactions"), F.count("*").alias("currencies")))

check("a8_counts_per_label", GRAPH + """
SELECT 'node' AS kind, 'Account' AS name, count(*) AS rows FROM node
UNION ALL SELECT 'node', 'Bank', count(DISTINCT bank_id) FROM node
UNION ALL SELECT 'node', 'Entity', count(DISTINCT entity_id) FROM node
UNION ALL SELECT 'node', 'Transaction', count(*) FROM tx
UNION ALL SELECT 'relationship', 'OWNS', count(*) FROM node
UNION ALL SELECT 'relationship', 'HELD_AT', count(*) FROM node
UNION ALL SELECT 'relationship', 'SENT', count(*) FROM tx
UNION ALL SELECT 'relationship', 'RECEIVED_BY', count(*) FROM tx""")(ask(load.graph_counts))

check("a9_distinct_rows", GRAPH + "SELECT DISTINCT from_account_key, payment_currency FROM tx")(
    lambda s, d: m.graph(s, d).transactions.select("from_account_key", "payment_currency").distinct())
check("a9_one_row_per_key", with_(DIRTY_ACC) + """
SELECT account_number, min(entity_id) AS entity_id FROM dacc GROUP BY account_number""")(
    lambda s, d: build.first_by(dirty_clean(s, d), ["account_number"], ["entity_id"]))

# --- set operations, order, limits ----------------------------------------------------------

check("u1_union_all", GRAPH + """
SELECT from_account_key AS account_key, transaction_id FROM tx UNION ALL SELECT to_account_key, transaction_id FROM tx""")(
    lambda s, d: (lambda g: union_all([g.sent, g.received_by]))(m.graph(s, d)))


@check("u2_concatenate", GRAPH + """
SELECT transaction_id, from_account_key AS account_key, 0 AS branch FROM tx WHERE is_laundering
UNION ALL SELECT transaction_id, to_account_key, 1 FROM tx WHERE is_laundering""")
def u2(spark, d):
    """Both sides of the labelled transfers with the number of the branch, in one scan."""
    rows = m.graph(spark, d).transactions.filter("is_laundering")
    sides = [F.struct(F.col(k).alias("account_key"), F.lit(i).alias("branch"))
             for i, k in enumerate(("from_account_key", "to_account_key"))]
    return both_ways(rows.select("transaction_id", "from_account_key", "to_account_key"), sides).drop(
        "from_account_key", "to_account_key")


@check("u3_difference", """
SELECT coalesce(c_custkey, k) AS key, CASE WHEN k IS NULL THEN 'MISSING' ELSE 'UNEXPECTED' END AS status
FROM customer FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) ON c_custkey = k
WHERE k IS NULL OR c_custkey IS NULL""")
def u3(spark, d):
    expected = m.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("e"))
    actual = m.table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct().withColumn("a", F.lit(1))
    both = expected.join(actual, "key", "full_outer").filter("e IS NULL OR a IS NULL")
    return both.select("key", F.when(F.col("a").isNull(), "MISSING").otherwise("UNEXPECTED").alias("status"))


check("k1_global_sort", with_(ACC) + "SELECT entity_id, account_number FROM acc ORDER BY entity_id, account_number")(
    lambda s, d: build.clean_accounts(m.raw_accounts(s, d)).orderBy("entity_id", "account_number")
    .select("entity_id", "account_number"))


@check("k2_time_order", with_(DIRTY_RAW, TX) + """
SELECT transaction_id, row_number() OVER (PARTITION BY from_account_key
  ORDER BY "timestamp" NULLS LAST, transaction_id) AS place FROM tx""")
def k2(spark, d):
    """Position in time order among the transfers of one sender, missing times last."""
    order = Window.partitionBy("from_account_key").orderBy(*retrieve.time_order())
    return transactions(spark, d, dirty=True).select(
        "transaction_id", F.row_number().over(order).cast("bigint").alias("place"))


check("k3_limit", GRAPH + "SELECT transaction_id FROM tx ORDER BY transaction_id LIMIT 100")(
    lambda s, d: profile.preview(m.graph(s, d).transactions.select("transaction_id"), 100, ["transaction_id"]))
check("k4_top_k", GRAPH + """
SELECT transaction_id, amount_paid FROM tx ORDER BY amount_paid DESC, transaction_id LIMIT 50""")(
    lambda s, d: m.graph(s, d).transactions.select("transaction_id", "amount_paid")
    .orderBy(F.desc("amount_paid"), "transaction_id").limit(50))
check("k4_top_k_per_group", GRAPH + """
SELECT payment_format, transaction_id, row_number FROM (
  SELECT *, row_number() OVER (PARTITION BY payment_format ORDER BY amount_paid DESC, transaction_id) AS row_number FROM tx)
WHERE row_number <= 50""")(
    lambda s, d: top_per_group(
        m.graph(s, d).transactions.select("payment_format", "transaction_id", "amount_paid"),
        ["payment_format"], [F.desc("amount_paid"), F.col("transaction_id")], 50).drop("amount_paid")
    .withColumn("row_number", F.col("row_number").cast("bigint")))
check("k5_result_cap", """
SELECT l_orderkey, least(coalesce(CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) + 20 END, 50), 50) AS n FROM lineitem""")(
    lambda s, d: m.table(s, d, "lineitem").select("l_orderkey", c.result_cap(
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int") + 20)).alias("n")))


@check("c20_nested_as_text", GRAPH + """
SELECT entity_id, '[' || string_agg('"' || payment_currency || '"', ',' ORDER BY payment_currency) || ']' AS currencies,
       strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last
FROM (SELECT entity_id, payment_currency, max("timestamp") AS last FROM tx JOIN node ON account_key = from_account_key
  WHERE is_laundering GROUP BY ALL) GROUP BY entity_id""")
def c20(spark, d):
    """Currencies are reduced to a few rows per entity before they are listed."""
    from remitgraph.operators.requests import flatten_evidence

    graph = m.graph(spark, d)
    sent = retrieve.labelled(graph).groupBy("from_account_key", "currency").agg(F.max("timestamp").alias("last"))
    owned = sent.join(retrieve.owners(graph), F.col("from_account_key") == F.col("account_key"))
    per_currency = owned.groupBy("entity_id", "currency").agg(F.max("last").alias("last"))
    return flatten_evidence(per_currency.groupBy("entity_id").agg(
        F.array_sort(F.collect_list("currency")).alias("currencies"), F.max("last").alias("last")))

"""Questions, single and in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import mapping as m
from checks.load_checks import fresh_folder
from checks.registry import ORACLES, check
from checks.sql import GRAPH, PATH
from remitgraph.operators import requests as rq
from remitgraph.operators import retrieve as r
from remitgraph.sources import store

A, B = "Corporation #1", "Corporation #2"
SHARED = "Corporation #0"  # two entities bear this name

FACTS = 'transaction_id, "timestamp", amount, currency, payment_format, is_laundering'
NOT_SELF = "from_account_key <> to_account_key"
BY_TIME = '"timestamp" NULLS LAST, transaction_id'


def relationship(a: str, b: str, self_transfers: bool = False) -> str:
    keep = "" if self_transfers else f"AND {NOT_SELF}"
    return f"""
SELECT s_id AS source_entity_id, s_name AS source_entity, r_id AS target_entity_id,
       r_name AS target_entity, 'SOURCE_TO_TARGET' AS direction, {FACTS}
FROM path WHERE s_name = '{a}' AND r_name = '{b}' {keep}
UNION ALL
SELECT r_id, r_name, s_id, s_name, 'TARGET_TO_SOURCE', {FACTS}
FROM path WHERE s_name = '{b}' AND r_name = '{a}' AND {NOT_SELF}"""


def first_rows(rows: str, group: str, ties: str, k: int = 50) -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {BY_TIME}, {ties}) AS rn FROM ({rows})) WHERE rn <= {k}"""


ENDS = "source_entity_id, target_entity_id"


def ask(function, *args, **options):
    return lambda s, d: function(m.graph(s, d), *args, **options)


check("q1_entity_relationship", PATH + first_rows(relationship(A, B), "direction", ENDS))(
    ask(r.entity_relationship, A, B))
check("q1_all_rows", PATH + relationship(A, SHARED))(ask(r.entity_relationship, A, SHARED, limit=None))
check("q1_same_name", PATH + first_rows(relationship(SHARED, SHARED), "direction", ENDS))(
    ask(r.entity_relationship, SHARED, SHARED))
check("q1_last_branch", PATH + f"""
SELECT * FROM ({relationship(A, B)}) WHERE direction = 'SOURCE_TO_TARGET'
UNION ALL SELECT * FROM (SELECT * FROM ({relationship(A, B)}) WHERE direction = 'TARGET_TO_SOURCE'
  ORDER BY {BY_TIME}, {ENDS} LIMIT 50)""")(ask(r.entity_relationship, A, B, limit_mode="last_branch"))
check("q1_combined", PATH + f"""
SELECT * FROM ({relationship(A, B)}) ORDER BY "timestamp" NULLS LAST, direction, transaction_id, {ENDS} LIMIT 50""")(
    ask(r.entity_relationship, A, B, limit_mode="combined"))


def laundering() -> str:
    return f"""
SELECT s_id AS searched_entity_id, s_name AS searched_entity, 'OUTGOING' AS direction, {FACTS},
       s_bank AS searched_entity_bank, r_id AS counterparty_id, r_name AS counterparty, r_bank AS counterparty_bank
FROM path WHERE is_laundering AND {NOT_SELF}
UNION ALL
SELECT r_id, r_name, 'INCOMING', {FACTS}, r_bank, s_id, s_name, s_bank
FROM path WHERE is_laundering AND {NOT_SELF}"""


PARTIES = "searched_entity_id, counterparty_id, searched_entity_bank, counterparty_bank"


def of_one(name: str) -> str:
    return f"SELECT * FROM ({laundering()}) WHERE searched_entity = '{name}'"


check("q2_entity_laundering", PATH + first_rows(of_one(A), "direction", PARTIES))(ask(r.entity_laundering, A))
check("q2_shared_name", PATH + first_rows(of_one(SHARED), "direction", PARTIES))(ask(r.entity_laundering, SHARED))
check("q2_all_rows", PATH + of_one(SHARED))(ask(r.entity_laundering, SHARED, limit=None))
check("q2_last_branch", PATH + f"""
SELECT * FROM ({of_one(A)}) WHERE direction = 'OUTGOING'
UNION ALL SELECT * FROM (SELECT * FROM ({of_one(A)}) WHERE direction = 'INCOMING'
  ORDER BY {BY_TIME}, {PARTIES} LIMIT 50)""")(ask(r.entity_laundering, A, limit_mode="last_branch"))
check("q2_combined", PATH + f"""
SELECT * FROM ({of_one(A)}) ORDER BY "timestamp" NULLS LAST, direction DESC, transaction_id, {PARTIES} LIMIT 50""")(
    ask(r.entity_laundering, A, limit_mode="combined"))

TOTALS = """
SELECT entity_id, entity_name, payment_currency AS currency, count(*) AS transaction_count,
       CAST(sum(CAST(amount_paid AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM tx JOIN node ON account_key = from_account_key WHERE is_laundering GROUP BY ALL"""
COUNTS = f"""
SELECT entity_id, entity_name, CAST(sum(transaction_count) AS BIGINT) AS laundering_transaction_count
FROM ({TOTALS}) GROUP BY ALL"""


def top(n: int) -> str:
    return f"SELECT * FROM ({COUNTS}) ORDER BY laundering_transaction_count DESC, entity_id LIMIT {n}"


check("q3_top_laundering_senders", GRAPH + f"""
SELECT entity_id, entity_name, laundering_transaction_count, currency, transaction_count, total_amount
FROM ({top(5)}) JOIN ({TOTALS}) USING (entity_id, entity_name)""")(ask(r.top_senders_by_currency, 5))


@check("q3_totals_as_text", GRAPH + f"""
SELECT entity_id, entity_name, laundering_transaction_count,
       string_agg(currency || '=' || transaction_count, ';' ORDER BY currency) AS totals
FROM ({top(20)}) JOIN ({TOTALS}) USING (entity_id, entity_name) GROUP BY ALL""")
def q3_text(spark, d):
    rows = r.top_laundering_senders(m.graph(spark, d), 99)
    entry = F.transform("totals_by_currency", lambda x: F.concat_ws("=", x.currency, x.transaction_count))
    return rows.withColumn("totals", F.array_join(entry, ";")).drop("totals_by_currency")


check("q3_nested")(ask(r.top_laundering_senders, 5))

SUBJECT = f"""
SELECT s_id AS subject_id, s_name AS searched_entity, 'OUTGOING' AS direction, {FACTS}, s_id, r_id,
       s_name AS sender_entity, r_name AS receiver_entity FROM path WHERE is_laundering
UNION ALL
SELECT r_id, r_name, 'INCOMING', {FACTS}, s_id, r_id, s_name, r_name FROM path
WHERE is_laundering AND {NOT_SELF}"""
check("q4_subject_transactions", PATH + f"""
SELECT subject_id AS searched_entity_id, searched_entity, direction, transaction_id, "timestamp", amount,
       currency, sender_entity, receiver_entity
FROM ({SUBJECT}) WHERE lower(searched_entity) = 'corporation #0'
ORDER BY {BY_TIME}, direction, subject_id, s_id, r_id LIMIT 50""")(
    ask(r.subject_transactions, "CORPORATION #0"))

# Seen independently, a self-transfer counts: once, and only when both names own the account.
PAIR = relationship(SHARED, SHARED, self_transfers=True)
check("q5_pair_transactions", PATH + f"""
SELECT * EXCLUDE (source_entity_id, target_entity_id) FROM ({PAIR})
ORDER BY {BY_TIME}, direction, {ENDS} LIMIT 50""")(
    ask(r.pair_transactions, SHARED.upper(), SHARED.lower()))
check("q5_pair_all_rows", PATH + PAIR)(ask(r.pair_rows, SHARED.upper(), SHARED.lower()))

check("q6_top_senders_simple", GRAPH + top(7))(ask(r.top_senders_simple, 7))


@check("q7_transaction_paths", PATH + f"""
SELECT s_id AS sender_id, s_name AS sender, from_account_key AS sender_account, transaction_id,
       to_account_key AS receiver_account, r_id AS receiver_id, r_name AS receiver,
       'OWNS,SENT,RECEIVED_BY,OWNS' AS relationships
FROM path WHERE {NOT_SELF} ORDER BY transaction_id, s_id, r_id LIMIT 10""")
def q7(spark, d):
    return flat_paths(m.graph(spark, d))


def flat_paths(graph):
    return r.transaction_paths(graph).select(
        F.col("sender_entity.id").alias("sender_id"), F.col("sender_entity.name").alias("sender"),
        F.col("sender_account.account_key").alias("sender_account"), "transaction.transaction_id",
        F.col("receiver_account.account_key").alias("receiver_account"),
        F.col("receiver_entity.id").alias("receiver_id"), F.col("receiver_entity.name").alias("receiver"),
        F.array_join("relationships", ",").alias("relationships"))


check("q7_nested_paths")(ask(r.transaction_paths))
check("q8_entity_count", GRAPH + "SELECT count(DISTINCT entity_id) AS entity_count FROM node")(ask(r.entity_count))

# --- stored graphs: rows that came in twice count once, so the SQL is that of the plain question ---


def stored_with_copies(spark, d):
    graph = m.graph(spark, d, m.FOR_WRITING)
    again = graph.transactions.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0)
    graph = graph.with_(transactions=graph.transactions.unionByName(again))
    return store.write_graph(graph, fresh_folder(spark), buckets=8, derive_edges=True)


def ask_stored(name, function, *args):
    check(f"{name.split('_')[0]}_with_copies", ORACLES[name])(
        lambda s, d: function(stored_with_copies(s, d), *args))


ask_stored("q1_entity_relationship", r.entity_relationship, A, B)
ask_stored("q2_shared_name", r.entity_laundering, SHARED)
ask_stored("q3_top_laundering_senders", r.top_senders_by_currency, 5)
ask_stored("q4_subject_transactions", r.subject_transactions, "CORPORATION #0")
ask_stored("q5_pair_transactions", r.pair_transactions, SHARED.upper(), SHARED.lower())
ask_stored("q6_top_senders_simple", r.top_senders_simple, 7)
ask_stored("q7_transaction_paths", flat_paths)

# --- batches --------------------------------------------------------------------------------

REQUESTS = """,
names AS (SELECT DISTINCT (c_custkey % 40) % 39 AS i FROM customer),
request AS (
  SELECT a.i * 100 + b.i AS request_id, 'ENTITY_RELATIONSHIP' AS intent, 'Corporation #' || a.i AS source,
         'Corporation #' || b.i AS target, NULL AS subject, NULL AS n FROM names a, range(39) b(i)
  UNION ALL SELECT i + 10000, 'ENTITY_LAUNDERING_TRANSACTIONS', NULL, NULL, 'Corporation #' || i, NULL FROM names
  UNION ALL VALUES (20000, 'TOP_LAUNDERING_SENDERS', NULL, NULL, NULL, NULL),
    (20001, 'TOP_LAUNDERING_SENDERS', NULL, NULL, NULL, 0), (20002, 'TOP_LAUNDERING_SENDERS', NULL, NULL, NULL, 5),
    (20003, 'TOP_LAUNDERING_SENDERS', NULL, NULL, NULL, 99), (20004, 'UNSUPPORTED', NULL, NULL, NULL, NULL),
    (20005, 'ENTITY_RELATIONSHIP', 'Corporation #1', NULL, NULL, NULL)),
rel_raw AS (
  SELECT s_id AS source_entity_id, s_name AS source_entity, r_id AS target_entity_id, r_name AS target_entity,
         'SOURCE_TO_TARGET' AS direction, """ + FACTS + f"""
  FROM path WHERE {NOT_SELF}
  UNION ALL
  SELECT r_id, r_name, s_id, s_name, 'TARGET_TO_SOURCE', {FACTS} FROM path WHERE {NOT_SELF}),
rel AS (SELECT request_id, rel_raw.* FROM rel_raw JOIN request ON source = source_entity AND target = target_entity),
rel_top AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, direction
  ORDER BY {BY_TIME}, CASE direction WHEN 'SOURCE_TO_TARGET' THEN source_entity_id ELSE target_entity_id END,
  CASE direction WHEN 'SOURCE_TO_TARGET' THEN target_entity_id ELSE source_entity_id END) AS rn FROM rel) WHERE rn <= 50),
ev AS (SELECT request_id, l.* FROM ({laundering()}) l JOIN request ON subject = searched_entity),
ev_top AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, direction
  ORDER BY {BY_TIME}, {PARTIES}) AS rn FROM ev) WHERE rn <= 50),
ranked AS (SELECT *, row_number() OVER (ORDER BY laundering_transaction_count DESC, entity_id) AS place FROM ({COUNTS})),
best AS (SELECT request_id, ranked.* FROM ranked JOIN request
  ON intent = 'TOP_LAUNDERING_SENDERS' AND place <= least(greatest(coalesce(n, 5), 1), 20))
"""
BATCH = PATH.rstrip() + REQUESTS


def evidence(function):
    return lambda s, d: function(m.graph(s, d, m.FOR_WRITING), m.requests(s, d))


check("q9_relationship_requests", BATCH + "SELECT * FROM rel_top")(evidence(rq.relationship_evidence))
check("q9_laundering_requests", BATCH + "SELECT * FROM ev_top")(evidence(rq.laundering_evidence))


@check("q9_top_sender_requests", BATCH + """
SELECT request_id, entity_id, entity_name, laundering_transaction_count, currency, transaction_count, total_amount
FROM best JOIN (""" + TOTALS + ") USING (entity_id, entity_name)")
def q9_top(spark, d):
    rows = evidence(rq.top_sender_evidence)(spark, d)
    return rows.select("request_id", "entity_id", "entity_name", "laundering_transaction_count",
                       F.inline("totals_by_currency"))


EVIDENCE_COUNTS = """
SELECT request_id, count(*) AS n FROM (
  SELECT request_id FROM rel_top UNION ALL SELECT request_id FROM ev_top UNION ALL SELECT request_id FROM best)
GROUP BY request_id"""


@check("q9_answer_requests", BATCH + f"""
SELECT request_id, intent, CASE WHEN request_id = 20005 THEN 'two entity names are required' END AS error,
       coalesce(c.n, 1) AS rows, coalesce(c.n, 1) AS last_row
FROM request LEFT JOIN ({EVIDENCE_COUNTS}) c USING (request_id) WHERE c.n IS NOT NULL OR request_id = 20005""")
def q9(spark, d):
    """All requests in one job; row numbers of a request are consecutive."""
    rows = rq.answer_requests(m.graph(spark, d, m.FOR_WRITING), m.requests(spark, d))
    return rows.groupBy("request_id", "intent", "error").agg(
        F.count("*").alias("rows"), F.max("row_number").cast("bigint").alias("last_row"))


check("q9_request_status", BATCH + """
SELECT request_id, intent,
       CASE WHEN request_id = 20005 THEN 'ERROR' WHEN intent = 'UNSUPPORTED' THEN 'UNSUPPORTED' ELSE 'OK' END AS status,
       CASE WHEN request_id = 20005 THEN 'two entity names are required' END AS error,
       CASE WHEN intent = 'TOP_LAUNDERING_SENDERS' THEN least(greatest(coalesce(n, 5), 1), 20) END AS effective_top_n
FROM request""")(lambda s, d: rq.request_status(m.requests(s, d)))


def pack(spark, d):
    asked = m.requests(spark, d)
    return rq.evidence_pack(rq.answer_requests(m.graph(spark, d, m.FOR_WRITING), asked), asked)


@check("q10_evidence_counts", BATCH + f"""
SELECT request_id, coalesce(c.n, 0) AS evidence_row_count, least(coalesce(c.n, 0), 50) AS packed_rows
FROM request LEFT JOIN ({EVIDENCE_COUNTS}) c USING (request_id)""")
def q10_counts(spark, d):
    return pack(spark, d).select(
        "request_id", "evidence_row_count",
        F.coalesce(F.json_array_length("evidence"), F.lit(0)).cast("bigint").alias("packed_rows"))


check("q10_evidence_pack")(pack)
check("q11_flatten_evidence")(
    lambda s, d: rq.flatten_evidence(rq.answer_requests(m.graph(s, d, m.FOR_WRITING), m.requests(s, d))))


# --- values of evidence, of packs and of what is shown ---------------------------------------

REL_NUMBERED = f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY "timestamp" NULLS LAST,
  CASE direction WHEN 'SOURCE_TO_TARGET' THEN 0 ELSE 1 END, transaction_id, {ENDS}) AS row_number FROM rel_top"""
EV_NUMBERED = f"""
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY "timestamp" NULLS LAST,
  CASE direction WHEN 'OUTGOING' THEN 0 ELSE 1 END, transaction_id, {PARTIES}) AS row_number FROM ev_top"""


def answered(intent, columns):
    return lambda s, d: rq.answer_requests(m.graph(s, d, m.FOR_WRITING), m.requests(s, d)).filter(
        (F.col("intent") == intent) & F.col("error").isNull()).select(
            "request_id", F.col("row_number").cast("bigint").alias("row_number"), *columns)


check("q9_answered_relationships", BATCH + REL_NUMBERED)(answered(rq.RELATIONSHIP, r.RELATIONSHIP_COLUMNS))
check("q9_answered_laundering", BATCH + EV_NUMBERED)(answered(rq.LAUNDERING, r.LAUNDERING_COLUMNS))

_TRANSFER = "transaction_id string, timestamp timestamp_ntz, amount double, currency string, payment_format string, is_laundering boolean"
PACKED = {  # fields of the entries of each intent's JSON
    rq.RELATIONSHIP: "source_entity_id string, source_entity string, target_entity_id string, target_entity string, "
                     "direction string, " + _TRANSFER,
    rq.LAUNDERING: "searched_entity_id string, searched_entity string, direction string, searched_entity_bank string, "
                   "counterparty_id string, counterparty string, counterparty_bank string, " + _TRANSFER,
    rq.TOP_SENDERS: "entity_id string, entity_name string, laundering_transaction_count bigint, "
                    "totals_by_currency array<struct<currency:string,transaction_count:bigint,total_amount:double>>",
}


def unpacked(intent):
    """Entries of the packed JSON, parsed again, with their places."""
    def query(spark, d):
        parsed = pack(spark, d).filter(F.col("intent") == intent).select(
            "request_id", F.posexplode(F.from_json("evidence", f"array<struct<{_colons(PACKED[intent])}>>")).alias("at", "entry"))
        return parsed.select("request_id", (F.col("at") + 1).cast("bigint").alias("row_number"), "entry.*")

    return query


def _colons(schema):
    """A list of columns as the fields of a struct type."""
    return ",".join(p.strip().replace(" ", ":", 1) for p in schema.split(", "))


check("q10_packed_relationships", BATCH + f"SELECT * FROM ({REL_NUMBERED}) WHERE row_number <= 50")(unpacked(rq.RELATIONSHIP))
check("q10_packed_laundering", BATCH + f"SELECT * FROM ({EV_NUMBERED}) WHERE row_number <= 50")(unpacked(rq.LAUNDERING))

SENDER_VALUES = BATCH + """
SELECT request_id, place AS row_number, entity_id, entity_name, laundering_transaction_count, currency, transaction_count, total_amount
FROM best JOIN (""" + TOTALS + ") USING (entity_id, entity_name)"
_SENDER = ["request_id", "row_number", "entity_id", "entity_name", "laundering_transaction_count"]
check("q10_packed_senders", SENDER_VALUES)(
    lambda s, d: unpacked(rq.TOP_SENDERS)(s, d).select(*_SENDER, F.inline("totals_by_currency")))


@check("q11_shown_senders", SENDER_VALUES)
def q11_senders(spark, d):
    """Totals shown as JSON text, parsed again."""
    shown = rq.flatten_evidence(rq.answer_requests(m.graph(spark, d, m.FOR_WRITING), m.requests(spark, d)))
    totals = F.from_json("totals_by_currency", "array<struct<currency:string,transaction_count:bigint,total_amount:double>>")
    return shown.filter(F.col("intent") == rq.TOP_SENDERS).withColumn("row_number", F.col("row_number").cast("bigint")).select(
        *_SENDER, F.inline(totals))


check("q11_shown_relationships", BATCH + f"""
SELECT request_id, row_number, direction, transaction_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS time_shown, amount
FROM ({REL_NUMBERED})""")(
    lambda s, d: rq.flatten_evidence(rq.answer_requests(m.graph(s, d, m.FOR_WRITING), m.requests(s, d)))
    .filter(F.col("intent") == rq.RELATIONSHIP).filter(F.col("error").isNull())
    .select("request_id", F.col("row_number").cast("bigint").alias("row_number"), "direction", "transaction_id",
            F.col("timestamp").alias("time_shown"), "amount"))

check("q3_nested_values", GRAPH + f"SELECT t.* , c.laundering_transaction_count FROM ({top(5)}) c JOIN ({TOTALS}) t USING (entity_id, entity_name)")(
    lambda s, d: r.top_laundering_senders(m.graph(s, d), 5).select(
        "entity_id", "entity_name", "laundering_transaction_count", F.inline("totals_by_currency")))

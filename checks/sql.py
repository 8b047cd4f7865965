"""SQL building blocks: the mapping and the graph tables, written from their definition."""

ACC = """acc AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS account_number,
         CAST(c_nationkey AS BIGINT) AS bank_id, n_name AS bank_name,
         'E' || (c_custkey % 40) AS entity_id,
         'Corporation #' || ((c_custkey % 40) % 39) AS entity_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

KNOWN = """known AS (SELECT * FROM acc WHERE k % 25 <> 0)"""

DIRTY_ACC = """dacc AS (
  SELECT CAST(c_custkey AS VARCHAR) AS account_number, CAST(c_nationkey AS BIGINT) AS bank_id,
         CASE WHEN c_custkey % 25 <> 0 THEN n_name END AS bank_name, 'C' || c_custkey AS entity_id,
         CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 10 = 0 THEN '' ELSE c_name END AS entity_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS BIGINT), n_name, 'S' || s_suppkey, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _tx(name: str, time: str, receiver: str) -> str:
    return f"""{name} AS (
  SELECT {time} AS time_text, CAST(s.c_nationkey AS BIGINT) AS from_bank,
         CAST(o_custkey AS VARCHAR) AS from_number, CAST(r.c_nationkey AS BIGINT) AS to_bank,
         {receiver} AS to_number, l_quantity AS amount_received, l_linestatus AS receiving_currency,
         l_extendedprice AS amount_paid, o_orderstatus AS payment_currency,
         o_orderpriority AS payment_format, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer s ON s.c_custkey = o_custkey JOIN customer r ON r.c_custkey = l_suppkey)"""


_TIME = "strftime(l_shipdate, '%Y/%m/%d %H:%M')"
RAW = _tx("raw", _TIME, "CAST(l_suppkey AS VARCHAR)")
DIRTY_RAW = _tx(
    "raw",
    f"CASE WHEN l_tax = 0.08 AND l_quantity = 50 THEN 'not-a-time' ELSE {_TIME} END",
    "CASE WHEN NOT (l_linenumber = 7 AND l_quantity = 1) THEN CAST(l_suppkey AS VARCHAR) END",
)

TX = """tx AS (
  SELECT sha256(concat_ws('||', time_text, from_bank, from_number, to_bank, coalesce(to_number, '<NULL>'),
           CAST(CAST(amount_received AS DECIMAL(18,2)) AS VARCHAR), receiving_currency,
           CAST(CAST(amount_paid AS DECIMAL(18,2)) AS VARCHAR), payment_currency, payment_format,
           code)) AS transaction_id,
         try_strptime(time_text, '%Y/%m/%d %H:%M') AS "timestamp",
         from_bank || '|' || from_number AS from_account_key,
         to_bank || '|' || to_number AS to_account_key,
         amount_received, receiving_currency, amount_paid, payment_currency, payment_format,
         code = 1 AS is_laundering
  FROM raw)"""

PAIRS = """pairs AS (
  SELECT from_bank AS bank_id, from_number AS account_number FROM raw
  UNION SELECT to_bank, to_number FROM raw WHERE to_number IS NOT NULL)"""


def nodes(source: str = "acc", name: str = "node") -> str:
    return f"""{name} AS (
  SELECT p.bank_id || '|' || p.account_number AS account_key, p.account_number, p.bank_id,
         a.bank_name, a.entity_id, a.entity_name
  FROM pairs p LEFT JOIN {source} a ON a.bank_id = p.bank_id AND a.account_number = p.account_number)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# The clean graph: account nodes (with their one owner) and transactions.
GRAPH = with_(ACC, RAW, TX, PAIRS, nodes())
# Dirty transactions and account nodes without every 25th customer.
DIRTY = with_(ACC, KNOWN, DIRTY_RAW, TX, PAIRS, nodes("known", "all_node"),
              "node AS (SELECT * FROM all_node WHERE entity_id IS NOT NULL)")

# Whole paths: transaction with the owner of either end; one owner per account here, so the two
# ownership edges coincide exactly when the accounts do.
PATH = GRAPH.rstrip() + """,
path AS (
  SELECT t.*, t.amount_paid AS amount, t.payment_currency AS currency,
         s.entity_id AS s_id, s.entity_name AS s_name, s.bank_name AS s_bank,
         r.entity_id AS r_id, r.entity_name AS r_name, r.bank_name AS r_bank
  FROM tx t JOIN node s ON s.account_key = t.from_account_key
            JOIN node r ON r.account_key = t.to_account_key)
"""

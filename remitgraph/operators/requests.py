"""Many questions in one job: a table of requests in, evidence rows out.

Work is done once per different name or pair of names, and every name or pair is cut to its
first rows before it is matched to requests. A name that a third of all requests ask about, or
that a third of all transfers belong to, is therefore neither computed twice nor multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from remitgraph.functions import columns as c
from remitgraph.operators import retrieve as r
from remitgraph.plans.staging import stage, top_per_group, within_reach
from remitgraph.plans.tables import GraphTables

# The intents a request can carry.
RELATIONSHIP = "ENTITY_RELATIONSHIP"
LAUNDERING = "ENTITY_LAUNDERING_TRANSACTIONS"
TOP_SENDERS = "TOP_LAUNDERING_SENDERS"
UNSUPPORTED = "UNSUPPORTED"

SENDER_COLUMNS = [
    "entity_id", "entity_name", "laundering_transaction_count", "totals_by_currency",
]
INTENT_COLUMNS = {
    RELATIONSHIP: r.RELATIONSHIP_COLUMNS,
    LAUNDERING: r.LAUNDERING_COLUMNS,
    TOP_SENDERS: SENDER_COLUMNS,
}


REPEATED = "the request id is repeated"


def _repeated(requests: DataFrame) -> DataFrame:
    counts = requests.groupBy("request_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > 1).select("request_id")


def request_status(requests: DataFrame) -> DataFrame:
    """Per request: OK, UNSUPPORTED or ERROR, with the reason, and the effective ``top_n``.

    Requests that share an id are in error: their evidence could not be told apart.
    """
    intent = F.col("intent")
    repeated = _repeated(requests).select(F.col("request_id").alias("_id"), F.lit(True).alias("_repeated"))
    requests = requests.join(repeated, F.col("request_id").eqNullSafe(F.col("_id")), "left")
    two = c.missing("source_entity_name", trim=False) | c.missing("target_entity_name", trim=False)
    error = (
        F.when(F.col("_repeated"), REPEATED)
        .when((intent == RELATIONSHIP) & two, "two entity names are required")
        .when((intent == LAUNDERING) & c.missing("entity_name", trim=False), "an entity name is required")
        .when(~F.coalesce(intent.isin(*INTENT_COLUMNS, UNSUPPORTED), F.lit(False)), "unknown intent")
    )
    status = F.when(error.isNotNull(), "ERROR").when(intent == UNSUPPORTED, UNSUPPORTED).otherwise("OK")
    return requests.select(
        "request_id", "intent", status.alias("status"), error.alias("error"),
        F.when(intent == TOP_SENDERS, c.clamp("top_n")).alias("effective_top_n"),
    )


def _valid(requests: DataFrame, intent: str, *names: str) -> DataFrame:
    chosen = requests.filter(F.col("intent") == intent)
    for name in names:
        chosen = chosen.filter(~c.missing(name, trim=False))
    return chosen


def _pair_uses(requests: DataFrame) -> DataFrame:
    """Two rows per relationship request: the evidence of its pair forwards, of the swapped pair backwards."""
    def use(sender: str, receiver: str, forward: bool) -> Column:
        return F.struct(F.col(sender).alias("from_name"), F.col(receiver).alias("to_name"), F.lit(forward).alias("forward"))

    source, target = "source_entity_name", "target_entity_name"
    return _valid(requests, RELATIONSHIP, source, target).select(
        "request_id", F.inline(F.array(use(source, target, True), use(target, source, False))))


def _searched(requests: DataFrame) -> DataFrame:
    return _valid(requests, LAUNDERING, "entity_name").select("request_id", F.col("entity_name").alias("searched_entity"))


def asked_accounts(graph: GraphTables, requests: DataFrame) -> DataFrame:
    """The accounts of all entities that any request names, evaluated once for all intents."""
    names = _pair_uses(requests).select(F.col("from_name").alias("entity_name")).unionByName(
        _searched(requests).select(F.col("searched_entity").alias("entity_name"))).distinct()
    # An account has a key; saying so is the filter that lets joins with stored transfers prune buckets.
    return stage(r.owners(graph).join(names, "entity_name", "left_semi"), "asked-accounts").filter(F.col("account_key") > "")


def relationship_evidence(
    graph: GraphTables, requests: DataFrame, limit: int = r.MAX_ROWS, accounts: DataFrame | None = None
) -> DataFrame:
    """Both directions of every relationship request, each capped like a single question.

    Evidence depends on (sender name, receiver name) only: it is found and cut once for each such pair that
    is asked about, then given to all requests that use it. What the cut leaves is found from accounts and times
    first; whole transfers are joined only if they are among it.
    """
    uses = _pair_uses(requests)
    pairs = uses.select("from_name", "to_name").distinct()
    ends = asked_accounts(graph, requests) if accounts is None else accounts
    group, order = ["from_name", "to_name"], r.time_order("sender_entity_id", "receiver_entity_id")

    def hits(of: GraphTables) -> DataFrame:
        return r.between(of, ends).filter(r.distinct_ends()).join(
            pairs, (F.col("sender_entity_name") == pairs.from_name) & (F.col("receiver_entity_name") == pairs.to_name))

    few = r.only_reached(graph, hits(graph), group, limit)
    first = top_per_group(within_reach(hits(few), group, "timestamp", limit), group, order, limit)
    return first.join(uses, ["from_name", "to_name"]).select("request_id", *r.relationship_rows(F.col("forward")))


def laundering_evidence(
    graph: GraphTables, requests: DataFrame, limit: int = r.MAX_ROWS, accounts: DataFrame | None = None
) -> DataFrame:
    """Labelled transfers of every named entity asked about, capped per direction."""
    asked = _searched(requests)
    names = asked.select(F.col("searched_entity").alias("entity_name")).distinct()
    all_named = asked_accounts(graph, requests) if accounts is None else accounts
    first = r.first_laundering_rows(graph, all_named.join(names, "entity_name", "left_semi"), limit, many=True)
    return first.join(asked, "searched_entity").select("request_id", *r.LAUNDERING_COLUMNS)


def top_sender_evidence(graph: GraphTables, requests: DataFrame) -> DataFrame:
    """The ranking, computed once for the largest allowed n, cut to each request's own n."""
    asked = _valid(requests, TOP_SENDERS).select(
        "request_id", F.explode(F.sequence(F.lit(1), c.clamp("top_n"))).alias("place"))
    # At most MAX_SENDERS rows, in order; the position in the sorted list is the place.
    best = r.top_laundering_senders(graph, r.MAX_SENDERS)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("laundering_transaction_count")).alias("minus"), *SENDER_COLUMNS))).alias("all"))
    placed = ranked.select(F.posexplode("all").alias("at", "row")).select(
        (F.col("at") + 1).alias("place"), *[F.col(f"row.{n}").alias(n) for n in SENDER_COLUMNS])
    return asked.join(F.broadcast(placed), "place").select("request_id", *SENDER_COLUMNS)


def answer_requests(graph: GraphTables, requests: DataFrame) -> DataFrame:
    """Evidence for all requests, with the columns of every intent side by side.

    ``row_number`` counts the rows of a request in their final order. An invalid request gives one
    row with ``error`` set; an unsupported one, or one without matches, gives none. Requests that
    share an id give one row with ``error`` set and no intent.
    """
    requests = stage(requests, "requests")
    repeated = _repeated(requests)
    single = requests.join(repeated.withColumnRenamed("request_id", "_id"),
                           F.col("request_id").eqNullSafe(F.col("_id")), "left_anti")
    accounts = asked_accounts(graph, single)
    parts = {
        RELATIONSHIP: relationship_evidence(graph, single, accounts=accounts),
        LAUNDERING: laundering_evidence(graph, single, accounts=accounts),
        TOP_SENDERS: top_sender_evidence(graph, single),
    }
    errors = request_status(single).filter(F.col("status") == "ERROR")
    evidence = errors.select("request_id", "intent", "error").unionByName(repeated.select(
        "request_id", F.lit(None).cast("string").alias("intent"), F.lit(REPEATED).alias("error")))
    for intent, rows in parts.items():
        evidence = evidence.unionByName(rows.withColumn("intent", F.lit(intent)), allowMissingColumns=True)
    return _numbered(evidence)


def _numbered(evidence: DataFrame) -> DataFrame:
    # A request has at most 2 x 50 rows, so its window is small.
    branch = F.when(F.col("direction").isin(r.SOURCE_TO_TARGET, r.OUTGOING), 0).otherwise(1)
    order: list[Column] = [
        F.desc("laundering_transaction_count"), F.col("entity_id"),
        F.col("timestamp").asc_nulls_last(), branch, F.col("transaction_id"),
        *[F.col(n) for n in ("source_entity_id", "target_entity_id", *r.LAUNDERING_TIES)],
    ]
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return evidence.withColumn("row_number", place)


def evidence_pack(
    evidence: DataFrame, requests: DataFrame, most: int | None = r.MAX_ROWS
) -> DataFrame:
    """Per request: how many evidence rows there are, and the first of them as a JSON array.

    Requests without evidence get a count of 0 and an empty array. ``most=None`` packs every row;
    a request never has more than 100.
    """
    def as_json(names: list[str]) -> Column:
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    row = F.lit(None).cast("string")
    for intent, names in INTENT_COLUMNS.items():
        row = F.when((F.col("intent") == intent) & F.col("error").isNull(), as_json(names)).otherwise(row)
    packed_here = F.lit(True) if most is None else F.col("row_number") <= most
    rows = evidence.filter(F.col("error").isNull()).select(
        "request_id", F.when(packed_here, F.struct("row_number", row.alias("json"))).alias("entry"))
    packed = rows.groupBy("request_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("entry")).alias("entries"))
    text = F.concat(F.lit("["), F.array_join(F.col("entries.json"), ","), F.lit("]"))
    status = request_status(requests)
    return status.join(packed, "request_id", "left").select(
        "request_id", "intent", "status", "error",
        F.coalesce("n", F.lit(0)).alias("evidence_row_count"),
        F.coalesce(text, F.lit("[]")).alias("evidence"),
    )


def flatten_evidence(df: DataFrame) -> DataFrame:
    """For display: nested values as JSON text, times as text, everything else unchanged."""

    def shown(name: str, kind) -> Column:
        if isinstance(kind, (ArrayType, MapType, StructType)):
            return F.to_json(name, {"ignoreNullFields": "false"}).alias(name)
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            return F.col(name).cast("string").alias(name)
        return F.col(name)

    return df.select(*[shown(f.name, f.dataType) for f in df.schema])

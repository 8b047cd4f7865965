"""Graph-pattern questions over the tables of a graph.

A path entity - account - transaction - account - entity is answered from the transaction table,
which carries both account keys, so the two edges next to the transaction cost no join. Each
function scans the transactions once; the accounts of the named entities are evaluated first, so
that Spark knows how small they are when it picks the join.

One path may not use the same ownership edge at both ends: a transfer from an account to itself,
seen from one and the same owner, is no path. Where the two ends are found independently of each
other (``subject_transactions``, ``pair_transactions``, the sender counts) it does count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.functions import columns as c
from remitgraph.plans.staging import both_ways, stage, staged, top_per_group, within_reach
from remitgraph.plans.tables import OWNS, RECEIVED_BY, SENT, GraphTables

MAX_ROWS = 50
MAX_SENDERS = 20
OWNED, BANKED = ("from_owned", "to_owned"), ("from_banked", "to_banked")
LIMIT_MODES = ("per_branch", "last_branch", "combined")

# Names of the directions in results.
SOURCE_TO_TARGET, TARGET_TO_SOURCE = "SOURCE_TO_TARGET", "TARGET_TO_SOURCE"
OUTGOING, INCOMING = "OUTGOING", "INCOMING"

RELATIONSHIP_COLUMNS = [
    "source_entity_id", "source_entity", "target_entity_id", "target_entity", "direction",
    "transaction_id", "timestamp", "amount", "currency", "payment_format", "is_laundering",
]
LAUNDERING_COLUMNS = [
    "searched_entity_id", "searched_entity", "direction", "transaction_id", "timestamp", "amount",
    "currency", "payment_format", "searched_entity_bank", "counterparty_id", "counterparty",
    "counterparty_bank", "is_laundering",
]


def _flagged(*flags: str) -> Column:
    """A condition on stored transfers, see ``known_ends``."""
    return reduce(Column.__and__, [F.col(flag) for flag in flags])


def known_ends(graph: GraphTables) -> DataFrame:
    """Transactions with flags: whether each side has an owner and a bank, and whether two owners can be told apart.

    ``between_owners`` is false only for a transfer from an account to itself that has one owner.

    Accounts of transactions that do not have a bank and one owner are found first, from the different accounts. The
    transactions meet only these: as a rule few, and then no transaction is shuffled.
    """
    owned = owners(graph).select("account_key", "entity_id").distinct().groupBy("account_key").agg(
        (F.count("*") > 1).alias("several")).withColumn("owned", F.lit(True))
    banked = account_banks(graph).select("account_key").distinct().withColumn("banked", F.lit(True))
    known = owned.join(banked, "account_key", "full_outer")
    rows, columns = graph.transactions, graph.transactions.columns
    used = rows.select(F.explode(F.array("from_account_key", "to_account_key")).alias("account_key")).distinct()
    facts = {n: F.coalesce(n, F.lit(False)) for n in ("owned", "banked", "several")}
    unusual = stage(used.dropna().join(known, "account_key", "left").withColumns(facts).filter(
        ~F.col("owned") | ~F.col("banked") | F.col("several")), "unusual-accounts")
    for side in ("from", "to"):
        found = unusual.select(*[F.col(n).alias(f"_{side}_{n}") for n in unusual.columns])
        rows = rows.join(found, F.col(f"{side}_account_key") == F.col(f"_{side}_account_key"), "left")
    several = F.coalesce("_from_several", F.lit(False))
    flags = {f"{side}_{n}": F.coalesce(f"_{side}_{n}", F.col(f"{side}_account_key").isNotNull())
             for side in ("from", "to") for n in ("owned", "banked")}
    flags["between_owners"] = ~F.col("from_account_key").eqNullSafe(F.col("to_account_key")) | several
    return rows.select(*[n for n in columns if n not in flags], *[flag.alias(n) for n, flag in flags.items()])


def time_order(*ties: str) -> list[Column]:
    """By time, nulls last, then by id and the given columns: a total order over result rows."""
    return [F.col("timestamp").asc_nulls_last(), F.col("transaction_id"), *[F.col(t) for t in ties]]


def transfers(graph: GraphTables, where: Column | None = None, *more: Column) -> DataFrame:
    """The columns of the transactions that questions are answered from."""
    rows = graph.transactions if where is None else graph.transactions.filter(where)
    return rows.select(
        "transaction_id", "timestamp", "from_account_key", "to_account_key",
        F.col("amount_paid").alias("amount"), F.col("payment_currency").alias("currency"),
        "payment_format", "is_laundering", *more,
    )


def owners(graph: GraphTables) -> DataFrame:
    """Rows ``(account_key, entity_id, entity_name)``: an account and an entity that owns it."""
    if graph.account_owners is not None:
        return graph.account_owners
    named = graph.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return graph.owns.join(named, "entity_id").select("account_key", "entity_id", "entity_name")


def account_banks(graph: GraphTables) -> DataFrame:
    """Rows ``(account_key, bank_name)``: an account and a bank that holds it."""
    if graph.account_banks is not None:
        return graph.account_banks
    banks = graph.banks.select("bank_id", F.col("name").alias("bank_name"))
    return graph.held_at.join(banks, "bank_id").select("account_key", "bank_name")


def named_accounts(graph: GraphTables, names: list[str], any_case: bool = False) -> DataFrame:
    """Accounts of all entities that bear one of the names, evaluated once.

    The condition is stated again on what was evaluated: a filter on this side is what lets a join with
    stored transfers prune their buckets at run time.
    """
    if any_case:
        wanted = F.lower("entity_name").isin([n.lower() for n in names])
    else:
        wanted = F.col("entity_name").isin(names)
    return stage(owners(graph).filter(wanted), "named-accounts").filter(wanted)


def account_bucket(account_key: Column | str, buckets: int) -> Column:
    """The bucket of a stored transaction, by one of its accounts."""
    return F.pmod(F.xxhash64(account_key), F.lit(buckets)).cast("int")


def bucketed_transfers(graph: GraphTables, side: str = "sender", where: Column | None = None) -> DataFrame:
    """Transfers with their ``bucket``, the folder they are stored in by that account; null if not stored so.

    ``receiver`` are the labelled transfers only, in a copy laid out by the receiving account.
    """
    if graph.sender_buckets is None:
        return transfers(graph, where).withColumn("bucket", F.lit(None).cast("int"))
    rows = graph.transactions if side == "sender" else graph.labelled_received
    return transfers(graph.with_(transactions=rows), where, F.col(f"{side}_bucket").alias("bucket"))


def _at(graph: GraphTables, end: str, account: str) -> Column:
    """Whether an end of a transfer is an account; of a stored graph only that account's bucket is looked into.

    Where the accounts are few enough to be broadcast, Spark reads no other buckets (dynamic partition
    pruning); no key and no bucket comes to the driver.
    """
    same = F.col(end) == F.col(account)
    if graph.sender_buckets is None:
        return same
    return same & (F.col("bucket") == account_bucket(F.col(account), graph.sender_buckets))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({name: f"{prefix}_{name}" for name in df.columns})


def _with_ends(rows: DataFrame, senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """Attach an owner frame to each side, as ``sender_*`` and ``receiver_*``."""
    s, r = prefixed(senders, "sender"), prefixed(receivers, "receiver")
    return rows.join(s, F.col("from_account_key") == F.col("sender_account_key")).join(
        r, F.col("to_account_key") == F.col("receiver_account_key")
    )


def between(graph: GraphTables, ends: DataFrame) -> DataFrame:
    """Transfers whose sender and receiver both are among the evaluated accounts."""
    s, r = prefixed(ends, "sender"), prefixed(ends, "receiver")
    sent = bucketed_transfers(graph).join(s, _at(graph, "from_account_key", "sender_account_key"))
    return sent.drop("bucket").join(r, F.col("to_account_key") == F.col("receiver_account_key"))


def distinct_ends() -> Column:
    """False for a self-transfer whose two ends are the same owner."""
    return ~(
        (F.col("from_account_key") == F.col("to_account_key"))
        & (F.col("sender_entity_id") == F.col("receiver_entity_id"))
    )


def relationship_rows(forward: Column) -> list[Column]:
    """Result columns of a transfer between two entities; ``forward``: the source is the sender."""

    def end(of_source: bool, field: str) -> Column:
        sender, receiver = F.col(f"sender_entity_{field}"), F.col(f"receiver_entity_{field}")
        return F.when(forward, sender if of_source else receiver).otherwise(
            receiver if of_source else sender
        )

    return [
        end(True, "id").alias("source_entity_id"), end(True, "name").alias("source_entity"),
        end(False, "id").alias("target_entity_id"), end(False, "name").alias("target_entity"),
        F.when(forward, SOURCE_TO_TARGET).otherwise(TARGET_TO_SOURCE).alias("direction"),
        "transaction_id", "timestamp", "amount", "currency", "payment_format", "is_laundering",
    ]


def _limited(
    rows: DataFrame, branches: tuple[str, str], ties: list[str], limit: int | None, mode: str
) -> DataFrame:
    """Apply a limit to the two directions of a result and put it in time order."""
    if mode not in LIMIT_MODES:
        raise ValueError(f"limit_mode must be one of {LIMIT_MODES}")
    order = time_order(*ties)
    branch = F.when(F.col("direction") == branches[0], 0).otherwise(1)
    final = [F.col("timestamp").asc_nulls_last(), branch, *order[1:]]
    if limit is None:
        return rows.orderBy(*final)
    if mode == "combined":
        return rows.orderBy(*final).limit(limit)
    if mode == "per_branch":
        # Two directions of at most ``limit`` rows: the bound makes the last step a top-k.
        first = top_per_group(rows, ["direction"], order, limit).drop("row_number")
        return first.orderBy(*final).limit(2 * limit)
    first = rows.filter(F.col("direction") == branches[0])
    last = rows.filter(F.col("direction") == branches[1]).orderBy(*order).limit(limit)
    return first.unionByName(last).orderBy(*final)


def entity_relationship(
    graph: GraphTables, source: str, target: str,
    limit: int | None = MAX_ROWS, limit_mode: str = "per_branch",
) -> DataFrame:
    """Direct transfers between two named entities, in both directions.

    With the same name on both sides every transfer appears once per direction. ``limit_mode``:
    ``per_branch`` caps each direction, ``last_branch`` only the second, ``combined`` the whole.
    """
    found = named_accounts(graph, [source, target])
    ends = found.withColumn("role", F.explode(F.array_compact(F.array(
        F.when(F.col("entity_name") == source, "source"),
        F.when(F.col("entity_name") == target, "target"),
    ))))
    hits = between(graph, ends).filter(
        (F.col("sender_role") != F.col("receiver_role")) & distinct_ends()
    )
    rows = hits.select(*relationship_rows(F.col("sender_role") == "source"))
    ties = ["source_entity_id", "target_entity_id"]
    return _limited(rows, (SOURCE_TO_TARGET, TARGET_TO_SOURCE), ties, limit, limit_mode)


def subject_sides(rows: DataFrame) -> DataFrame:
    """Every transfer seen from its sender (OUTGOING) and from its receiver (INCOMING)."""

    def side(direction: str, subject: str, other: str) -> Column:
        return F.struct(
            F.lit(direction).alias("direction"),
            F.col(subject).alias("subject_account"), F.col(other).alias("other_account"),
        )

    return both_ways(rows, [
        side(OUTGOING, "from_account_key", "to_account_key"),
        side(INCOMING, "to_account_key", "from_account_key"),
    ])


def laundering_paths(graph: GraphTables, subjects: DataFrame, where: Column | None = None) -> DataFrame:
    """Labelled transfers of the subjects, one row per direction, before banks and counterparty.

    Of a stored graph each direction is read from the copy that is laid out by the subject's side, so both
    read only the subjects' buckets; other tables are scanned once for both directions.
    ``subjects`` holds ``account_key, entity_id, entity_name``; ``where`` is a further condition.
    """
    chosen = F.col("is_laundering") if where is None else F.col("is_laundering") & where
    s = prefixed(subjects, "subject")
    if graph.sender_buckets is None:
        sides = subject_sides(transfers(graph, chosen))
        return sides.join(s, F.col("subject_account") == F.col("subject_account_key"))
    found = []
    for side, direction, own, other in (("sender", OUTGOING, "from_account_key", "to_account_key"),
                                        ("receiver", INCOMING, "to_account_key", "from_account_key")):
        rows = bucketed_transfers(graph, side, chosen).join(s, _at(graph, own, "subject_account_key"))
        found.append(rows.drop("bucket").withColumns({
            "direction": F.lit(direction), "subject_account": F.col(own), "other_account": F.col(other)}))
    return found[0].unionByName(found[1])


def only_reached(graph: GraphTables, rows: DataFrame, group: list[str], limit: int) -> GraphTables:
    """The graph with the transfers that may be among the first ``limit`` rows of a group by time, and few others.

    ``rows`` are made of its transfers. What may be among the first is found from accounts and times alone, which
    are staged; whole transfers, ids included, then meet what was found, as a rule so little that none is shuffled.
    """
    ends = ["from_account_key", "to_account_key", "timestamp"]
    with staged(rows.select(*group, *ends), "narrow") as narrow:
        near = within_reach(narrow, group, "timestamp", limit).select(*[F.col(n).alias(f"_{n}") for n in ends])
        few = stage(near.distinct(), "reached")
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in ends])
    return graph.with_(transactions=stage(graph.transactions.join(few, same, "left_semi"), "reached-transfers"))


def attach_parties(graph: GraphTables, paths: DataFrame, few: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add both banks and the owner of the other side; yields the result columns, and those to ``keep``.

    With ``few`` (a staged, small set of paths) the account lookups are first reduced to the
    accounts on the paths, by a semi join that only scans them: nothing of their size is shuffled.
    """
    other, banks = owners(graph), account_banks(graph)
    if few:
        sides = [paths.select(F.col(n).alias("account_key")) for n in ("other_account", "subject_account")]
        other = other.join(sides[0], "account_key", "left_semi")
        banks = banks.join(sides[0].unionByName(sides[1]), "account_key", "left_semi")
    other, bank, own_bank = prefixed(other, "other"), prefixed(banks, "bank"), prefixed(banks, "own")
    joined = (
        paths.join(own_bank, F.col("subject_account") == F.col("own_account_key"))  # first: paths come by subject
        .join(other, F.col("other_account") == F.col("other_account_key"))
        .join(bank, F.col("other_account") == F.col("bank_account_key"))
        .filter(~(
            (F.col("subject_account") == F.col("other_account"))
            & (F.col("subject_entity_id") == F.col("other_entity_id"))
        ))
    )
    return joined.select(
        F.col("subject_entity_id").alias("searched_entity_id"),
        F.col("subject_entity_name").alias("searched_entity"),
        "direction", "transaction_id", "timestamp", "amount", "currency", "payment_format",
        F.col("own_bank_name").alias("searched_entity_bank"),
        F.col("other_entity_id").alias("counterparty_id"),
        F.col("other_entity_name").alias("counterparty"),
        F.col("bank_bank_name").alias("counterparty_bank"),
        "is_laundering", *keep,
    )


LAUNDERING_TIES = [
    "searched_entity_id", "counterparty_id", "searched_entity_bank", "counterparty_bank",
]
LAUNDERING_GROUP = ["searched_entity", "direction"]


def first_laundering_rows(graph: GraphTables, subjects: DataFrame, limit: int, many: bool = False) -> DataFrame:
    """The first ``limit`` result rows per searched name and direction; exact.

    With ``many`` names rows are cut to those that can be among them, by a pass more, before they are sorted; of a
    graph that is not stored also before they are shuffled with all that belongs to them.

    A stored graph knows which transfers have both ends: each of their paths gives at least one row,
    and rows are in the order of their paths first. So the first ``limit`` paths of a group, equal
    ones included, hold its first ``limit`` rows, and only these meet the account tables.
    """
    if graph.stored:
        first = Window.partitionBy("subject_entity_name", "direction").orderBy(*time_order("subject_entity_id"))
        paths = laundering_paths(graph, subjects, _flagged(*OWNED, *BANKED, "between_owners"))
        if many:
            paths = within_reach(paths, ["subject_entity_name", "direction"], "timestamp", limit)
        paths = paths.withColumn("place", F.rank().over(first)).filter(F.col("place") <= limit).drop("place")
        rows = attach_parties(graph, stage(paths, "paths"), few=True)
    else:
        if many:
            own, other = F.col("subject_account"), F.col("other_account")
            narrow = attach_parties(graph, laundering_paths(graph, subjects), keep=("subject_account", "other_account"))
            outgoing = F.col("direction") == OUTGOING
            graph = only_reached(graph, narrow.withColumns({
                "from_account_key": F.when(outgoing, own).otherwise(other),
                "to_account_key": F.when(outgoing, other).otherwise(own)}), LAUNDERING_GROUP, limit)
        rows = attach_parties(graph, laundering_paths(graph, subjects))
        if many:
            rows = within_reach(rows, LAUNDERING_GROUP, "timestamp", limit)
    first_rows = top_per_group(rows, LAUNDERING_GROUP, time_order(*LAUNDERING_TIES), limit)
    return first_rows.select(*LAUNDERING_COLUMNS)


def labelled(graph: GraphTables) -> DataFrame:
    return transfers(graph, F.col("is_laundering"))


def entity_laundering(
    graph: GraphTables, name: str,
    limit: int | None = MAX_ROWS, limit_mode: str = "per_branch",
) -> DataFrame:
    """Labelled transfers out of and into one named entity, with counterparty and both banks."""
    subjects = named_accounts(graph, [name])
    if limit is not None and limit_mode == "per_branch":
        rows = first_laundering_rows(graph, subjects, limit)
    else:
        rows = attach_parties(graph, laundering_paths(graph, subjects))
    return _limited(rows, (OUTGOING, INCOMING), LAUNDERING_TIES, limit, limit_mode)


def sender_totals(graph: GraphTables) -> DataFrame:
    """Labelled transfers sent, per entity and currency.

    Transfers are first reduced to one row per account and currency, so the join to the owners is
    free of hot accounts and as small as the accounts are.
    """
    per_account = labelled(graph).groupBy(
        "from_account_key", "currency"
    ).agg(F.count("*").alias("n"), F.sum(F.col("amount").try_cast(c.MONEY)).alias("amount"))
    owned = per_account.join(owners(graph), F.col("from_account_key") == F.col("account_key"))
    return owned.groupBy("entity_id", "entity_name", "currency").agg(
        F.sum("n").alias("transaction_count"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total_amount"),
    )


def top_senders_simple(graph: GraphTables, n: int = 5) -> DataFrame:
    per_account = labelled(graph).groupBy("from_account_key").agg(
        F.count("*").alias("n"))
    owned = per_account.join(owners(graph), F.col("from_account_key") == F.col("account_key"))
    counts = owned.groupBy("entity_id", "entity_name").agg(
        F.sum("n").alias("laundering_transaction_count"))
    return counts.orderBy(F.desc("laundering_transaction_count"), "entity_id").limit(n)


def top_senders_by_currency(graph: GraphTables, top_n: int | None = 5) -> DataFrame:
    """One row per currency of each of the top senders, with the sender's rank."""
    return top_laundering_senders(graph, top_n).select(
        "entity_id", "entity_name", "laundering_transaction_count", F.inline("totals_by_currency"))


def top_laundering_senders(graph: GraphTables, top_n: int | None = 5) -> DataFrame:
    """Top senders of labelled transfers, each with a list of per-currency totals.

    ``top_n`` is brought into 1..20, default 5. An entity's list has an entry per currency, so it is
    short; carrying it along spares a second scan for the chosen entities.
    """
    n = min(max(5 if top_n is None else top_n, 1), MAX_SENDERS)
    entry = F.struct("currency", "transaction_count", "total_amount")
    senders = sender_totals(graph).groupBy("entity_id", "entity_name").agg(
        F.sum("transaction_count").alias("laundering_transaction_count"),
        F.array_sort(F.collect_list(entry)).alias("totals_by_currency"))
    return senders.orderBy(F.desc("laundering_transaction_count"), "entity_id").limit(n)


def _capped(limit: int | None) -> int:
    return MAX_ROWS if limit is None else min(limit, MAX_ROWS)


def subject_transactions(graph: GraphTables, name: str, limit: int | None = MAX_ROWS) -> DataFrame:
    """Labelled transfers that touch an account of the entity; the name matches in any case.

    A transfer between two accounts of the entity appears once for each; a transfer from an
    account to itself once, as OUTGOING. At most 50 rows.
    """
    subjects = named_accounts(graph, [name], any_case=True)
    seen = laundering_paths(graph, subjects, _flagged(*OWNED) if graph.stored else None).filter(
        (F.col("direction") == OUTGOING) | (F.col("from_account_key") != F.col("to_account_key")))
    ties = ["direction", "subject_entity_id", "sender_entity_id", "receiver_entity_id"]
    if graph.stored:  # as in first_laundering_rows: the first paths hold the first rows
        seen = stage(seen.orderBy(*time_order(*ties[:2])).limit(_capped(limit)), "paths")
        ends = _owners_of(graph, seen)
    else:
        ends = owners(graph)
    rows = _with_ends(seen, ends, ends)
    return rows.orderBy(*time_order(*ties)).limit(_capped(limit)).select(
        F.col("subject_entity_id").alias("searched_entity_id"),
        F.col("subject_entity_name").alias("searched_entity"),
        "direction", "transaction_id", "timestamp", "amount", "currency",
        F.col("sender_entity_name").alias("sender_entity"),
        F.col("receiver_entity_name").alias("receiver_entity"),
    )


def pair_rows(graph: GraphTables, a: str, b: str) -> DataFrame:
    """Transfers either way between accounts of two entities; names match in any case.

    An either-way condition would compare every pair of rows. Here each end is matched to both
    roles by an equality join and the roles must differ, so both directions come out of one scan.
    A transfer from an account to itself satisfies both directions at once and is kept once, as
    SOURCE_TO_TARGET.
    """
    found = named_accounts(graph, [a, b], any_case=True)
    ends = found.withColumn("role", F.explode(F.array_compact(F.array(
        F.when(c.same_name("entity_name", F.lit(a)), "source"),
        F.when(c.same_name("entity_name", F.lit(b)), "target"),
    ))))
    forward = F.col("sender_role") == "source"
    hits = between(graph, ends).filter(
        (F.col("sender_role") != F.col("receiver_role"))
        & (forward | (F.col("from_account_key") != F.col("to_account_key")))
    )
    return hits.select(*relationship_rows(forward))


def pair_transactions(graph: GraphTables, a: str, b: str, limit: int | None = MAX_ROWS) -> DataFrame:
    """The first of ``pair_rows`` by time. At most 50 rows."""
    order = time_order("direction", "source_entity_id", "target_entity_id")
    return pair_rows(graph, a, b).orderBy(*order).limit(_capped(limit)).drop(
        "source_entity_id", "target_entity_id")


def _owners_of(graph: GraphTables, few: DataFrame) -> DataFrame:
    """Owners of the accounts of a few staged transfers; the owner table is only scanned."""
    keys = few.select(F.explode(F.array("from_account_key", "to_account_key")).alias("account_key"))
    return owners(graph).join(keys, "account_key", "left_semi")


def entity_paths(graph: GraphTables, few: DataFrame | None = None) -> DataFrame:
    """Every entity - account - transaction - account - entity path, or those of a few staged transfers."""
    ends = owners(graph) if few is None else _owners_of(graph, few)
    return _with_ends(transfers(graph) if few is None else few, ends, ends).filter(distinct_ends())


def transaction_paths(graph: GraphTables, n: int = 10) -> DataFrame:
    """The first n whole paths by transaction id, as nested nodes plus the edge types.

    Of a stored graph the first n transfers that have owners at both ends are enough: ids are unique
    there, and each of these gives at least one path.
    """
    order = ["transaction_id", "sender_entity_id", "receiver_entity_id"]
    few = None
    if graph.stored:
        whole = transfers(graph, _flagged(*OWNED, "between_owners"))
        few = stage(whole.orderBy("transaction_id").limit(n), "transfers")
    paths = entity_paths(graph, few)
    node = {
        "sender_entity": F.struct(F.col("sender_entity_id").alias("id"), F.col("sender_entity_name").alias("name")),
        "sender_account": F.struct(F.col("from_account_key").alias("account_key")),
        "transaction": F.struct("transaction_id", "timestamp", "amount", "currency", "payment_format", "is_laundering"),
        "receiver_account": F.struct(F.col("to_account_key").alias("account_key")),
        "receiver_entity": F.struct(F.col("receiver_entity_id").alias("id"), F.col("receiver_entity_name").alias("name")),
    }
    types = F.array(*[F.lit(t) for t in (OWNS, SENT, RECEIVED_BY, OWNS)])
    return paths.orderBy(*order).limit(n).select(
        *[x.alias(name) for name, x in node.items()], types.alias("relationships"))


def entity_count(graph: GraphTables) -> DataFrame:
    return graph.entities.agg(F.count("id").alias("entity_count"))



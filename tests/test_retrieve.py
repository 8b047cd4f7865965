import pytest
from graph_fixture import C, P, at, hand_made
from pyspark.sql import functions as F

from remitgraph.operators import retrieve as r
from remitgraph.sources import store


@pytest.fixture(scope="module")
def graph(spark):
    return hand_made(spark)


def ids(df, *extra):
    return [tuple(x) if extra else x[0] for x in df.select("transaction_id", *extra).collect()]


def test_relationship_answers_the_known_question(graph):
    got = r.entity_relationship(graph, P, C).collect()
    first = got[0].asDict()
    assert first == {
        "source_entity_id": "800CD3AC0", "source_entity": P, "target_entity_id": "8006ABC00", "target_entity": C,
        "direction": "SOURCE_TO_TARGET", "transaction_id": "t01", "timestamp": at(3), "amount": 101.5,
        "currency": "Euro", "payment_format": "Cheque", "is_laundering": True}
    # Ties in time: first direction first. A missing time is last.
    assert [x.transaction_id for x in got] == ["t01", "t03", "t02"]


def test_swapping_the_names_swaps_the_direction(graph, rows):
    there, back = (r.entity_relationship(graph, a, b, limit=None) for a, b in ((P, C), (C, P)))
    swapped = back.select(
        F.col("target_entity_id"), F.col("target_entity"), F.col("source_entity_id"), F.col("source_entity"),
        F.when(F.col("direction") == "SOURCE_TO_TARGET", "TARGET_TO_SOURCE").otherwise("SOURCE_TO_TARGET"),
        *there.columns[5:])
    assert rows(there) == rows(swapped)


def test_same_name_gives_every_transfer_in_both_directions(graph, rows):
    got = rows(r.entity_relationship(graph, P, P).select("transaction_id", "direction"))
    # t05 uses one ownership edge twice. t04 does too for its only owner of this name.
    assert got == [(t, d) for t in ("t06", "t10") for d in ("SOURCE_TO_TARGET", "TARGET_TO_SOURCE")]


def test_self_transfer_between_two_owners_is_a_path(graph, rows):
    got = rows(r.entity_relationship(graph, P, "Shared Owner").select("transaction_id", "direction"))
    assert ("t04", "SOURCE_TO_TARGET") in got and ("t04", "TARGET_TO_SOURCE") in got
    assert not [x for x in got if x[0] == "t05"]


def test_limit_modes(graph):
    def count(mode, limit):
        got = r.entity_relationship(graph, C, P, limit=limit, limit_mode=mode).groupBy("direction").count().collect()
        return {x.direction: x["count"] for x in got}

    assert count("per_branch", 1) == {"SOURCE_TO_TARGET": 1, "TARGET_TO_SOURCE": 1}
    assert count("last_branch", 1) == {"SOURCE_TO_TARGET": 2, "TARGET_TO_SOURCE": 1}
    assert sum(count("combined", 1).values()) == 1
    with pytest.raises(ValueError, match="limit_mode"):
        r.entity_relationship(graph, P, C, limit_mode="other")


def test_unknown_name_gives_no_rows(graph):
    assert r.entity_relationship(graph, "Nobody", C).isEmpty()
    assert r.entity_laundering(graph, "Nobody").isEmpty()


def test_laundering_needs_both_banks_and_skips_self_paths(graph, rows):
    got = rows(r.entity_laundering(graph, P).select("transaction_id", "direction", "counterparty_id"))
    assert got == [
        ("t01", "OUTGOING", "8006ABC00"), ("t03", "INCOMING", "8006ABC00"),
        ("t04", "INCOMING", "E3"), ("t04", "OUTGOING", "E3"),
        ("t06", "INCOMING", "800CD3AC0"), ("t06", "OUTGOING", "E4"),
        ("t10", "INCOMING", "800CD3AC0"), ("t10", "OUTGOING", "800CD3AC0"), ("t10", "OUTGOING", "E3"),
    ]
    # A bank without a name is still a bank.
    assert r.entity_laundering(graph, P).filter("transaction_id = 't01'").first().counterparty_bank is None


@pytest.fixture(scope="module")
def stored(graph, tmp_path_factory):
    return store.write_graph(graph, str(tmp_path_factory.mktemp("stored") / "g"), buckets=2)


@pytest.mark.parametrize("limit", [1, 2, 3, 50])
def test_first_paths_hold_the_first_rows(graph, stored, rows, limit):
    whole = r.entity_laundering(graph, P, limit=None)
    expected = r._limited(whole, ("OUTGOING", "INCOMING"), r.LAUNDERING_TIES, limit, "per_branch")
    for form in (graph, stored):
        assert rows(r.entity_laundering(form, P, limit=limit)) == rows(expected)
    for name in (P.lower(), C, "Shared Owner"):
        assert rows(r.subject_transactions(stored, name, limit)) == rows(r.subject_transactions(graph, name, limit))
    assert r.transaction_paths(stored, limit).collect() == r.transaction_paths(graph, limit).collect()


def test_a_stored_graph_knows_the_ends_of_its_transfers(stored):
    got = {x.transaction_id: x for x in stored.transactions.collect()}
    assert [i for i, x in sorted(got.items()) if not x.between_owners] == ["t05", "t11"]
    assert not got["t09"].from_owned and got["t09"].to_owned
    assert got["t08"].to_owned and not got["t08"].to_banked


def test_top_senders_count_self_transfers_and_total_nulls_as_zero(graph):
    got = {x.entity_id: x for x in r.top_laundering_senders(graph, 20).collect()}
    # p: t01 t05 t06 t08 t10, joint: t04.
    assert got["800CD3AC0"].laundering_transaction_count == 6
    assert [tuple(x) for x in got["E5"].totals_by_currency] == [("Euro", 1, 0.0)]
    assert [tuple(x) for x in got["8006ABC00"].totals_by_currency] == [("Yen", 1, 3.0)]


def test_top_senders_order_and_clamp(graph):
    order = [x.entity_id for x in r.top_laundering_senders(graph, 20).collect()]
    assert order == ["800CD3AC0", "8006ABC00", "E3", "E5"]
    assert r.top_laundering_senders(graph, 0).count() == 1
    assert r.top_laundering_senders(graph, None).count() == 4
    assert [x.entity_id for x in r.top_senders_simple(graph, 2).collect()] == order[:2]


def test_subject_search(graph, rows):
    got = rows(r.subject_transactions(graph, P.lower()).select("transaction_id", "direction", "sender_entity", "receiver_entity"))
    assert ("t05", "OUTGOING", P, P) in got and ("t05", "INCOMING", P, P) not in got
    assert {x[1] for x in got if x[0] == "t10"} == {"OUTGOING", "INCOMING"}
    # A joint account is shown once per owner.
    assert {x[2:] for x in got if x[0] == "t10"} == {(P, P), (P, "Shared Owner")}
    assert "t08" in {x[0] for x in got}


def test_pair_search_keeps_self_transfers_once(graph, rows):
    got = rows(r.pair_transactions(graph, P.upper(), "shared owner").select("transaction_id", "direction"))
    assert [x for x in got if x[0] == "t04"] == [("t04", "SOURCE_TO_TARGET")]
    assert ("t08", "SOURCE_TO_TARGET") in got
    assert r.pair_transactions(graph, P, C, limit=1).count() == 1


def test_paths(graph):
    got = r.transaction_paths(graph, 3).collect()
    assert [x.transaction.transaction_id for x in got] == ["t01", "t02", "t03"]
    assert got[0].relationships == ["OWNS", "SENT", "RECEIVED_BY", "OWNS"]
    assert got[0].sender_entity.name == P and got[0].receiver_account.account_key == "2|c"


def test_paths_fall_back_to_all_transactions(spark, graph):
    """The first few hundred transactions have no path at all."""
    lost = graph.transactions.limit(1).drop("transaction_id", "from_account_key").crossJoin(spark.range(300)).select(
        F.format_string("a%03d", "id").alias("transaction_id"), F.lit("x").alias("from_account_key"),
        *[c for c in graph.transactions.columns if c not in ("transaction_id", "from_account_key")])
    more = graph.with_(transactions=graph.transactions.unionByName(lost))
    got = r.transaction_paths(more, 2).collect()
    assert [x.transaction.transaction_id for x in got] == ["t01", "t02"]


def test_outgoing_rows_match_the_labelled_transfers(graph):
    """One owner per account, all accounts at a bank: labelled transfers less self-transfers."""
    single = graph.with_(
        owns=graph.owns.filter("NOT (entity_id = 'E3' AND account_key = '1|joint')"),
        transactions=graph.transactions.filter(
            "from_account_key <> '9|unknown' AND to_account_key <> '5|nobank' AND is_laundering"))
    names = [x.name for x in single.entities.filter("name IS NOT NULL").select("name").distinct().collect()]
    out = sum(r.entity_laundering(single, n, limit=None).filter("direction = 'OUTGOING'").count() for n in names)
    plain = single.transactions.filter("from_account_key <> to_account_key").count()
    assert out == plain


def test_entity_count(graph):
    assert r.entity_count(graph).first().entity_count == 6

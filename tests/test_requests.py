import json

import pytest
from graph_fixture import C, P, hand_made

from remitgraph.operators import requests as rq
from remitgraph.operators import retrieve as r
from remitgraph.plans.tables import REQUEST_SCHEMA


@pytest.fixture(scope="module")
def graph(spark):
    return hand_made(spark)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([
        (1, "ENTITY_RELATIONSHIP", P, C, None, None),
        (2, "ENTITY_LAUNDERING_TRANSACTIONS", None, None, P, None),
        (3, "TOP_LAUNDERING_SENDERS", None, None, None, 5),
        (4, "UNSUPPORTED", None, None, None, None),
        (5, "ENTITY_RELATIONSHIP", P, None, None, None),
        (6, "ENTITY_LAUNDERING_TRANSACTIONS", None, None, "", None),
        (7, "SOMETHING", None, None, None, None),
        (8, "ENTITY_RELATIONSHIP", P, P, None, None),
        (9, "ENTITY_RELATIONSHIP", C, P, None, None),
        (10, "ENTITY_RELATIONSHIP", P, C, None, None),
        (11, "ENTITY_LAUNDERING_TRANSACTIONS", None, None, "Nobody", None),
        (12, "TOP_LAUNDERING_SENDERS", None, None, None, 1),
        (13, None, None, None, None, None),
    ], REQUEST_SCHEMA)


@pytest.fixture(scope="module")
def evidence(graph, asked):
    return rq.answer_requests(graph, asked)


def of(evidence, i, columns):
    return [tuple(x) for x in evidence.filter(f"request_id = {i}").orderBy("row_number").select(*columns).collect()]


@pytest.mark.parametrize("i, single", [
    (1, lambda g: r.entity_relationship(g, P, C)), (8, lambda g: r.entity_relationship(g, P, P)),
    (9, lambda g: r.entity_relationship(g, C, P)), (10, lambda g: r.entity_relationship(g, P, C)),
])
def test_batch_equals_single_relationship(graph, evidence, i, single):
    expected = [tuple(x) for x in single(graph).collect()]
    assert of(evidence, i, r.RELATIONSHIP_COLUMNS) == expected and expected


def test_batch_equals_single_laundering(graph, evidence):
    expected = [tuple(x) for x in r.entity_laundering(graph, P).collect()]
    assert of(evidence, 2, r.LAUNDERING_COLUMNS) == expected and expected


@pytest.mark.parametrize("i, n", [(3, 5), (12, 1)])
def test_batch_equals_single_ranking(graph, evidence, i, n):
    expected = [tuple(x) for x in r.top_laundering_senders(graph, n).collect()]
    assert of(evidence, i, rq.SENDER_COLUMNS) == expected and expected


def test_requests_without_rows_and_with_errors(evidence):
    errors = {x.request_id: x.error for x in evidence.filter("error IS NOT NULL").collect()}
    assert errors == {5: "two entity names are required", 6: "an entity name is required",
                      7: "unknown intent", 13: "unknown intent"}
    assert not {4, 11} & {x.request_id for x in evidence.select("request_id").distinct().collect()}


def test_small_limits_equal_single_questions(graph, asked, rows):
    got = rq.relationship_evidence(graph, asked, limit=1).filter("request_id = 9").drop("request_id")
    assert rows(got) == rows(r.entity_relationship(graph, C, P, limit=1))
    got = rq.laundering_evidence(graph, asked, limit=1).filter("request_id = 2").drop("request_id")
    assert rows(got) == rows(r.entity_laundering(graph, P, limit=1))


def test_repeated_ids_are_errors(spark, graph):
    asked = spark.createDataFrame([
        (1, "TOP_LAUNDERING_SENDERS", None, None, None, 2), (1, "TOP_LAUNDERING_SENDERS", None, None, None, 3),
        (2, "TOP_LAUNDERING_SENDERS", None, None, None, 2)], REQUEST_SCHEMA)
    evidence = rq.answer_requests(graph, asked)
    assert [(x.request_id, x.error) for x in evidence.orderBy("request_id", "row_number").collect()] == [
        (1, rq.REPEATED), (2, None), (2, None)]
    packed = rq.evidence_pack(evidence, asked).orderBy("request_id").collect()
    assert [(x.request_id, x.status, x.evidence_row_count) for x in packed] == [(1, "ERROR", 0), (1, "ERROR", 0), (2, "OK", 2)]


def test_pack(evidence, asked):
    packed = {x.request_id: x for x in rq.evidence_pack(evidence, asked, most=2).collect()}
    assert set(packed) == set(range(1, 14))
    assert packed[1].evidence_row_count == 3
    first = json.loads(packed[1].evidence)
    assert [x["transaction_id"] for x in first] == ["t01", "t03"]
    assert list(first[0]) == r.RELATIONSHIP_COLUMNS
    whole = json.loads({x.request_id: x for x in rq.evidence_pack(evidence, asked, most=None).collect()}[1].evidence)
    assert whole[2]["timestamp"] is None
    assert (packed[4].evidence_row_count, packed[4].evidence, packed[4].status) == (0, "[]", "UNSUPPORTED")
    assert (packed[5].evidence_row_count, packed[5].status) == (0, "ERROR")
    assert json.loads(packed[3].evidence)[0]["totals_by_currency"][0]["currency"] == "Euro"


def test_flatten(graph):
    top = rq.flatten_evidence(r.top_laundering_senders(graph, 1))
    assert dict(top.dtypes)["totals_by_currency"] == "string"
    assert json.loads(top.first().totals_by_currency)[0]["transaction_count"] == 6
    flat = rq.flatten_evidence(r.entity_relationship(graph, P, C))
    assert flat.first().timestamp == "2022-09-03 14:06:00"
    assert dict(flat.dtypes)["amount"] == "double"

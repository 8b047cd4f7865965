import pytest
from pyspark.sql import functions as F

from remitgraph.operators import validate
from remitgraph.plans.tables import empty_graph


def test_distinct_counts_treat_nulls_as_stated(spark):
    """A summary ignores pairs with a null; the relationship summary counts them."""
    accounts = spark.createDataFrame([("a", 1, "e"), ("b", None, "e")], "account_number string, bank_id bigint, entity_id string")
    assert validate.account_summary(accounts).first().distinct_bank_account_pairs == 1
    graph = empty_graph(spark).with_(owns=spark.createDataFrame([("e", "a"), (None, "a"), (None, "a")], "entity_id string, account_key string"))
    row = validate.relationship_summary(graph).filter("relationship_type = 'OWNS'").first()
    assert (row.row_count, row.distinct_relationships) == (3, 2)


def test_empty_graph_reports_zeros(spark, rows):
    graph = empty_graph(spark)
    assert {r[2] for r in rows(validate.missing_endpoints(graph))} == {0}
    assert validate.missing_endpoints(graph).count() == 8
    assert {r[1] for r in rows(validate.relationship_summary(graph))} == {0}
    assert validate.check_constraints(graph).isEmpty()


def test_null_ends_are_missing(spark, rows):
    graph = empty_graph(spark).with_(sent=spark.createDataFrame([(None, "t")], "account_key string, transaction_id string"))
    got = rows(validate.missing_endpoints(graph).filter("relationship_type = 'SENT'"))
    assert got == [("SENT", "accounts", 1), ("SENT", "transactions", 1)]


def test_conflicts_give_their_values(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", None, "x"), ("b", 1, "y")],
                               "account_number string, bank_id bigint, entity_id string")
    assert rows(validate.identity_conflicts(df)) == [
        ("a", 3, 2, 1, "bank_id", "1", 1), ("a", 3, 2, 1, "bank_id", "2", 1), ("a", 3, 2, 1, "entity_id", "x", 3)]


def test_a_huge_conflict_comes_whole(spark):
    df = spark.range(10_001).select(F.lit("a").alias("account_number"), F.col("id").alias("bank_id"), F.lit("e").alias("entity_id"))
    found = validate.identity_conflicts(df)
    assert found.filter("member_of = 'bank_id' and number_of_banks = 10001").count() == 10_001


def test_null_key_groups_are_checked(spark, rows):
    df = spark.createDataFrame([(None, "x"), (None, "y")], "entity_id string, entity_name string")
    assert rows(validate.name_conflicts(df, "entity_id", "entity_name")) == [(None, 2, "x", 1), (None, 2, "y", 1)]


def test_gates(spark):
    empty = spark.createDataFrame([], "a int")
    validate.require_empty(empty, "no")
    with pytest.raises(ValueError, match="stop here"):
        validate.require_empty(spark.range(1), "stop here")
    nodes = spark.createDataFrame([(1, "A", "e", "x"), (1, "B", "e", "x")], "bank_id bigint, bank_name string, entity_id string, entity_name string")
    with pytest.raises(ValueError, match="bank id"):
        validate.require_consistent_names(nodes)


def test_gates_measured_while_written(spark, rows):
    nodes = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (2, "C"), (2, None), (None, "D"), (3, None)], "k bigint, n string")
    names = validate.names_per_key(nodes, "k", "n")
    assert {r.k: (r.name, r.several) for r in names.collect()} == {
        1: ("A", True), 2: ("C", False), None: ("D", False), 3: (None, False)}
    kept, broken = validate.measured(names, {"several names": F.col("several"), "no name": F.col("name").isNull()})
    assert broken == {"several names": 1, "no name": 1} and rows(kept) == rows(names)
    with pytest.raises(ValueError, match="1 rows: several names$"):
        validate.gated(names, {"several names": F.col("several"), "no key": F.col("name") == "X"})
    good = validate.gated(names.filter("k = 2"), {"several names": F.col("several")})
    assert good.count() == 1
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    validate.measured(spark.range(100), {"odd": F.col("id") % 2 == 1})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs + 1  # the write, no pass of its own
    for none in (nodes.limit(0), spark.createDataFrame([], "k bigint, n string")):
        assert validate.measured(none, {"no name": F.col("n").isNull()})[1] == {"no name": 0}


def test_manifests(spark, rows):
    schema = "file_name string, file_size bigint"
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], schema)
    b = spark.createDataFrame([("x", 1), ("y", 9), ("w", 4)], schema)
    got = {r[0]: r[3] for r in rows(validate.reconcile_manifest(a, b))}
    assert got == {"x": "MATCH", "y": "SIZE_DIFFERS", "z": "MISSING", "w": "UNEXPECTED"}
    validate.require_same_files(a, a)
    with pytest.raises(ValueError):
        validate.require_same_files(a, b)


def test_unique_constraint_allows_missing_keys(spark, rows):
    graph = empty_graph(spark).with_(
        entities=spark.createDataFrame([(None, "x", "Entity"), (None, "y", "Entity"), ("e", "z", "Entity"), ("e", "q", "Entity")],
                                       "id string, name string, label string"))
    assert rows(validate.check_constraints(graph)) == [("Entity", "e", 2)]

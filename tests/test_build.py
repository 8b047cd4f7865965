import pytest
from pyspark.sql import functions as F

from remitgraph.operators import build, validate

RAW_TX = ("Timestamp string, `From Bank` string, Account2 string, `To Bank` string, Account4 string, "
          "`Amount Received` string, `Receiving Currency` string, `Amount Paid` string, "
          "`Payment Currency` string, `Payment Format` string, `Is Laundering` string")
RAW_ACC = "`Bank Name` string, `Bank ID` string, `Account Number` string, `Entity ID` string, `Entity Name` string"


def tx(time="2022/09/03 14:06", bank="1", sender="a", to_bank="2", receiver="b", paid="101.5", label="1"):
    return (time, bank, sender, to_bank, receiver, "101.5", "Euro", paid, "Euro", "Cheque", label)


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([
        tx(), tx(), tx(time="bad"), tx(bank=None), tx(bank="010", sender=" a "), tx(receiver=" "),
        tx(paid="12345678.9", label=None), tx(sender="a", to_bank="1", receiver="a", label="0"),
    ], RAW_TX)


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([
        ("B1", "1", "a", "E1", "One"), ("B1", "1", "a", "E0", "Zero"), (None, "1", "c", "E1", "One"),
        ("B2", "2", " b ", None, None), ("B9", "9", "", "E9", "Nine"), ("B10", "010", "a", "E2", "Two"),
    ], RAW_ACC)


def test_account_columns_are_named_by_order(spark):
    df = spark.createDataFrame([(1, 2)], "Account2 int, Account4 int")
    assert build.name_account_sides(df).columns == ["from_account", "to_account"]
    with pytest.raises(ValueError, match="two account columns"):
        build.name_account_sides(df.drop("Account4"))


def test_clean_accounts_drops_blank_numbers(accounts, rows):
    got = rows(build.clean_accounts(accounts).select("account_number", "bank_id"))
    assert got == [("a", 1), ("a", 1), ("a", 10), ("b", 2), ("c", 1)]


def test_metadata_takes_the_smallest_entity_nulls_last(accounts, rows):
    got = rows(build.account_metadata(build.clean_accounts(accounts)))
    assert (1, "a", "B1", "E0", "Zero") in got and (2, "b", "B2", None, None) in got
    assert len(got) == 4


def test_pairs_are_complete_and_distinct(raw, rows):
    assert rows(build.transaction_accounts(raw)) == [(1, "a"), (10, "a"), (2, "b")]


def test_node_names_prefer_a_real_name(spark, rows):
    df = spark.createDataFrame([(1, None), (1, "B"), (1, "A"), (2, None)], "bank_id bigint, bank_name string")
    assert rows(build.bank_nodes(df)) == [(1, "A", "Bank"), (2, None, "Bank")]


def test_partial_key_is_null_and_surfaces_as_unknown(spark, raw, accounts, rows):
    graph = build.build_graph(accounts, raw)
    bad = graph.transactions.filter("from_account_key IS NULL OR to_account_key IS NULL")
    assert bad.count() == 2
    assert rows(validate.unknown_accounts(graph.transactions, graph.accounts)) == [(None,)]


def test_accounts_without_metadata_stay_until_load(accounts, raw, rows):
    graph = build.build_graph(accounts, raw)
    assert (None, "2|b") in rows(graph.owns)
    assert rows(validate.incomplete_metadata(graph.accounts).select("account_key")) == [("2|b",)]


def test_identical_rows_share_an_id_unless_numbered(raw):
    base = build.transaction_base(raw)
    plain, numbered = build.transaction_nodes(base), build.transaction_nodes(base, occurrence=True)
    assert plain.select("transaction_id").distinct().count() == 7
    assert numbered.select("transaction_id").distinct().count() == 8
    assert numbered.filter(F.col("transaction_id").endswith("-2")).count() == 1
    with pytest.raises(ValueError):
        build.transaction_nodes(base, money="decimal", occurrence=True)


def test_a_large_group_of_copies_is_numbered_without_gaps(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = build.number_copies(df, "k", per_task=10)
    keys = {r.k for r in got.collect()}
    assert keys == {r.k for r in df.filter("k <> 'hot'").collect()} | {"hot"} | {f"hot-{i}" for i in range(2, 335)}
    assert got.count() == 1000


def test_staged_build_gives_the_same_graph(accounts, raw, rows):
    lazy, staged = build.build_graph(accounts, raw), build.build_graph(
        accounts, raw, staged=("base", "accounts", "transactions"))
    for (name, a), (_, b) in zip(lazy.items(), staged.items()):
        assert rows(a) == rows(b), name


def test_views(spark, accounts, raw):
    build.build_graph(accounts, raw).register("g_")
    assert spark.sql("SELECT count(*) AS n FROM g_transactions").first().n == 8

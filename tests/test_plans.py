"""Properties of plans that decide whether a query holds at scale."""

import pytest
from graph_fixture import C, P, hand_made
from pyspark.sql import functions as F

from checks import mapping as m
from remitgraph.operators import build, load, requests, retrieve, validate
from remitgraph.plans.staging import shared_folder, stage, staged, top_per_group, within_reach
from remitgraph.sources import store

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def graph(spark):
    return m.graph(spark, D)


QUESTIONS = {
    "relationship": lambda g: retrieve.entity_relationship(g, "Corporation #1", "Corporation #2"),
    "laundering": lambda g: retrieve.entity_laundering(g, "Corporation #1", limit=None),
    "senders": lambda g: retrieve.top_laundering_senders(g),
    "subject": lambda g: retrieve.subject_transactions(g, "Corporation #1"),
    "pair": lambda g: retrieve.pair_rows(g, "Corporation #1", "Corporation #2"),
    "endpoints": lambda g: validate.missing_endpoints(g),
    "unknown": lambda g: validate.unknown_accounts(g.transactions, g.accounts),
}


@pytest.mark.parametrize("name", QUESTIONS)
def test_no_nested_loops(graph, name):
    text = plan(QUESTIONS[name](graph))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_batches_have_no_nested_loops(spark, graph):
    text = plan(requests.answer_requests(graph, m.requests(spark, D)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["relationship", "pair", "senders"])
def test_both_directions_come_from_one_scan(graph, name):
    assert plan(QUESTIONS[name](graph)).count("lineitem.parquet") == 1


def test_columns_are_pruned_and_filters_pushed(spark, graph):
    text = plan(validate.duplicate_keys(m.table(spark, D, "lineitem"), ["l_orderkey", "l_linenumber"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text
    scan = [x for x in plan(retrieve.sender_totals(graph)).splitlines() if "lineitem.parquet" in x][0]
    assert "l_shipdate" not in scan and "l_tax" not in scan


def test_labelled_questions_read_only_the_labelled_partition(spark, tmp_path):
    stored = store.write_graph(hand_made(spark), str(tmp_path / "g"), buckets=2)
    text = plan(retrieve.sender_totals(stored))
    assert "PartitionFilters: [isnotnull(is_laundering" in text
    assert "ReadSchema: struct<from_account_key:string,amount_paid:double,payment_currency:string>" in text


def test_stored_questions_cut_paths_before_any_join(spark, tmp_path, monkeypatch):
    stored = store.write_graph(hand_made(spark), str(tmp_path / "g"), buckets=2)
    staged = {}

    def look(df, name):
        staged[name] = plan(df)
        return stage(df, name)

    monkeypatch.setattr(retrieve, "stage", look)
    retrieve.entity_laundering(stored, P)
    assert "WindowGroupLimit" in staged["paths"]
    assert "account_owners" not in staged["paths"] and "account_banks" not in staged["paths"]
    retrieve.subject_transactions(stored, P)
    assert "TakeOrderedAndProject" in staged["paths"] and "account_banks" not in staged["paths"]
    retrieve.transaction_paths(stored)
    assert "Join" not in staged["transfers"] and "TakeOrderedAndProject" in staged["transfers"]


def scans(df, column):
    return [line for line in plan(df).splitlines() if "FileScan" in line and column in line]


def test_buckets_are_pruned_from_either_end(spark, tmp_path, monkeypatch):
    """Without a collect: the accounts asked about prune the stored folders at run time, senders and receivers."""
    stored = store.write_graph(hand_made(spark), str(tmp_path / "g"), buckets=4)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    monkeypatch.setattr(type(stored.accounts), "collect", lambda self: pytest.fail("rows came to the driver"))
    paths = []
    monkeypatch.setattr(retrieve, "stage", lambda df, name: (name == "paths" and paths.append(df)) or stage(df, name))
    retrieve.entity_laundering(stored, P)
    asked = {"sender_bucket": retrieve.entity_relationship(stored, P, C), "receiver_bucket": paths[0]}
    for bucket, df in [*asked.items(), ("sender_bucket", paths[0])]:
        found = scans(df, bucket)
        assert found and all(f"dynamicpruningexpression({bucket}" in s for s in found), bucket
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    monkeypatch.undo()
    read = retrieve.bucketed_transfers(stored, "receiver").count()
    assert read == stored.transactions.filter("is_laundering").count()


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    text = plan(top_per_group(df, ["g"], [F.col("id")], 5))
    partial = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in partial and "Partial" in partial


def test_no_python_in_the_plans(graph):
    for name, question in QUESTIONS.items():
        assert "Python" not in plan(question(graph)), name


def test_edges_are_counted_before_the_anti_join(graph):
    text = plan(validate.missing_endpoints(graph.with_(accounts=graph.accounts.hint("merge"))))
    assert text.count("partial_count(1)") >= 8


def test_nodes_are_not_broadcast_to_look_for_missing_endpoints(graph):
    """However small Spark takes them for; and ids are shuffled packed."""
    text = plan(validate.missing_endpoints(graph))
    anti = [line for line in text.splitlines() if "LeftAnti" in line]
    assert len(anti) == 8 and all("SortMergeJoin" in line for line in anti)
    assert "unhex(" in text


@pytest.fixture
def skewed(spark):
    """Tiny limits, so that a third of a few thousand rows on one key counts as skew."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_graph(spark, n=6000):
    """A third of all transfers leave one account."""
    graph = hand_made(spark)
    i = F.col("id")
    sender = F.when(i % 3 == 0, "1|p").otherwise(F.concat(F.lit("7|"), i % 500))
    tx = spark.range(n, numPartitions=4).select(
        F.format_string("t%06d", "id").alias("transaction_id"),
        F.make_timestamp_ntz(F.lit(2022), F.lit(9), F.lit(1), F.lit(0), (i % 60).cast("int"), F.lit(0)).alias("timestamp"),
        sender.alias("from_account_key"), F.concat(F.lit("7|"), (i * 7) % 500).alias("to_account_key"),
        F.lit(1.0).alias("amount_received"), F.lit("Euro").alias("receiving_currency"), F.lit(1.5).alias("amount_paid"),
        F.lit("Euro").alias("payment_currency"), F.lit("Wire").alias("payment_format"),
        (i % 2 == 0).alias("is_laundering"), F.lit("Transaction").alias("label"))
    more = spark.range(500).select(F.concat(F.lit("F"), "id").alias("entity_id"), F.concat(F.lit("7|"), "id").alias("account_key"))
    named = more.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("name"), F.lit("Entity").alias("label"))
    held = more.select("account_key", F.lit(1).cast("bigint").alias("bank_id"))
    return graph.with_(
        transactions=tx, owns=graph.owns.unionByName(more), entities=graph.entities.unionByName(named),
        held_at=graph.held_at.unionByName(held), sent=build.sent(tx), received_by=build.received_by(tx))


def test_a_hot_account_is_split_in_path_joins(spark, skewed):
    graph = hot_graph(spark)
    paths = retrieve.entity_paths(graph)
    # 2000 rows of one account with one owner, the rest with one owner each; none to itself.
    same = graph.transactions.filter("from_account_key = to_account_key").count()
    assert len(paths.collect()) == 6000 - same
    text = paths._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in text


def test_answers_do_not_change_under_skew_settings(spark, skewed, rows):
    graph = hot_graph(spark)
    got = [r.transaction_id for r in retrieve.entity_laundering(graph, P).collect()]
    brute = graph.transactions.filter("from_account_key = '1|p' AND is_laundering").orderBy("timestamp", "transaction_id")
    assert got == [r.transaction_id for r in brute.limit(50).collect()]
    top = retrieve.top_senders_simple(graph, 1).first()
    assert (top.entity_id, top.laundering_transaction_count) == ("800CD3AC0", 1000)
    missing = {(r.relationship_type, r.missing_node): r.missing_rows for r in validate.missing_endpoints(graph).collect()}
    assert missing[("SENT", "accounts")] == 4000


def test_staged_data_lives_in_the_shared_folder(spark):
    staged = stage(spark.range(5), "x")
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in staged.inputFiles())


def test_loading_shuffles_edges_once_per_end(spark):
    """Two semi joins, and the distinct step reuses the partitioning of the second."""
    edges = spark.createDataFrame([("a", "t")], "account_key string, transaction_id string")
    nodes = spark.createDataFrame([("a",)], "account_key string"), spark.createDataFrame([("t",)], "transaction_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(load.merge_edges(None, edges, *nodes))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 4


def test_line_items_are_shuffled_once(spark):
    """Receivers are evaluated first, so that line items meet them where they are read."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")  # customers of sf0.1 are beyond it, receivers are not
    try:
        plan = m.raw_transactions(spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Orders and customers by customer, then orders and line items by order.
    assert plan.count("Exchange hashpartitioning(") == 4 and plan.count("Exchange hashpartitioning(l_orderkey") == 2


def test_staged_transactions_take_no_room_for_what_follows_from_them(spark, tmp_path, monkeypatch):
    staged = {}
    monkeypatch.setattr(build, "stage", lambda df, name: staged.setdefault(name, df))
    m.graph(spark, "/root/testdata/sf0.001", m.FOR_WRITING)
    assert set(staged) == {"base", "accounts"} and staged["base"].columns == build.ID_PARTS


def test_within_reach_leaves_little_to_sort_and_loses_nothing(spark, rows):
    at = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10**9))).cast("timestamp_ntz")
    many = spark.range(20000).select(
        (F.col("id") % 3).cast("string").alias("name"), F.when(F.col("id") % 7 > 0, at).alias("timestamp"), "id")
    few = spark.sql("SELECT 'few' AS name, CASE WHEN id % 2 = 0 THEN timestamp_ntz'2020-01-01 00:00:00' END AS timestamp, id FROM range(60)")
    same = spark.sql("SELECT CAST(NULL AS string) AS name, timestamp_ntz'2020-01-01 00:00:00' AS timestamp, id FROM range(300)")
    df = many.unionByName(few).unionByName(same)
    near = within_reach(df, ["name"], "timestamp", 50)
    order = [F.col("timestamp").asc_nulls_last(), F.col("id")]
    assert rows(top_per_group(near, ["name"], order, 50)) == rows(top_per_group(df, ["name"], order, 50))
    left = {r.name: r["count"] for r in near.groupBy("name").count().collect()}
    assert left["few"] == 60 and left[None] == 300 and all(50 <= left[n] < 200 for n in "012")


@pytest.mark.parametrize("evidence,stored", [
    (requests.relationship_evidence, False), (requests.relationship_evidence, True), (requests.laundering_evidence, False)])
def test_requests_sort_only_rows_within_reach(spark, graph, tmp_path, evidence, stored):
    asked = store.write_graph(graph, str(tmp_path / "g"), buckets=4) if stored else graph
    text = plan(evidence(asked, m.requests(spark, D)))
    assert "_bound" in text


@pytest.mark.parametrize("evidence", [requests.relationship_evidence, requests.laundering_evidence])
def test_what_requests_reach_is_found_without_ids(spark, graph, monkeypatch, evidence):
    """Accounts and times are shuffled; whole transfers meet the few that these leave."""
    seen = {}
    monkeypatch.setattr(retrieve, "staged", lambda df, name: seen.setdefault(name, df) and None or staged(df, name))
    few = {}
    monkeypatch.setattr(retrieve, "stage", lambda df, name: few.setdefault(name, stage(df, name)))
    evidence(graph, m.requests(spark, D))
    assert "sha2(" not in plan(seen["narrow"]) and "transaction_id" not in seen["narrow"].columns
    assert 0 < few["reached-transfers"].count() <= graph.transactions.count()
    assert few["reached-transfers"].columns == graph.transactions.columns


def test_ids_of_edges_are_computed_once(spark, graph):
    """Not again in the filters of null ends and of the joins."""
    nodes = spark.createDataFrame([("a",)], "account_key string"), spark.createDataFrame([("t",)], "transaction_id string")
    merged = load.merge_edges(None, load.typed_edges("sent", graph.sent), *nodes)
    assert plan(merged).count("sha2(") == 1
    typed = load.typed_nodes("transactions", graph.transactions.withColumn(load.SEQ, F.lit(1)))
    assert plan(load.upsert_nodes(None, typed, "transaction_id")).count("sha2(") == 1


def test_transactions_with_usual_accounts_are_not_shuffled_for_what_is_known_of_them(spark, graph):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    try:
        text = plan(retrieve.known_ends(graph))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Join") >= 2 and "LeftOuter" in text
    assert all("BroadcastHashJoin" in line for line in text.splitlines() if "LeftOuter" in line)


def test_what_is_known_of_ends(spark, rows):
    graph = hand_made(spark)
    lost = graph.transactions.filter("transaction_id = 't01'").withColumns(
        {"transaction_id": F.lit("t99"), "to_account_key": F.lit(None).cast("string")})
    ends = retrieve.known_ends(graph.with_(transactions=graph.transactions.unionByName(lost)))
    flags = ["from_owned", "to_owned", "from_banked", "to_banked", "between_owners"]
    got = {r.transaction_id: tuple(r[f] for f in flags) for r in ends.collect()}
    unusual = {"t04": (True,) * 5, "t05": (True,) * 4 + (False,), "t08": (True, True, True, False, True),
               "t09": (False, True, False, True, True), "t11": (True,) * 4 + (False,), "t99": (True, False, True, False, True)}
    assert got == {r.transaction_id: unusual.get(r.transaction_id, (True,) * 5) for r in ends.collect()}

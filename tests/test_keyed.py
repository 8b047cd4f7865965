import re
from pathlib import Path

from pyspark.sql import functions as F
from test_load import incoming

from remitgraph.operators import load
from remitgraph.plans import staging
from remitgraph.plans.tables import NODE_KEYS
from remitgraph.sources import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def batches(spark):
    """Three batches that repeat keys within and between them, with edges whose nodes come late or never."""
    accounts = [(f"{i % 7}|a{i}", f"a{i}") for i in range(40)]
    one = incoming(spark, 1, accounts=accounts + [("0|a0", "twice"), (" ", "blank")], banks=[(str(i), f"B{i}") for i in range(5)],
                   entities=[("e1", "E1"), ("e2", "E2")], owns=[("e1", k) for k, _ in accounts[:9]] + [("e1", accounts[0][0]), ("e9", accounts[0][0])],
                   held_at=[(k, k[0]) for k, _ in accounts])
    two = incoming(spark, 2, accounts=[("0|a0", None), ("9|new", "new")], entities=[("e9", "late")],
                   owns=[("e9", accounts[0][0]), ("e1", accounts[1][0])], held_at=[("9|new", "3"), ("nobody", "3")],
                   transactions=[("t1", "2022-09-01 00:20:00", "1.5", "Euro", "2", "Yen", "Wire", "1")],
                   sent=[("0|a0", "t1"), ("0|a0", "t2")], received_by=[("t1", "9|new")])
    return [one, two, two]


def test_batches_give_what_whole_loads_give(spark, tmp_path, rows):
    store = keyed.open_store(spark, str(tmp_path / "keyed"), parts=5, buckets=3)
    whole = None
    for i, batch in enumerate(batches(spark)):
        keyed.load_batch(store, batch)
        whole = load.load_graph(batch, str(tmp_path / f"v{i}"), whole)
        for table, df in store.tables().items():
            assert rows(df) == rows(whole[table].select(*df.columns)), (i, table)


def test_a_store_is_found_again(spark, tmp_path, rows):
    path = str(tmp_path / "again")
    first = keyed.open_store(spark, path, parts=5, buckets=3)
    keyed.load_batch(first, batches(spark)[0])
    before = {t: rows(df) for t, df in first.tables().items()}
    for table in [*NODE_KEYS, "owns", "held_at", "sent", "received_by"]:
        spark.sql(f"DROP TABLE {first.name(table)}")
    second = keyed.open_store(spark, path, parts=99, buckets=99)
    assert (second.parts, second.buckets) == (5, 3)
    assert {t: rows(df) for t, df in second.tables().items()} == before


def test_only_touched_parts_are_read_and_written(spark, tmp_path):
    store = keyed.open_store(spark, str(tmp_path / "parts"), parts=16, buckets=2)
    keyed.load_batch(store, incoming(spark, accounts=[(f"1|{i}", str(i)) for i in range(400)]))
    before = files(tmp_path / "parts" / "accounts")
    assert len({n.split("/")[0] for n in before}) == 16
    keyed.load_batch(store, incoming(spark, 2, accounts=[("1|7", "changed"), ("1|9", "too")]))
    after = files(tmp_path / "parts" / "accounts")
    touched = {f"part={r[0]}" for r in spark.createDataFrame([("1|7",), ("1|9",)], "k string").select(store.part("k")).collect()}
    for folder in {n.split("/")[0] for n in before} - touched:
        own = {n: t for n, t in before.items() if n.startswith(folder + "/")}
        assert own and own == {n: t for n, t in after.items() if n.startswith(folder + "/")}
    assert store.read("accounts").count() == 400 and store.read("accounts").filter("account_number = 'changed'").count() == 1
    batch = spark.createDataFrame([("1|7", "x")], "account_key string, account_number string")
    assert len({f.split("/")[-2] for f in store.within("accounts", batch).inputFiles()}) == 1


def test_edges_are_appended(spark, tmp_path):
    store = keyed.open_store(spark, str(tmp_path / "edges"), parts=4, buckets=2)
    accounts = [(f"1|{i}", str(i)) for i in range(60)]
    keyed.load_batch(store, incoming(spark, accounts=accounts, entities=[("e", "E")], owns=[("e", k) for k, _ in accounts[:50]]))
    before = files(tmp_path / "edges" / "owns")
    keyed.load_batch(store, incoming(spark, 2, owns=[("e", k) for k, _ in accounts[40:]] * 3))
    after = files(tmp_path / "edges" / "owns")
    assert before.items() <= after.items() and len(after) > len(before)
    assert store.read("owns").count() == 60


def test_the_stored_side_has_no_exchange(spark, tmp_path):
    store = keyed.open_store(spark, str(tmp_path / "plans"), parts=4, buckets=2)
    keyed.load_batch(store, incoming(spark, accounts=[(f"1|{i}", str(i)) for i in range(50)], entities=[("e", "E")],
                                     owns=[("e", f"1|{i}") for i in range(50)]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        batch = spark.createDataFrame([("1|1", "x"), ("1|70", "y")], "account_key string, account_number string")
        edges = spark.createDataFrame([("e", "1|1"), ("e", "1|70")], "entity_id string, account_key string")
        for df in (keyed.merged_nodes(store, "accounts", batch), keyed.new_edges(store, "owns", edges)):
            text = plan(df)
            assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
            scans = [line for line in text.splitlines() if "FileScan" in line]
            assert scans and all(re.search(r"PartitionFilters: \[.*part", s) and "Bucketed: true" in s for s in scans)
            exchanges = [line for line in text.splitlines() if "Exchange" in line]
            assert len(exchanges) == 1  # that of the batch
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_empty_batches_and_keys_without_values(spark, tmp_path, rows):
    store = keyed.open_store(spark, str(tmp_path / "empty"), parts=3, buckets=2)
    keyed.load_batch(store, incoming(spark))
    assert all(df.isEmpty() for df in store.tables().values())
    keyed.load_batch(store, incoming(spark, banks=[(" 010 ", "A"), ("x1", "B"), ("", "C"), ("10", None)]))
    assert rows(store.read("banks")) == [(10, None)]
    keyed.load_batch(store, {"banks": incoming(spark, banks=[("11", "D")])["banks"]})
    assert store.read("banks").count() == 2 and store.stored("banks").filter(F.col("part") != store.part("bank_id")).isEmpty()


def test_large_batches_give_what_small_ones_give(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 1)  # so that batches of more rows than buckets count as large
    test_batches_give_what_whole_loads_give(spark, tmp_path, rows)


def test_a_large_batch_uses_more_tasks_than_buckets_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 5)
    store = keyed.open_store(spark, str(tmp_path / "large"), parts=2, buckets=2)
    accounts = [(f"1|{i}", str(i)) for i in range(60)]
    keyed.load_batch(store, incoming(spark, accounts=accounts, entities=[("e", "E")]))
    edges = spark.createDataFrame([("e", k) for k, _ in accounts] * 2, "entity_id string, account_key string")
    assert "hashpartitioning(part" in plan(keyed.added_edges(store, "owns", edges, 60)) and store.is_empty("owns")
    assert keyed.added_edges(store, "owns", edges, 60).rdd.getNumPartitions() == 16  # 2 x 2 files in 4 slices each
    folder = Path(staging._own_folder(spark).removeprefix("file:"))
    before = set(folder.glob("batch-*"))
    keyed.load_batch(store, incoming(spark, 2, owns=[("e", k) for k, _ in accounts[:40]] * 2))
    keyed.load_batch(store, incoming(spark, 3, owns=[("e", k) for k, _ in accounts[20:]] + [("no", "1|1"), ("e", "no")]))
    assert store.read("owns").count() == 60 and set(folder.glob("batch-*")) == before


def test_packed_text_comes_back(spark):
    texts = ["", "ab", "AB", "abc", "0a1b", "ünï", "00-2", "\x00\x01", None, "ab" * 32]
    df = spark.createDataFrame([(t,) for t in texts], "id string")
    assert {r.id for r in staging.unpacked(staging.packed(df, "id"), "id").collect()} == set(texts)
    held = {r.id: r.bytes for r in staging.packed(df.withColumn("bytes", F.col("id")), "bytes").collect()}
    assert len(held["ab" * 32]) == 33 and len({bytes(b) for b in held.values() if b is not None}) == len(texts) - 1

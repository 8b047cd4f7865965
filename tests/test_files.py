import glob
import os

import pytest
from pyspark.sql import functions as F
from graph_fixture import C, P, hand_made

from remitgraph.operators import export, profile, retrieve, validate
from remitgraph.sources import files, sampling, store

HEADING = ("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,"
           "Payment Currency,Payment Format,Is Laundering")


def test_duplicate_headings(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADING + "\n2022/09/01 00:20,010,A,20,B,1.5,Euro,2.5,Yen,Wire,0\n")
    row = files.read_raw_transactions(spark, str(tmp_path / "t.csv")).first()
    assert (row.from_account, row.to_account, row["From Bank"], row.Timestamp) == ("A", "B", "010", "2022/09/01 00:20")
    inferred = files.read_text_table(spark, str(tmp_path / "t.csv"), infer=True)
    assert dict(inferred.dtypes)["From Bank"] == "int" and dict(inferred.dtypes)["Timestamp"] == "string"


def test_files_by_name_pattern(spark, tmp_path):
    for name, text in {"HI-Small_a.csv": "x,y\n1,2\n", "HI-Small_b.csv": "z\n3\n4\n", "HI-Large_a.csv": "x\n1\n"}.items():
        (tmp_path / name).write_text(text)
    found = files.read_matching(spark, str(tmp_path), "*Small*.csv")
    assert {n: (df.columns, df.count()) for n, df in found.items()} == {"HI-Small_a": (["x", "y"], 1), "HI-Small_b": (["z"], 2)}


def test_blank_and_null_text_in_csv(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "k string, v string")
    files.write_table(df, str(tmp_path / "c"), "csv")
    assert rows(files.read_text_table(spark, str(tmp_path / "c"))) == [("a", None), ("b", None), ("c", "x")]
    files.write_table(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)


def test_names_of_files(spark, tmp_path):
    """Blanks, plus signs, equal names in several folders, and any case."""
    for folder in ("a b", "c+d"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "My Small.CSV").write_text("x\n1\n" if folder == "a b" else "y\n1\n2\n")
    found = files.read_matching(spark, str(tmp_path), "*small*.csv")
    assert {n: (df.columns, df.count()) for n, df in found.items()} == {
        "a b/My Small.CSV": (["x"], 1), "c+d/My Small.CSV": (["y"], 2)}
    sizes = {r.file_name: r.file_size for r in files.copy_manifest(spark, str(tmp_path)).collect()}
    assert sizes == {"a b/My Small.CSV": 4, "c+d/My Small.CSV": 6}


def test_bundle_and_reconciliation(spark, tmp_path):
    graph = hand_made(spark)
    folder = export.write_export(graph, str(tmp_path), "v2")
    checked = export.export_validation(export.read_export(spark, folder), export.export_frames(graph)).collect()
    assert len(checked) == 8 and all(r.count_matches for r in checked)
    assert {r.table_name: r.columns for r in checked}["owns"] == "entity_id,account_key"
    manifest = files.copy_manifest(spark, folder)
    sizes = {r.file_name: r.file_size for r in manifest.collect()}
    assert sizes == {os.path.relpath(f, folder): os.path.getsize(f) for f in glob.glob(f"{folder}/*/part-*")}
    validate.require_same_files(manifest, manifest)
    with pytest.raises(ValueError):
        validate.require_same_files(manifest, manifest.filter("file_name not like 'sent/%'"))


def test_a_compressed_bundle_holds_the_same(spark, tmp_path, rows):
    graph = hand_made(spark)
    plain, small = (export.write_export(graph, str(tmp_path), v, compression=c) for v, c in (("v2", None), ("v3", "gzip")))
    assert {f.rsplit(".", 2)[-2] + "." + f.rsplit(".", 1)[-1] for f in glob.glob(f"{small}/*/part-*")} == {"csv.gz"}
    assert all(f.endswith(".csv") for f in glob.glob(f"{plain}/*/part-*"))
    text = export.read_export(spark, small)
    for table, df in export.read_export(spark, plain).items():
        assert rows(text[table]) == rows(df), table


def test_copies_are_stored_once(spark, tmp_path, rows):
    graph = hand_made(spark)
    twice = graph.with_(transactions=graph.transactions.union(graph.transactions), sent=graph.sent.union(graph.sent),
                        received_by=graph.received_by.union(graph.received_by))
    for derive in (False, True):
        stored = store.write_graph(twice, str(tmp_path / f"g{derive}"), buckets=4, derive_edges=derive)
        for ask in (lambda g: retrieve.entity_relationship(g, P, C), lambda g: retrieve.entity_laundering(g, P),
                    lambda g: retrieve.top_senders_by_currency(g, 5), lambda g: retrieve.top_senders_simple(g, 5)):
            assert rows(ask(stored)) == rows(ask(graph))
        assert stored.sent.count() == graph.sent.distinct().count()


def test_missing_rows_are_reported(spark, tmp_path):
    graph = hand_made(spark)
    folder = export.write_export(graph, str(tmp_path), "v2")
    short = {**export.read_export(spark, folder)}
    short["sent"] = short["sent"].limit(3)
    bad = export.export_validation(short, export.export_frames(graph)).filter("NOT count_matches").collect()
    assert [(r.table_name, r.expected_rows, r.actual_rows) for r in bad] == [("sent", 11, 3)]


def test_global_export_order(spark):
    got = [r.transaction_id for r in export.export_frames(hand_made(spark))["transactions"].collect()]
    assert got == sorted(got)


def test_sample_does_not_depend_on_partitions(spark, rows):
    a, b = spark.range(5000, numPartitions=3), spark.range(5000).repartition(7)
    for limit in (None, 100, 10_000):
        assert rows(sampling.repeatable_sample(a, ["id"], 0.2, limit=limit)) == rows(sampling.repeatable_sample(b, ["id"], 0.2, limit=limit))
    sample = sampling.repeatable_sample(a, ["id"], 0.2)
    assert 800 < sample.count() < 1200
    capped = sampling.repeatable_sample(a, ["id"], 0.2, limit=100)
    assert capped.count() == 100 and capped.join(sample, "id", "left_anti").isEmpty()
    assert rows(sampling.repeatable_sample(a, ["id"], 0.2, seed=1)) != rows(sample)
    assert sampling.random_sample(a, 0.5, 1, 10).count() == 10


def test_capped_sample_takes_the_lowest_hashes(spark, rows):
    df = spark.range(3000)
    ranked = df.filter(sampling.sample_rank(["id"], 42) < sampling._threshold(0.9))
    brute = ranked.orderBy(sampling.sample_rank(["id"], 42), "id").limit(77)
    assert rows(sampling.repeatable_sample(df, ["id"], 0.9, limit=77)) == rows(brute)


def test_numeric_summary_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1e6, 400), np.full(300, 7.25), rng.integers(0, 5, 300).astype(float)])
    data = [(float(v), None if i % 4 else int(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "a double, b int")
    got = {r.column_name: r for r in profile.numeric_summary(df).collect()}
    for name, column in (("a", values), ("b", np.arange(0, len(values), 4))):
        r = got[name]
        assert r["count"] == len(column)
        assert [r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx(np.quantile(column, [0, 0.25, 0.5, 0.75, 1]))
        assert (r["mean"], r["std"]) == pytest.approx((np.mean(column), np.std(column, ddof=1)))


def test_summary_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = {r.column_name: r for r in profile.numeric_summary(df).collect()}
    assert (got["a"]["count"], got["a"].p50) == (0, None) and (got["b"].p25, got["b"].std) == (1.0, None)


def test_stored_graph_gives_the_same_answers(spark, tmp_path, rows):
    graph = hand_made(spark)
    stored = store.write_graph(graph, str(tmp_path / "g"), buckets=4)
    assert stored.sender_buckets == 4 and dict(stored.transactions.dtypes)["is_laundering"] == "boolean"
    columns = graph.transactions.columns
    assert rows(stored.transactions.select(*columns)) == rows(graph.transactions)
    for ask in (lambda g: retrieve.entity_relationship(g, P, C), lambda g: retrieve.entity_laundering(g, P),
                lambda g: retrieve.pair_transactions(g, P, C), lambda g: retrieve.subject_transactions(g, P),
                lambda g: retrieve.top_senders_by_currency(g, 5), lambda g: retrieve.entity_relationship(g, "Nobody", C)):
        assert rows(ask(stored)) == rows(ask(graph))
    plan = retrieve.entity_relationship(stored, C, C)._jdf.queryExecution().executedPlan().toString()
    assert "sender_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters" in plan and "In(from_account_key, [2|c])" in plan or "EqualTo(from_account_key,2|c)" in plan


def test_one_row_of_an_id_is_stored_even_if_its_rows_differ(spark, tmp_path, rows):
    graph = hand_made(spark)
    first = graph.transactions.orderBy("transaction_id").limit(1)
    other = first.withColumns({"from_account_key": F.lit("9|other"), "is_laundering": ~F.col("is_laundering")})
    mixed = graph.with_(transactions=graph.transactions.unionByName(other))
    stored = store.write_graph(mixed, str(tmp_path / "g"), buckets=4, derive_edges=True)
    ids = rows(stored.transactions.select("transaction_id"))
    assert ids == rows(graph.transactions.select("transaction_id").distinct())
    assert store.repeated_ids(stored.transactions).isEmpty() and not store.repeated_ids(mixed.transactions).isEmpty()


def test_transactions_are_stored_by_one_shuffle_and_edges_derived_from_them(spark, tmp_path, rows):
    graph = hand_made(spark)
    plan = store.laid_out(graph, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(is_laundering") == 1 and "hashpartitioning(transaction_id" not in plan
    stored = store.write_graph(graph, str(tmp_path / "g"), buckets=4, derive_edges=True)
    assert not os.path.exists(tmp_path / "g" / "sent") and not os.path.exists(tmp_path / "g" / "received_by")
    again = store.read_graph(spark, str(tmp_path / "g"))
    for derived in (stored, again):
        assert rows(derived.sent) == rows(graph.sent.distinct()) and rows(derived.received_by) == rows(graph.received_by.distinct())

from graph_fixture import C, P, hand_made
from pyspark.sql import functions as F

from remitgraph.operators import export, load, retrieve
from remitgraph.plans.tables import NODE_KEYS, empty_graph


def incoming(spark, seq=1, **tables):
    """Text frames of all eight tables, empty where not given."""
    frames = {}
    for name, (columns, _) in export.EXPORT_LAYOUT.items():
        df = spark.createDataFrame(tables.get(name, []), ", ".join(f"{c} string" for c in columns))
        frames[name] = df.withColumn(load.SEQ, F.struct(F.lit(seq).alias("b"), F.monotonically_increasing_id().alias("p"))) if name in NODE_KEYS else df
    return frames


def test_last_row_wins_even_with_null(spark, rows):
    df = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("b", "x", 5), ("b", "y", 4), (" ", "z", 9), (None, "z", 9)],
                               "id string, name string, load_seq int")
    typed = load.typed_nodes("entities", df)
    assert rows(load.upsert_nodes(None, typed, "id")) == [("a", None), ("b", "x")]
    stored = spark.createDataFrame([("a", "old"), ("c", "kept")], "id string, name string")
    once = load.upsert_nodes(stored, typed, "id")
    assert rows(once) == [("a", None), ("b", "x"), ("c", "kept")]
    assert rows(load.upsert_nodes(once, typed, "id")) == rows(once)


def test_bank_keys_are_numbers(spark, rows):
    df = spark.createDataFrame([(" 010 ", " A "), ("x1", "B"), ("", "C")], "bank_id string, name string").withColumn(load.SEQ, F.lit(1))
    assert rows(load.upsert_nodes(None, load.typed_nodes("banks", df), "bank_id")) == [(10, "A")]
    frames = incoming(spark, banks=[(" 010 ", "A"), ("x1", "B"), ("", "C")])
    report = {r.table_name: r for r in load.load_report(frames).collect()}
    assert (report["banks"].offered_rows, report["banks"].blank_keys, report["banks"].unusable_keys) == (3, 1, 1)


def test_transaction_conversion(spark):
    frames = incoming(spark, transactions=[("t", "2022-09-01 00:20:00", "1.5", " Euro ", "x", "Yen", "Wire", " true "),
                                           ("u", "", None, None, "2", None, None, "yes")])
    got = {r.transaction_id: r for r in load.typed_nodes("transactions", frames["transactions"]).collect()}
    assert str(got["t"].timestamp) == "2022-09-01 00:20:00" and got["t"].is_laundering is True
    assert (got["t"].amount_received, got["t"].amount_paid, got["t"].receiving_currency) == (1.5, None, "Euro")
    assert got["u"].timestamp is None and got["u"].is_laundering is False and got["u"].amount_paid == 2.0


def test_edges_need_both_nodes_and_are_kept_once(spark, tmp_path, rows):
    first = incoming(spark, accounts=[("1|a", "a")], entities=[("e", "E")], banks=[("1", "B")],
                     owns=[("e", "1|a"), (" e ", " 1|a "), ("e", "9|x"), ("z", "1|a"), (None, "1|a")],
                     held_at=[("1|a", "01"), ("1|a", "x")])
    one = load.load_graph(first, str(tmp_path / "v1"))
    assert rows(one["owns"]) == [("e", "1|a")] and rows(one["held_at"]) == [("1|a", 1)]
    # The account comes with the second batch; only edges offered then are looked at.
    second = incoming(spark, 2, accounts=[("9|x", "x")], owns=[("e", "9|x"), ("e", "1|a")])
    two = load.load_graph(second, str(tmp_path / "v2"), one)
    assert rows(two["owns"]) == [("e", "1|a"), ("e", "9|x")]
    again = load.load_graph(second, str(tmp_path / "v3"), two)
    for name in two:
        assert rows(two[name]) == rows(again[name]), name


def test_file_order_decides(spark, tmp_path, rows):
    for name, lines in {"a": ["id,name", "k,first", "k,second", "j,only"], "b": ["id,name", "k,third", "m,x", "m,y"]}.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    read = spark.read.option("header", True).csv(str(tmp_path))
    typed = load.typed_nodes("entities", load.with_sequence(read, 1))
    assert rows(load.upsert_nodes(None, typed, "id")) == [("j", "only"), ("k", "third"), ("m", "y")]


def test_export_load_and_ask(spark, tmp_path, rows):
    graph = hand_made(spark)
    folder = export.write_export(graph, str(tmp_path), "v2")
    text = export.read_export(spark, folder)
    frames = {t: load.with_sequence(df, 1) if t in NODE_KEYS else df for t, df in text.items()}
    back = load.as_graph(load.load_graph(frames, str(tmp_path / "stored")))
    for question in (lambda g: retrieve.entity_relationship(g, P, C), lambda g: retrieve.entity_laundering(g, P)):
        # The load turns a missing label into false.
        known = question(graph).withColumn("is_laundering", F.coalesce("is_laundering", F.lit(False)))
        assert rows(question(back)) == rows(known)
    counts = {(r.kind, r.name): r.rows for r in load.graph_counts(back).collect()}
    assert counts[("relationship", "SENT")] == 10 and counts[("relationship", "RECEIVED_BY")] == 11
    # One transaction has an unknown sender; its receiver is known.
    assert back.transactions.filter("from_account_key IS NULL").count() == 1


def test_loading_nothing(spark, tmp_path):
    loaded = load.load_graph(incoming(spark), str(tmp_path / "none"))
    assert load.graph_counts(load.as_graph(loaded)).agg(F.sum("rows")).first()[0] == 0
    assert empty_graph(spark).transactions.isEmpty()


def test_ids_are_shuffled_packed_and_once(spark, tmp_path, rows):
    """Ids of any text come back as they were, and no shuffle carries them as text or twice."""
    names = ["ab" * 32, "AB" * 32, "abc", "t-1"]
    frames = incoming(spark, accounts=[("1|a", "a")], transactions=[(n, "", "1", "x", "1", "x", "W", "1") for n in names],
                      sent=[("1|a", n) for n in [*names, names[0], "lost"]], received_by=[(n, "1|a") for n in names[:2]] + [(names[2], "9|x")])
    loaded = load.load_graph(frames, str(tmp_path / "v1"))
    back = load.as_graph(loaded).transactions
    assert rows(back.select("transaction_id", "from_account_key", "to_account_key")) == sorted(
        [(n, "1|a", "1|a" if n in names[:2] else None) for n in names], key=str)
    upserted = load.upsert_nodes(None, load.typed_nodes("transactions", frames["transactions"]), "transaction_id")
    merged = load.merge_edges(None, load.typed_edges("received_by", frames["received_by"]),
                              *[load.node_keys(loaded, end, t) for end, t in (("transaction_id", "transactions"), ("account_key", "accounts"))])
    for df in (back, upserted, merged):
        assert "unhex(" in df._jdf.queryExecution().executedPlan().toString()
    assert "named_struct(_, 0, transaction_id" not in upserted._jdf.queryExecution().optimizedPlan().toString()
    assert upserted.columns == list(load.NODE_TYPES["transactions"])

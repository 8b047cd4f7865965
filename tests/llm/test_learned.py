"""Language, toxicity, vectors: held-out accuracy and edge cases."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from remitgraph.llm import language, neighbours, queries, secrets, toxicity
from remitgraph.llm.arrow import pieces

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = queries.op1_language_id(spark, DATA)
    known = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("lang").alias("true_lang"))
    right = found.filter("held_out").join(known, "doc_id").agg(
        F.avg((F.col("lang_pred") == F.col("true_lang")).cast("int"))).first()[0]
    assert right >= 0.98
    assert found.filter("score < 0 or score > 1 or score is null").isEmpty()


def test_language_spans_and_edges(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(rows)
    sample = {r.lang: r.text for r in rows.filter("length(text) between 400 and 900").collect()}
    joined = sample["en"] + "\n" + sample["de"]
    frame = docs([(1, joined), (2, None), (3, ""), (4, "123 !?"), (5, "Ωμέγα"), (1, joined), (6, sample["fr"] * 50)])
    found = {r.doc_id: r for r in language.label(frame, model).collect()}
    spans = found[1].spans
    assert {s.lang for s in spans} == {"en", "de"} and spans[0].start == 0 and spans[-1].end == len(joined)
    assert all(a.end == b.start for a, b in zip(spans, spans[1:]))
    assert [found[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and found[5].lang_pred in model.languages
    assert found[6].lang_pred == "fr"
    kept = language.keep_known(frame, model)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect())[:3] == [1, 1, 6]
    empty = language.fit(frame.limit(0))
    assert {r.lang_pred for r in language.label(frame, empty).collect()} == {"und"}
    assert language.label(frame.limit(0), model).collect() == []


def test_marks_without_letters_and_rows_without_id(spark, docs):
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    frame = docs([(1, "\u0301\u0302"), (2, "123 \u0301."), (3, "\u0301house \u0302 the of and"), (None, "the house of the and")])
    found = {r.doc_id: r for r in language.label(frame, model).collect()}
    assert [found[i].lang_pred for i in (1, 2)] == ["und", "und"] and [found[i].score for i in (1, 2)] == [0.0, 0.0]
    assert found[3].lang_pred == found[None].lang_pred == "en"
    held = spark.createDataFrame([(None,), (7,)], "doc_id long").select(F.coalesce(queries._fold(4) == 2, F.lit(False)).alias("h"))
    assert all(r.h is not None for r in held.collect())


def test_slices_do_not_change_what_is_kept(spark, docs, monkeypatch):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(rows)
    strings = pa.array([r.text for r in rows.limit(300).collect()] + ["", None, "\u0531\u0532 \u0533"])
    batch = pa.RecordBatch.from_arrays([strings], ["text"])
    whole = language._known(model, pc.fill_null(strings, ""))
    for most in (1, 5_000, 200_000):
        parts = [language._known(model, pc.fill_null(b.column("text"), "")) for b in pieces([batch], most=most)]
        assert np.array_equal(np.concatenate(parts), whole)


def test_rows_of_a_labelled_id_are_bounded(spark, docs, monkeypatch):
    """A chosen id that many rows bear does not bring them all to the driver."""
    frame = docs([(1, f"text number {i} of one id") for i in range(3_000)] + [(2, "fine words"), (3, "other fine words")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    sizes = []
    real = toxicity._descend
    monkeypatch.setattr(toxicity, "_descend", lambda sentences, words, buckets, toxic: sizes.append(len(toxic)) or real(
        sentences, words, buckets, toxic))
    model = toxicity.fit(frame, labels, sample=100)
    assert 0 < sizes[0] < 200
    assert toxicity.score(frame, model).count() == 3_002


def test_even_mixes_of_known_languages_are_kept(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(rows)
    sample = {r.lang: r.text[:400] for r in rows.filter("length(text) between 400 and 900").collect()}
    some = sorted(sample)[:3]
    assert len(some) == 3
    mixes = [(1, "\n".join(sample[k] for k in some[:2])), (2, "\n".join(sample[k] for k in some)),
             (3, sample[some[0]] + sample[some[0]][:130] + "\n" + sample[some[1]] + "\n" + sample[some[2]]), (4, "\u0531\u0532\u0533 \u0534\u0535")]
    frame = docs(mixes)
    assert all(r.score <= 0.55 for r in language.label(frame, model).collect())
    assert sorted(r.doc_id for r in language.keep_known(frame, model).collect()) == [1, 2, 3]


def test_samples_are_bounded_without_ids(spark, monkeypatch):
    texts = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('some words ', id) as text", "'en' as lang")
    copies = spark.range(4000).selectExpr("cast(5 as long) as doc_id", "'one text again' as text", "'en' as lang")
    seen, real = [], secrets._with_base
    monkeypatch.setattr(secrets, "_with_base", lambda chosen, columns: seen.append(chosen.count()) or real(chosen, columns))
    secrets.samples(texts.union(copies), bound=100)
    assert 0 < seen[0] < 200
    kind = type(texts)
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *to: seen.append(self.count()) or deal(self, *to))
    language.fit(texts.union(copies), sample=100)
    assert 0 < seen[1] < 200
    vectors = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as vec_id", "array(1f, cast(id as float), 2f) as embedding")
    vectors = vectors.union(spark.range(3000).selectExpr("cast(7 as long)", "array(1f, 2f, 3f)"))
    sizes = []
    monkeypatch.setattr(neighbours, "build", lambda values, **_: sizes.append(len(values)))
    neighbours.fit(vectors, sample=100)
    assert 0 < sizes[0] < 200


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    scores = -rng.random((12, 3)) * 20
    bounds = np.array([0, 5, 5, 6, 12])
    got = language._viterbi(scores, bounds)
    import itertools
    for a, b in zip(bounds[:-1], bounds[1:]):
        def value(path):
            return sum(scores[a + i, k] for i, k in enumerate(path)) - language.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(tuple(got[a:b])) - value(best)) < 1e-9


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, data).filter("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    rank = rows.score.rank()
    n = (rows.toxic == 1).sum()
    area = (rank[rows.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))
    assert area >= 0.9
    assert ((rows.score >= 0.7) & (rows.toxic == 0)).sum() <= 0.03 * (rows.toxic == 0).sum()


def test_toxicity_edges(spark, docs):
    rng = np.random.default_rng(1)

    def some():  # sentences that are not copies of each other
        return " ".join(f"w{n}" for n in rng.integers(0, 60, 8))

    rows = [(i, f"{some()}. {some()} clown {some()}" if i % 2 else f"{some()}. {some()}") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    text = "w1 w2 w3. w4 w5 clown! w6"
    found = {r.doc_id: r for r in toxicity.score(docs([(1, text), (2, None), (3, ""), (4, "w1 w2 w3 w4")]), model).collect()}
    assert found[1].score > 0.9 > 0.3 > found[4].score and found[2].score == found[3].score == 0
    assert [text[s.start:s.end] for s in found[1].sentences] == [" w4 w5 clown"]
    blank = toxicity.fit(docs(rows), labels.limit(0))
    assert 0 <= toxicity.score(docs(rows), blank).first().score <= 1


def brute(ids, vectors, query, k):
    v, q = vectors, vectors[query]
    score = (v * q).sum(axis=1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    order = [i for i in np.lexsort((ids, -score)) if i != query]
    return [ids[i] for i in order[:k]]


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = queries.op5_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    rows = table.orderBy("vec_id").toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    hits = [len(set(brute(ids, v, i, 5)) & set(found[found.query_id == ids[i]].vec_id)) for i in range(len(ids)) if ids[i] % 50 == 0]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    assert (found.groupby("query_id")["rank"].max() == 5).all()


def test_neighbours_of_repeated_ids(spark):
    k = 5
    rows = [(0, [1.0, 0.0])] + [(1, [2.0, 0.0])] * (k + 2) + [(i, [3.0, 0.0]) for i in range(2, 5)]
    rows += [(9, [1.0, 0.01 * i]) for i in range(1, 3 * k)] + [(20 + i, [1.0, 1.0 + i]) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r)[:3] for r in neighbours.search(table, table.filter("vec_id in (0, 1)"), k=k).collect())
    assert found == [(0, i + 1, v) for i, v in enumerate([1, 2, 3, 4, 9])] + [(1, i + 1, v) for i, v in enumerate([0, 2, 3, 4, 9])]
    deep = sorted(tuple(r)[:3] for r in neighbours.search(table, table.filter("vec_id = 0"), k=8).collect())
    assert deep == [(0, i + 1, v) for i, v in enumerate([1, 2, 3, 4, 9, 20, 21, 22])]


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as part", "3 as v")
    found = sorted(tuple(r) for r in neighbours.search(table, table.filter("vec_id in (0, 4, 5)"), k=5).collect())
    assert [r[:3] for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and [r[3] for r in found] == [1.0, 1.0, 0.0]
    assert neighbours.search(table.limit(0), table, k=5).collect() == []

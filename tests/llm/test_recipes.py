"""Exact duplicates by chunk recipes against grouping whole texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from remitgraph.llm import recipes

DATA = "/root/testdata/sf0.001"


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for i, t in rows:
        plain = re.sub("[ \t-\r]", "", t or "")
        best = min(groups[plain])
        yield i, best[3], len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest()


def held(df):
    rows = df.collect()
    for keep in {r.text_sha256 for r in rows}:
        kept = [r for r in rows if r.text_sha256 == keep and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


def hard():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé中👍 \n") for _ in range(60_000))
    shared = long[:20_000]
    return [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab "), (6, "a  b"), (7, "a b"), (None, "ab   "), (None, "x"),
            (8, "ab\u000b\u000c"), (8, "ab\u000b\u000c"), (9, long), (10, long.replace("\n", "")), (11, long + "x"), (12, shared),
            (13, "y" + shared), (14, "aaaa" * 30_000), (15, "aaaa" * 30_000 + "a"), (16, "a a" * 60_000), (17, "ab" + shared)]


def test_groups_and_the_row_that_stays(spark, docs):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + hard()
    assert held(recipes.exact_duplicates(docs(given))) == sorted(expected(given), key=str)
    clashing = docs(given).withColumns({"row": F.lit(1), "hashes": F.lit(1), "chunks": F.lit(2), "number": F.lit(3)})
    assert recipes.exact_duplicates(clashing.repartition(3)).count() == len(given)


def test_hashes_that_stand_for_several_chunks(spark, docs):
    """With three bits nearly every hash is shared; only numbers tell chunks apart."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + hard()
    assert held(recipes.exact_duplicates(docs(given), bits=3)) == sorted(expected(given), key=str)


def test_chunks_of_a_text(spark, docs):
    text = hard()[11][1]
    df = docs([(1, text), (2, "start " + text)]).select("doc_id", recipes.chunks(F.col("text")).alias("c"))
    one, two = [r.c for r in df.orderBy("doc_id").collect()]
    assert "".join(one) == text.encode().decode("latin-1")
    assert all(len(c) <= recipes.LONGEST for c in one) and len(one) > 10
    assert len(set(one) & set(two)) >= len(one) - 3  # a shifted text finds the same cuts again


def test_no_rows(spark, docs):
    assert recipes.exact_duplicates(docs([])).count() == 0

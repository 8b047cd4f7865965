"""Spelling variants against comparing every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from remitgraph.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b))) and len(b) == len(a) + 1


def neighbours(words):
    """Near words by the strings that are left when one place is deleted or left open."""
    seen = {}
    for w in words:
        for i in range(len(w)):
            seen.setdefault((w[:i], w[i + 1:]), []).append(w)
    out = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            out[w] |= {v for v in seen[w[:i], w[i + 1:]] if v != w}
            if (shorter := w[:i] + w[i + 1:]) in out:
                out[w].add(shorter)
                out[shorter].add(w)
    return out


def expected(counts, times=10):
    form, rows = {}, {}
    for w, others in neighbours(counts).items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
        rows[w] = len(others)
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, counts[w], rows[w], counts[form[w]] if form[w] else None


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_neighbours_of_the_test_itself():
    words = ["abc", "abcd", "abd", "bc", "aabc", "abcx"]
    assert neighbours(words) == {w: {v for v in words if near(w, v)} for w in words}


@pytest.mark.parametrize("most", [2, 5, 256])
def test_every_pair_is_found_once(spark, rows, most):
    rng = random.Random(most)
    counts = {}
    for alphabet, size in (("ab", 7), ("abc", 5), ("aé👍", 4), ("abcdefgh", 9), ("x", 40)):
        for _ in range(150):
            w = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, size)))
            counts[w] = rng.choice([1, 2, 3, 30, 31, 400, 5000])
    for cut in range(0, 60, 7):  # one hot prefix and one hot suffix
        counts["prefixprefix" + "q" * cut + "z"] = 2 + cut
        counts["q" * cut + "suffixsuffix"] = 20 * (1 + cut)
    assert rows(spelling.variants(frame(spark, counts), most=most)) == sorted(expected(counts), key=lambda r: tuple(str(v) for v in r))


def test_group_beyond_the_limit_of_one_place(spark, rows):
    """All words share every split they can get; what is left is compared whole."""
    counts = {"common" + chr(0x4E00 + i): i + 1 for i in range(300)} | {"common": 9_000, "commo": 7}
    assert rows(spelling.variants(frame(spark, counts), most=10)) == sorted(expected(counts), key=lambda r: tuple(str(v) for v in r))


def test_forms_lead_to_a_root(spark):
    counts = {"abcdefg" + "h" * i: 10 ** (i + 1) for i in range(7)}
    found = {r.word: r for r in spelling.variants(frame(spark, counts)).collect()}
    assert {r.root for r in found.values()} == {"abcdefg" + "h" * 6}
    assert found["abcdefgh"].form == "abcdefghh" and found["abcdefghhhhhh"].form is None


def test_hard_rows(spark, docs, rows):
    long = "y" * 5_000
    counts = {long: 2, long + "y": 30, "y" * 4_999 + "z": 1, "one": 1}
    assert rows(spelling.variants(frame(spark, counts))) == sorted(expected(counts), key=lambda r: tuple(str(v) for v in r))
    assert spelling.variants(frame(spark, {"": 1, None: 2, "a": 3})).count() == 1
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    clashing = frame(spark, {"abcd": 2, "abce": 50}).withColumns({"base": F.lit(1), "key": F.lit(2), "root": F.lit(3)})
    assert {r.form for r in spelling.variants(clashing).collect()} == {None, "abce"}
    words = docs([(1, "AbÀé x_É ab"), (None, None), (2, "")]).select(F.explode(spelling.runs(F.col("text"))).alias("word"))
    assert sorted(r.word for r in words.collect()) == ["ab", "abÀé", "x", "É"]


def test_query_on_documents(spark, rows):
    data = "/root/testdata/sf0.001"
    counts = Counter()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 31 == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert rows(queries.op12_spelling(spark, data)) == sorted(expected(kept), key=lambda r: tuple(str(v) for v in r))

"""Ranked search over ball trees against scoring every text for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitgraph.llm import balltree

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items, k=10):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_all, total = len(texts), sum(c.total() for _, c in texts)
    held = Counter(t for _, c in texts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, own in asked.items():
        scored = []
        for i, c in texts:
            m = 10 + (90 * c.total() * n_all) // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * held[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (minus, _, _, i) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, i, -minus


def found(spark, docs, given, items, **more):
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    return sorted((tuple(r) for r in balltree.search(docs(given), asked, **more).collect()), key=str)


@pytest.mark.parametrize("pairs", [40, 1 << 15])
def test_ranking(spark, docs, pairs):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    given += [(7, given[3][1]), (None, given[3][1]), (None, None), (900, ""), (901, " .,!"), (902, "long " * 50_000), (903, "É中 9")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()]
    items += [(items[0][0], "a second text of the first item: LONG 9"), (None, given[3][1][:300]), (500, None), (501, "nowhere0"), (502, "é中")]
    assert found(spark, docs, given, items, pairs=pairs, sample=20) == sorted(expected(given, items), key=str)


def test_few_texts_and_ties(spark, docs):
    given = [(i, "same words here") for i in range(30, 0, -1)] + [(99, "other"), (None, "same words here")]
    items = [(1, "words"), (2, "other same")]
    assert found(spark, docs, given, items) == sorted(expected(given, items), key=str)
    assert found(spark, docs, [], items) == [] and found(spark, docs, [(1, None)], items) == []
    assert found(spark, docs, given, []) == []


def tree_of(rng, texts, words):
    n = np.array([rng.randint(5, 60) for _ in range(texts)])
    pairs = sorted({(r, rng.randrange(words) if rng.random() < 0.5 else r % 4 * (words // 4)) for r in range(texts) for _ in range(12)})
    row, term = (np.array(x) for x in zip(*pairs))
    often = np.array([rng.randint(1, 9) for _ in pairs])
    items = [np.array(sorted(rng.sample(range(words), 6))) for _ in range(20)]
    weight = np.sort(np.array([rng.randint(1, 30_000) for _ in range(words)]))
    query = balltree.Query(items, weight, np.arange(words), texts, int(n.sum()), np.ones(len(items), dtype=np.int64))
    return query, balltree._tree(query, n, row, term, often)


def test_bounds_hold_and_prune():
    rng = random.Random(3)
    query, tree = tree_of(rng, 700, 200)
    at = {int(c): i for i, c in enumerate(tree.columns)}
    asked = np.zeros((len(tree.columns), len(query.items)), dtype=np.float32)
    for i, item in enumerate(query.items):
        asked[[at[t] for t in item.tolist() if t in at], i] = 1
    exact = tree.impacts @ (asked.astype(np.int64) * query.weight[tree.columns][:, None])
    bounds = tree.bounds(asked)
    leaves = [(i, m) for i, m in enumerate(tree.members) if m is not None]
    assert sorted(np.concatenate([m for _, m in leaves]).tolist()) == list(range(700))
    for i, members in leaves:
        assert (bounds[i] >= exact[members].max(axis=0)).all() and len(members) <= balltree.LEAF
        while i:
            i = (i - 1) // 2
            assert (bounds[i] >= exact[members].max(axis=0)).all()
    best = balltree.Best(query, 10)
    scored = balltree._search(query, tree, list(range(700)), best)
    for i, kept in enumerate(best.kept):
        assert [(-s, d) for s, _, d in kept] == sorted(((int(s), d) for d, s in enumerate(exact[:, i]) if s > 0),
                                                       key=lambda x: (-x[0], x[1]))[:10]
    assert scored < 700 * len(query.items) * 0.8  # not all subtrees are visited

"""Approximate nearest neighbours over a learned partition of the vectors.

A bounded sample gives a graph of nearest neighbours, whose nodes are dealt into parts of equal size so
that few edges are cut. A small classifier learns a vector's part from the vector. It puts every row of
the table into its likeliest part, and sends a query to its several likeliest parts; how many is
measured on the sample, as what finds ``RECALL`` of the true neighbours there. Within the parts
nearness is computed exactly.

Rows and queries of a part meet in blocks of bounded size, so neither a large part nor many copies of a
vector meet in one task; equal vectors in a block are computed once. Nearness is cosine in double
precision; ties go to the smaller id. Vectors that are null, zero, of another length than the sample's, or
that hold a null or a number that is not finite take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.llm.arrow import prepare
from remitgraph.plans.staging import stage

SAMPLE = 4_096  # vectors that partition and classifier are fitted on, about
PARTS = 32
GRAPH = 10  # neighbours of a node in the graph
ROWS = 16_384  # rows of a part that meet queries at a time, about
QUERIES = 1_024  # queries of a part that meet rows at a time, about
RECALL = 0.97  # aimed at on the sample; less is found elsewhere, where copies are fewer or more
HIDDEN = 128


@dataclass(frozen=True)
class Index:
    """A classifier of one hidden layer, and to how many parts a query goes."""

    first: np.ndarray
    shift: np.ndarray
    second: np.ndarray
    offset: np.ndarray
    probes: int

    @property
    def size(self) -> int:
        return len(self.first)

    def scores(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.first + self.shift, 0) @ self.second + self.offset


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every node."""
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    return np.argpartition(-near, min(k, len(unit) - 1) - 1, axis=1)[:, :k]


def partition(unit: np.ndarray, parts: int, rounds: int = 6, slack: float = 1.05) -> np.ndarray:
    """A part for each node: equal halves along the widest direction again and again, then nodes move to
    where most of their neighbours are, as long as there is room."""
    n = len(unit)
    label = np.zeros(n, dtype=np.int64)
    count = 1
    while count < parts:
        new = label * 2
        for p in range(count):
            inside = np.flatnonzero(label == p)
            if len(inside) > 1:
                centred = unit[inside] - unit[inside].mean(axis=0)
                along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
                new[inside[np.argsort(along, kind="stable")[len(inside) // 2:]]] += 1
        label, count = new, 2 * count
    near = _graph(unit, min(GRAPH, n - 1))
    room = math.ceil(slack * n / count)
    sizes = np.bincount(label, minlength=count)
    for _ in range(rounds):
        votes = np.zeros((n, count))
        for j in range(near.shape[1]):  # edges count in both directions
            np.add.at(votes, (np.arange(n), label[near[:, j]]), 1)
            np.add.at(votes, (near[:, j], label), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
    return label


def train(unit: np.ndarray, label: np.ndarray, parts: int, epochs: int = 30, seed: int = 7) -> Index:
    """The classifier, by gradient steps (Adam) on small groups of the sample."""
    random = np.random.default_rng(seed)
    d = unit.shape[1]
    weights = [random.normal(0, math.sqrt(2 / d) * math.sqrt(d) / 4, (d, HIDDEN)), np.zeros(HIDDEN),
               random.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(unit))
        for at in range(0, len(order), 128):
            some = order[at:at + 128]
            x = unit[some]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            z = hidden @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), label[some]] -= 1
            p /= len(some)
            back = (p @ weights[2].T) * (hidden > 0)
            slopes = [x.T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + 1e-4 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope ** 2
                weights[i] = weights[i] - 0.003 * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Index(*weights, probes=parts)


def build(vectors: np.ndarray, parts: int = PARTS, k: int = 5, recall: float = RECALL) -> Index:
    """Partition, classifier and number of probes from sampled vectors."""
    unit = _units(np.unique(vectors, axis=0))
    d = vectors.shape[1]
    if len(unit) < 4 * parts:  # too few to learn from: one part holds everything
        return Index(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    index = train(unit, partition(unit, parts), parts)
    scores = index.scores(unit)
    own = scores.argmax(axis=1)
    near = _graph(unit, k)
    rank = np.argsort(np.argsort(-scores, axis=1), axis=1)  # of every part, for every vector as a query
    needed = np.sort(rank[np.arange(len(unit))[:, None], own[near]].ravel())
    probes = int(needed[min(math.ceil(recall * len(needed)), len(needed)) - 1]) + 1
    return Index(index.first, index.shift, index.second, index.offset, min(probes, parts))


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, finite throughout, not all zero, and of the given length."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists(vector, lambda v: v != 0)
    fits = vector.isNotNull() & (F.size(vector) > 0) & good & some
    return F.coalesce(fits if size is None else fits & (F.size(vector) == size), F.lit(False))


def fit(vectors: DataFrame, sample: int = SAMPLE, **settings) -> Index | None:
    """The index from about ``sample`` usable vectors (vec_id, embedding), chosen by a hash of id and vector.

    Rows without an id are left out, copies count once. They come to the driver. None without any. If vectors differ in length, the commonest one (of equally
    common ones the longest) counts.
    """
    good = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = good.groupBy(F.size("embedding").alias("n")).count().collect()
    if not lengths:
        return None
    rows, size = max((r["count"], r["n"]) for r in lengths)
    scale = 1 << 30
    chosen = good.filter(F.size("embedding") == size).filter(
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(scale)) < math.ceil(scale * min(1.0, sample / rows)))
    table = chosen.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).distinct().orderBy("vec_id", "v").toArrow()
    values = np.array(table["v"].to_pylist(), dtype=np.float64).reshape(-1, size)
    return build(values, **settings) if len(values) else build(np.ones((1, size)), **settings)


def _routed(vectors: DataFrame, index: Index, probes: int) -> DataFrame:
    """id, v and the likeliest parts of every vector."""
    spark = vectors.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column("v")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, own.size)
            scores = own.scores(_units(values)) if len(values) else np.zeros((0, 1))
            parts = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), lists, pa.array(list(parts.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v", "parts"])

    return vectors.mapInArrow(run, "id long, v array<double>, parts array<int>")


def _meet(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest ids of each query in one block; an id counts by its nearest vector."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                          "score": pd.Series(dtype="float64")})
    if rows.empty or asked.empty:
        return empty
    different, which = np.unique(np.stack(rows["v"].to_numpy()), axis=0, return_inverse=True)
    # Different ids of each vector. Of equal vectors only the first k + 1 ids can be among the nearest k others.
    which, ids = np.unique(np.stack((which.reshape(-1), rows["id"].to_numpy())), axis=1)
    kept = np.arange(len(which)) - np.searchsorted(which, which) <= k
    which, ids = which[kept], ids[kept]
    members = np.split(ids, np.searchsorted(which, np.arange(1, len(different))))
    asked_ids, queries = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy())
    own, others = np.linalg.norm(queries, axis=1), np.linalg.norm(different, axis=1)
    near = (queries @ different.T) / (own[:, None] * others)
    # The k + 1 best vectors hold the k best ids whatever the query's own row is, unless an id has several of
    # them: then more vectors are looked at, for the queries that need it. What is as near as rounding is looked at too.
    open_, most, out = np.arange(len(asked_ids)), min(k + 1, len(different)), [empty]
    while len(open_):
        limit = -np.partition(-near[open_], most - 1, axis=1)[:, most - 1]
        q, v = np.nonzero(near[open_] >= (limit - 1e-9)[:, None])
        sure, q = near[open_[q], v] >= limit[q], open_[q]
        exact = np.concatenate([
            (queries[q[i:i + 65536]] * different[v[i:i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)])
        exact = exact / (own[q] * others[v])
        size = np.array([len(members[i]) for i in v])
        found = pd.DataFrame({"at": np.repeat(q, size), "query_id": np.repeat(asked_ids[q], size),
                              "vec_id": np.concatenate([members[i] for i in v]),
                              "score": np.repeat(exact, size), "sure": np.repeat(sure, size)})
        found = found[found["query_id"] != found["vec_id"]].sort_values(["at", "score", "vec_id"], ascending=[True, False, True])
        found = found.drop_duplicates(["at", "vec_id"])
        enough = np.bincount(found["at"][found["sure"]], minlength=len(asked_ids)) >= k
        done = open_ if most == len(different) else open_[enough[open_]]
        out.append(found[found["at"].isin(done)].groupby("at", sort=False).head(k)[["query_id", "vec_id", "score"]])
        open_, most = np.setdiff1d(open_, done), min(4 * most, len(different))
    return pd.concat(out[1:])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, index: Index | None = None, **settings) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query among all other vectors.

    Both tables have vec_id and embedding. All candidates, if fewer; no rows for queries that take no
    part, or without vectors. A row is not its own query's candidate; rows that repeat an id count once,
    with the nearest vector if they differ.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    index = index or fit(vectors, **settings)
    if index is None:
        return spark.createDataFrame([], schema)

    def plain(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        return df.filter(usable(v, index.size) & F.col("vec_id").isNotNull()).select(
            F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("v"))

    rows = stage(_routed(plain(vectors).distinct(), index, 1).select("id", "v", F.col("parts")[0].alias("part")), "vectors")
    asked = stage(_routed(plain(queries).dropDuplicates(["id"]), index, index.probes).select("id", "v", F.explode("parts").alias("part")), "queries")
    # Blocks of a part: at most as many numbers as there are parts come to the driver.
    n_rows = {r["part"]: max(1, math.ceil(r["count"] / ROWS)) for r in rows.groupBy("part").count().collect()}
    n_asked = {r["part"]: max(1, math.ceil(r["count"] / QUERIES)) for r in asked.groupBy("part").count().collect()}
    parts = sorted({*n_rows, *n_asked})
    plan = spark.createDataFrame([(p, n_rows.get(p, 1), n_asked.get(p, 1)) for p in parts], "part int, a int, b int")

    def blocks(df: DataFrame, mine: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.col(mine)).cast("int")
        return (df.join(F.broadcast(plan), "part")
                .select("id", "v", "part", at.alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)))

    near = (blocks(rows, "a", "b").groupBy("part", "a", "b")
            .cogroup(blocks(asked, "b", "a").groupBy("part", "a", "b"))
            .applyInPandas(lambda left, right: _meet(left, right, k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

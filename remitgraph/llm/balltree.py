"""Ranked lexical search: exact inner products, with subtrees of texts pruned in sparse ball trees.

A text is a vector of impacts, one for each of its terms; an item is a vector of weights; the score is
their product, in whole numbers. Only terms that the items ask about have a dimension: the others add
nothing to any product. Texts are turned into these vectors in one pass, written to the shared folder.
Items are taken in blocks of a bounded number of terms, so what is sent to tasks is bounded.

Every task builds balanced trees over its texts, some thousand at a time. A node knows the centroid of
its texts (weighted), for each range of terms the radius of a ball around it that holds them all, and for
each term the radius in that term alone. No text of the node can score more for an item than the centroid
does plus, range by range, the smaller of ball radius times norm of the item and of the sum of the item's
radii. Bounds are in single precision and raised by what rounding can cost at most. For each item, nodes
are visited best first until no bound reaches the score of the k-th text known so far; at leaves scores
are exact, in 64-bit integers. A bounded sample of texts gives every task a first score to beat.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remitgraph.llm.arrow import pieces, prepare, split, texts
from remitgraph.plans.staging import stage, top_per_group

K = 10
PAIRS = 1 << 15  # pairs of item and term in a block of items, about; an item is never divided
SAMPLE = 2_000  # texts that give the first scores to beat, about
TREE = 2_048  # texts of a tree, at most
CELLS = 1 << 22  # numbers of a tree's dense matrix, about
LEAF = 24  # texts of a leaf, at most
RANGES = 8  # of terms, from common to rare, each with a ball of its own

# Everything in ASCII but digits and letters.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Query:
    """Items as lists of terms, numbered from common to rare, and what scoring needs of the texts."""

    items: list[np.ndarray]
    weight: np.ndarray
    number: np.ndarray  # of each term as it is in the vectors
    texts: int
    terms: int
    beat: np.ndarray  # a score that the item's k-th text has at least


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, number of all terms, and the asked terms of each text (by number) with their occurrences."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(shared.value, pa.string())
        for batch in pieces(batches, most=4 << 20):
            bounds, words = split(pc.ascii_lower(texts(batch)), _BREAKS)
            number = pc.fill_null(pc.index_in(words, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            own = number >= 0
            pair, often = np.unique(row[own] * len(asked) + number[own], return_counts=True)
            row, number = np.divmod(pair, max(len(asked), 1))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(often.astype(np.int64)))],
                ["doc_id", "n", "terms", "often"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, often array<long>")


def _ranges(width: int) -> np.ndarray:
    """Where each range of columns begins, for columns in order of weight; empty ranges are left out."""
    return np.unique(np.arange(RANGES) * width // RANGES)


@dataclass
class Tree:
    """A balanced tree in one list: node i has children 2i + 1 and 2i + 2, leaves have texts."""

    columns: np.ndarray
    impacts: np.ndarray  # text x column, whole numbers
    weighted: np.ndarray = field(repr=False)
    centroid: list = field(default_factory=list)
    alone: list = field(default_factory=list)  # radius in each column
    ball: list = field(default_factory=list)  # radius in each range
    members: list = field(default_factory=list)

    def build(self) -> Tree:
        depth = max(0, math.ceil(math.log2(max(len(self.impacts), 1) / LEAF)))
        level = [np.arange(len(self.impacts))]
        for d in range(depth + 1):
            below = []
            for rows in level:
                own = self.weighted[rows]
                centre = own.mean(axis=0)
                own -= centre
                self._add(centre, own, rows if d == depth else None)
                if d < depth:
                    below += self._halves(own, rows)
            level = below
        return self

    def _add(self, centre: np.ndarray, around: np.ndarray, rows: np.ndarray | None) -> None:
        self.centroid.append(centre)
        self.alone.append(np.abs(around).max(axis=0))
        squares = np.add.reduceat(around * around, _ranges(around.shape[1]), axis=1)
        self.ball.append(np.sqrt(squares.max(axis=0)))
        self.members.append(rows)

    @staticmethod
    def _halves(around: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Two halves of equal size, by place between two texts that are far from each other."""
        one = around[np.einsum("ij,ij->i", around, around).argmax()]
        away = around - one
        other = around[np.einsum("ij,ij->i", away, away).argmax()]
        order = np.argsort(around @ (other - one), kind="stable")
        return [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """Node x item: what no text of the node can exceed. ``items`` is column x item, 0 or 1."""
        alone, ball, begin = np.stack(self.alone), np.stack(self.ball), _ranges(len(self.columns))
        found = np.stack(self.centroid) @ items
        for i, (a, b) in enumerate(zip(begin, [*begin[1:], len(self.columns)], strict=True)):
            norm = np.sqrt(items[a:b].sum(axis=0))
            found += np.minimum(alone[:, a:b] @ items[a:b], ball[:, i, None] * norm)
        # Sums of n numbers, none negative, lose at most n units in the last place of what they are made of.
        slack = 1 + 8 * (sum(self.impacts.shape) + 16) * 2.0 ** -24
        return found.astype(np.float64) * slack + 1


class Best:
    """The k best texts of every item so far, and the score that a further one has to reach."""

    def __init__(self, query: Query, k: int) -> None:
        self.k, self.kept = k, [[] for _ in query.items]
        self.reach = np.maximum(query.beat, 1).astype(np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        kept = self.kept[item]
        for i in np.flatnonzero(scores >= self.reach[item]):
            insort(kept, (-int(scores[i]), ids[i] is None, ids[i] if ids[i] is not None else 0))
        if len(kept) >= self.k:
            del kept[self.k:]
            self.reach[item] = max(self.reach[item], -kept[-1][0])


def _tree(query: Query, n: np.ndarray, row: np.ndarray, term: np.ndarray, often: np.ndarray) -> Tree:
    columns, at = np.unique(term, return_inverse=True)
    m = 10 + (90 * n * query.texts) // query.terms
    impacts = np.zeros((len(n), len(columns)), dtype=np.int64)
    impacts[row, at] = (1_000_000_000 * often) // (1000 * often + 8 * m[row])
    return Tree(columns, impacts, impacts.astype(np.float32) * query.weight[columns].astype(np.float32)).build()


def _search(query: Query, tree: Tree, ids: list, best: Best) -> int:
    """Offer all texts that may be among the best; returns how many were scored."""
    at = {int(c): i for i, c in enumerate(tree.columns)}
    own = [np.array([at[t] for t in item.tolist() if t in at], dtype=np.int64) for item in query.items]
    asked = np.zeros((len(tree.columns), len(own)), dtype=np.float32)
    for i, columns in enumerate(own):
        asked[columns, i] = 1
    bounds, scored = tree.bounds(asked), 0
    for i in np.flatnonzero(bounds[0] >= best.reach):
        if not len(own[i]):
            continue
        weight, of = query.weight[tree.columns[own[i]]], bounds[:, i]
        open_nodes = [(-of[0], 0)]
        while open_nodes and -open_nodes[0][0] >= best.reach[i]:
            _, node = heapq.heappop(open_nodes)
            rows = tree.members[node]
            if rows is None:
                for child in (2 * node + 1, 2 * node + 2):
                    if of[child] >= best.reach[i]:
                        heapq.heappush(open_nodes, (-of[child], child))
                continue
            scored += len(rows)
            best.offer(int(i), tree.impacts[np.ix_(rows, own[i])] @ weight, [ids[r] for r in rows])
    return scored


def _trees(query: Query, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, list]]:
    for batch in batches:
        often, terms = batch.column("often"), batch.column("terms")
        size = np.diff(np.asarray(terms.offsets)).astype(np.int64)
        first = np.asarray(terms.offsets)[0]
        flat = query.number[terms.values.to_numpy()[first:first + size.sum()]]
        many = often.values.to_numpy()[first:first + size.sum()]
        ends, n, ids = np.append(0, np.cumsum(size)), batch.column("n").to_numpy(), batch.column("doc_id").to_pylist()
        start = 0
        while start < batch.num_rows:
            stop = min(batch.num_rows, start + TREE)
            # Fewer texts where they have many different terms.
            while stop - start > LEAF and len(np.unique(flat[ends[start]:ends[stop]])) * (stop - start) > CELLS:
                stop = start + (stop - start) // 2
            part = slice(ends[start], ends[stop])
            row = np.repeat(np.arange(stop - start), size[start:stop])
            if len(row):
                yield _tree(query, n[start:stop], row, flat[part], many[part]), ids[start:stop]
            start = stop


def _found(sets: DataFrame, query: Query, names: list, kind, k: int) -> DataFrame:
    """The k best texts of every item from each task: item_id, doc_id, score."""
    shared = sets.sparkSession.sparkContext.broadcast(query)
    id_kind = sets.schema["doc_id"].dataType
    item_type, id_type = to_arrow_type(kind), to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for tree, ids in _trees(shared.value, batches):
            _search(shared.value, tree, ids, best)
        rows = [(names[i], None if none else of, -minus) for i, kept in enumerate(best.kept) for minus, none, of in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], id_type),
             pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return sets.filter("n > 0").mapInArrow(
        run, f"item_id {kind.simpleString()}, doc_id {id_kind.simpleString()}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return top_per_group(found, ["item_id"], order, k).withColumnRenamed("row_number", "rank")


def _block(docs: DataFrame, items: DataFrame, k: int, sample: int) -> DataFrame | None:
    """The search for the items of a block, rows (item_id, term)."""
    kind = items.schema["item_id"].dataType
    pairs = items.collect()
    if not pairs:
        return None
    terms = sorted({r.term for r in pairs})
    sets = stage(vectors(docs, terms), "vectors")
    total = sets.filter("n > 0").agg(F.count("*").alias("texts"), F.sum("n").alias("terms")).first()
    if not total.texts:
        return None
    held = np.zeros(len(terms), dtype=np.int64)
    for r in sets.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r.term] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.texts + 2) / (2 * int(n) + 1))) for n in held])
    by_name: dict = {}
    for r in pairs:
        by_name.setdefault(r.item_id, []).append(r.term)
    order = np.argsort(weight, kind="stable")  # ranges of terms go from common to rare
    number = np.empty(len(terms), dtype=np.int64)
    number[order] = np.arange(len(terms))
    place = {t: int(number[i]) for i, t in enumerate(terms)}
    names = list(by_name)
    query = Query([np.array(sorted(place[t] for t in by_name[x])) for x in names], weight[order], number,
                  total.texts, total.terms, np.ones(len(names), dtype=np.int64))
    scale = 1 << 30
    chosen = sets.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(scale)) < math.ceil(scale * min(1.0, sample / total.texts)))
    first = _ranked(_found(chosen, query, names, kind, k), k).filter(F.col("rank") == k).collect()
    beat = {r.item_id: r.score for r in first}
    beaten = replace(query, beat=np.array([beat.get(x, 1) for x in names], dtype=np.int64))
    return _found(sets, beaten, names, kind, k)


def search(docs: DataFrame, items: DataFrame, k: int = K, pairs: int = PAIRS, sample: int = SAMPLE) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` rows of ``docs`` that score highest for each item, from 1 up.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. Each row of
    ``docs`` counts as a text, repeated rows too; a null text has no terms. Rows of ``items`` with one id
    (null as well) are one item with the terms of all. Equal scores are in order of doc_id, null last. Rows
    that score 0 are left out, so an item without terms, or no texts, give no rows. Other columns are not
    looked at.
    """
    asked = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _BREAKS)
    terms = stage(items.select("item_id", F.explode(asked).alias("term")).filter("term <> ''").distinct(), "terms")
    blocks = max(1, math.ceil(terms.count() / pairs))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [_block(docs, terms.filter(own == b), k, sample) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], _ranked_schema(docs, items))
    return _ranked(reduce(DataFrame.unionByName, found), k).select("item_id", "rank", "doc_id", "score")


def _ranked_schema(docs: DataFrame, items: DataFrame) -> str:
    item, doc = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    return f"item_id {item}, rank int, doc_id {doc}, score long"

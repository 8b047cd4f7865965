"""Toxicity of texts and of their sentences, learned from labels of whole texts.

A text is a bag of sentences and toxic if any of them is: with p the chance of each sentence, the
text's is 1 - product(1 - p), a noisy-or. A sentence's chance is a logistic function of its words,
held in a fixed number of buckets. The weights are fitted so that the texts' chances agree with their
labels; no sentence is ever labelled. They then show which sentences are to blame.

Fitted on a bounded sample: about ``SAMPLE`` labelled texts of each label, chosen by a hash of the id.
Scoring covers whole texts of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitgraph.llm.arrow import code_points, mix, pieces, prepare, split, texts

SAMPLE = 3_000  # texts of each label that the model is fitted on, about
BUCKETS = 1 << 18
STEPS = 150
OFFENDING = 0.5
EVIDENCE = 3.8  # standard errors by which the rates of a word must differ

_SENTENCES = r"[.!?\n]+"
_WORDS = r"[^\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # a weight for each bucket
    bias: float


def _buckets(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.int64)
    points = code_points(words, "\n").astype(np.uint64)
    edge = np.flatnonzero(points == np.uint64(10))
    size = np.diff(edge) - 1
    place = np.arange(len(points)) - np.repeat(edge, np.diff(edge, append=len(points)))
    spread = mix(points * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    spread[edge] = 0
    sums = np.add.reduceat(spread, edge[:-1])
    return (mix(sums + size.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _features(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Where each text's sentences begin, where each sentence's words begin, the words' buckets, the sentences."""
    sentences, parts = split(strings, _SENTENCES)
    words, tokens = split(pc.utf8_lower(parts), _WORDS)
    coded = tokens.dictionary_encode()
    buckets = _buckets(coded.dictionary.to_pylist())
    return sentences, words, buckets[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else buckets, parts


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of stretches of values, 0 for an empty one."""
    before = np.concatenate(([0.0], np.cumsum(values)))
    return before[bounds[1:]] - before[bounds[:-1]]


def _chances(model: Model, sentences: np.ndarray, words: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of sentences and of texts."""
    z = _sums(model.weights[buckets], words) + model.bias
    # log(1 - p) of each sentence
    rest = -np.logaddexp(0.0, z)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500))), -np.expm1(_sums(rest, sentences))


def _evidence(inside: np.ndarray, outside: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Twice the log likelihood ratio of two rates of a word against one common rate."""
    def part(found: np.ndarray, all_: float) -> np.ndarray:
        rate = (inside + outside) / (toxic + clean)
        rest = all_ - found
        return (found * np.log(np.maximum(found, 1e-12) / np.maximum(all_ * rate, 1e-12)) +
                rest * np.log(np.maximum(rest, 1e-12) / np.maximum(all_ * (1 - rate), 1e-12)))

    return 2 * (part(inside, toxic) + part(outside, clean))


def _descend(sentences: np.ndarray, words: np.ndarray, buckets: np.ndarray, toxic: np.ndarray) -> Model:
    """Weights that make the texts' chances agree with their labels (Adam, all texts at each step)."""
    n = len(toxic)
    # Only words that stand in sentences of toxic and of other texts at clearly different rates get a
    # weight. A sentence that several texts share counts once, so copies are no evidence; nor is a
    # word that one text repeats.
    owner = np.repeat(np.arange(n), np.diff(sentences))
    sentence = np.repeat(np.arange(len(owner)), np.diff(words))
    # Near copies of a sentence mostly agree in the two words that come first by hash.
    by_hash = np.lexsort((mix(buckets.astype(np.uint64)), sentence))
    begin = np.concatenate(([0], np.cumsum(np.diff(words))))[:-1]
    some = np.diff(words) > 0
    sign = np.zeros(len(owner))
    sign[some] = buckets[by_hash[begin[some]]]
    more = np.diff(words) > 1
    sign[more] += BUCKETS * buckets[by_hash[begin[more] + 1]]
    once = np.unique(np.stack([sign, toxic[owner]]), axis=1, return_index=True)[1]
    single = np.zeros(len(owner), dtype=bool)
    single[once] = True
    some_text = np.repeat(owner, np.diff(words))  # the text of every word
    evidence, lifts = [], []
    for unit, label, picked in ((sentence, toxic[owner], single[sentence]), (some_text, toxic, slice(None))):
        pairs = np.unique((unit * BUCKETS + buckets)[picked])
        mark = label[pairs // BUCKETS]
        inside = np.bincount(pairs % BUCKETS, weights=mark, minlength=BUCKETS)
        outside = np.bincount(pairs % BUCKETS, weights=1 - mark, minlength=BUCKETS)
        bad = float(label[np.unique(pairs // BUCKETS)].sum())
        good = len(np.unique(pairs // BUCKETS)) - bad
        evidence.append(_evidence(inside, outside, bad, good))
        lifts.append(np.log((inside + 0.5) / (bad + 1)) - np.log((outside + 0.5) / (good + 1)))
    lift = lifts[0]
    used = (np.minimum(*evidence) >= EVIDENCE ** 2) & (lifts[0] * lifts[1] > 0)
    weights = np.where(used, np.clip(lift, -3, 3), 0.0)
    bias = -math.log(max(len(words) - 1, 1) / max(n, 1)) - 3.0
    weight_of = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, STEPS + 1):
        p, chance = _chances(Model(weights, bias), sentences, words, buckets)
        # d loss / d z: p for a clean text, p * (1 - 1 / chance) for a toxic one
        slope = weight_of[owner] * p * np.where(toxic[owner] == 1, 1 - 1 / np.maximum(chance[owner], 1e-9), 1.0)
        gradient = np.bincount(buckets, weights=np.repeat(slope, np.diff(words)), minlength=BUCKETS)
        gradient = np.append(np.where(used, gradient + 1e-5 * weights, 0.0), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        move = 0.15 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-7)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from texts (doc_id, text) and labels (doc_id, toxic).

    Of repeated labels of a text the largest holds; null ids, labels and texts are left out, rows that
    repeat id and text count once. About ``sample`` texts of each label are learned from, however many rows
    bear a chosen id. Without texts of both labels every weight is 0 and a sentence has a chance of 5 %.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked = (labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
              .filter("doc_id is not null and _toxic is not null").groupBy("doc_id").agg(F.max("_toxic").alias("_toxic")))
    sizes = {r["_toxic"]: r["count"] for r in marked.groupBy("_toxic").count().collect()}
    scale = 1 << 30
    most = {k: math.ceil(scale * min(1.0, sample / n)) for k, n in sizes.items()}
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) <
                           F.when(F.col("_toxic") == 1, most.get(1, 0)).otherwise(most.get(0, 0)))
    # The chosen labels are about 2 x ``sample`` rows, whatever the size of the corpus.
    known = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows_of = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    share = {k: math.ceil(scale * min(1.0, sample / n)) for k, n in rows_of.items()}
    known = known.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(scale)) <
                         F.when(F.col("_toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=4 << 20):
            sentences, words, buckets, _ = _features(texts(batch))
            per_text = [words[a:b + 1] for a, b in zip(sentences[:-1], sentences[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_toxic"),
                 pa.array([(w - w[0]).astype(np.int32).tobytes() for w in per_text], pa.binary()),
                 pa.array([buckets[w[0]:w[-1]].astype(np.int32).tobytes() for w in per_text], pa.binary())],
                ["doc_id", "_toxic", "words", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = known.mapInArrow(run, f"doc_id {kind}, _toxic int, words binary, buckets binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    if len({r["_toxic"] for r in rows}) < 2:
        return Model(np.zeros(BUCKETS), -3.0)
    per_text = [np.frombuffer(r["words"], dtype=np.int32) for r in rows]
    sizes_ = np.concatenate([np.diff(w) for w in per_text])
    return _descend(np.concatenate(([0], np.cumsum([len(w) - 1 for w in per_text]))),
                    np.concatenate(([0], np.cumsum(sizes_))).astype(np.int64),
                    np.concatenate([np.frombuffer(r["buckets"], dtype=np.int32) for r in rows]).astype(np.int64),
                    np.array([r["_toxic"] for r in rows], dtype=np.float64))


def _offending(text: str, parts: list[str], p: np.ndarray) -> list[dict]:
    out, at = [], 0
    for sentence, chance in zip(parts, p.tolist(), strict=True):
        at = text.index(sentence, at)
        if chance >= OFFENDING:
            out.append({"start": at, "end": at + len(sentence), "score": chance})
        at += len(sentence)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and the offending sentences (start, end, score; code points) of every row.

    Null and empty texts have no sentences, so their score is 0. Repeated rows are scored each; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            strings = texts(batch)
            sentences, words, buckets, parts = _features(strings)
            p, chance = _chances(shared.value, sentences, words, buckets)
            worst = np.maximum.reduceat(np.append(p, 0.0), sentences[:-1]) if len(strings) else p
            worst = np.where(np.diff(sentences) > 0, worst, 0.0)
            found = [_offending(strings[i].as_py(), parts.slice(sentences[i], sentences[i + 1] - sentences[i]).to_pylist(),
                                p[sentences[i]:sentences[i + 1]]) if worst[i] >= OFFENDING else []
                     for i in range(len(strings))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.clip(chance, 0.0, 1.0), pa.float64()), pa.array(found, span)],
                ["doc_id", "score", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, sentences array<struct<start: long, end: long, score: double>>")

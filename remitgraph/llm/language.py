"""Language identification of whole texts and of spans within them.

Script ranges narrow the candidates of each word to the languages that use its script. Every word
then has a score for each candidate, from character n-grams, and a Viterbi pass with a fixed penalty
for each switch of language labels the words of a text, so that a text in several languages falls
into spans. The language of the text is that of most of its letters.

N-grams are counted in a fixed number of buckets, so the model's size does not depend on the corpus.
It is fitted on a bounded sample: at most about ``SAMPLE`` texts of each language, chosen by a hash of
id and text, copies once. Everything else covers whole texts of all rows.
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

SAMPLE = 2_000  # texts per language that the model is fitted on, about
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)  # lengths of character n-grams
SWITCH = 10.0  # penalty of a change of language between two words
WORD_MOST = 6.0  # a single word speaks against a language by so much at most
FOREIGN = 12.0  # what a word in a script speaks against a language that does not use it
SHARE = 0.01  # a language uses a script if so much of its words is in it
UNKNOWN = "und"

# First code point, last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"),
    (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"),
    (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
    (0xF900, 0xFAFF, "han"), (0xFF66, 0xFF9F, "kana"), (0x20000, 0x2FA1F, "han"),
]
_SCRIPT_NAMES = ["other", *sorted({s for _, _, s in SCRIPTS})]
_FIRST = np.array([a for a, _, _ in SCRIPTS], dtype=np.int64)
_LAST = np.array([b for _, b, _ in SCRIPTS], dtype=np.int64)
_NUMBER = np.array([_SCRIPT_NAMES.index(s) for _, _, s in SCRIPTS], dtype=np.int64)

SLICE = 3 << 20  # bytes of text that are labelled at a time; a longer text stands alone

_EDGE = " "  # before and after a word
# A word begins with a letter: marks that follow no letter are part of what lies between words.
_BREAKS = r"[^\p{L}\p{M}]+\p{M}*"


@dataclass(frozen=True)
class Model:
    """Languages in order of name; log likelihoods per bucket; which script each language uses."""

    languages: list[str]
    table: np.ndarray  # bucket x language, centred
    uses: np.ndarray  # script x language


def _scripts(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    at = np.searchsorted(_FIRST, first, "right") - 1
    return np.where((at >= 0) & (first <= _LAST[at]), _NUMBER[at], 0)


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the words (by number) and the buckets of their n-grams."""
    points = code_points(words, _EDGE).astype(np.uint64)
    edge = points == np.uint64(ord(_EDGE))
    word = np.cumsum(edge) - 1  # an edge belongs to the word that follows
    rolled = points
    for n in ORDERS:
        if n > 1:
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
        whole = np.ones(len(rolled), dtype=bool)
        for i in range(n) if n == 1 else range(1, n - 1):
            whole &= ~edge[i:i + len(rolled)]
        if n > 1:
            whole &= ~(edge[:len(rolled)] & edge[n - 1:]) | (n > 2)
        at = np.flatnonzero(whole)
        own = np.minimum(word[at], len(words) - 1)
        yield own, (mix(rolled[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)


def _words(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's words begin (one more than texts), the words as numbers, the different words."""
    bounds, words = split(pc.binary_join_element_wise(_EDGE, pc.utf8_lower(strings), ""), _BREAKS)
    coded = words.dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the languages in ``lang``, from rows with a text and a language.

    About ``sample`` texts of each language are counted, by eight tasks; their counts, of a fixed
    size per language, come to the driver. No rows at all give a model without languages.
    """
    prepare(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_SCRIPT_NAMES), 0), dtype=bool))
    scale = 1 << 30
    most = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, math.ceil(scale * min(1.0, sample / n)))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < most[F.col("lang")]).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, most=SLICE):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                _, words, different = _words(texts(batch).filter(pa.array(langs == lang)))
                if not different:
                    continue
                often = np.bincount(words, minlength=len(different))
                own = grams.setdefault(lang, np.zeros(BUCKETS))
                for word, bucket in _grams(different):
                    own += np.bincount(bucket, weights=often[word], minlength=BUCKETS)
                scripts.setdefault(lang, np.zeros(len(_SCRIPT_NAMES)))
                scripts[lang] += np.bincount(_scripts(different), weights=often, minlength=len(_SCRIPT_NAMES))
        names = sorted(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([grams[n].tobytes() for n in names], pa.binary()),
             pa.array([scripts[n].tobytes() for n in names], pa.binary())], ["lang", "grams", "scripts"])

    rows = chosen.repartition(8).mapInArrow(count, "lang string, grams binary, scripts binary").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_SCRIPT_NAMES), 0), dtype=bool))

    def total(name: str) -> np.ndarray:
        return np.stack([sum(np.frombuffer(r[name]) for r in rows if r["lang"] == k) for k in languages], axis=1)

    counts, scripts = total("grams"), total("scripts")
    # A tenth of a count stands for what the sample does not show.
    table = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS))
    table -= table.max(axis=1, keepdims=True)
    return Model(languages, table / len(ORDERS), scripts >= SHARE * np.maximum(scripts.sum(axis=0), 1))


def _scores(model: Model, words: list[str]) -> np.ndarray:
    """Word x language: 0 for the best language of a word, below 0 for others."""
    k = len(model.languages)
    out = np.zeros((len(words), k))
    if not words or k == 0:
        return out
    for word, bucket in _grams(words):
        for j in range(k):
            out[:, j] += np.bincount(word, weights=model.table[bucket, j], minlength=len(words))
    uses = model.uses[_scripts(words)]
    narrowed = uses | ~uses.any(axis=1, keepdims=True)
    best = np.where(narrowed, out, -np.inf).max(axis=1, keepdims=True)
    scores = np.where(narrowed, np.maximum(out - best, -WORD_MOST), -FOREIGN)
    return np.where(uses.any(axis=1, keepdims=True), scores, 0.0)  # a script that no language uses says nothing


def _viterbi(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best language of every word. All texts are passed through side by side, a word at a time."""
    n, k = len(scores), scores.shape[1]
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start = bounds[:-1][order]
    active = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # texts longer than t words
    came = np.zeros((n, k), dtype=np.int8 if k < 128 else np.int16)  # the language before
    if not n:
        return np.zeros(0, dtype=np.int64)
    stay = np.arange(k, dtype=came.dtype)
    now = scores[start[:active[0]]]
    ending = {}
    for t in range(1, len(active)):
        m = active[t]
        if m < len(now):
            ending[t] = now[m:].argmax(axis=1)
            now = now[:m]
        best = now.argmax(axis=1)
        switched = now.max(axis=1) - SWITCH
        moves = now < switched[:, None]
        at = start[:m] + t
        came[at] = np.where(moves, best[:, None], stay)
        now = np.maximum(now, switched[:, None]) + scores[at]
    ending[len(active)] = now.argmax(axis=1)
    out = np.zeros(n, dtype=np.int64)
    state = np.zeros(0, dtype=np.int64)
    for t in range(len(active) - 1, -1, -1):
        if t + 1 in ending:
            state = np.concatenate((state, ending[t + 1]))
        at = start[:len(state)] + t
        out[at] = state
        state = came[at, state].astype(np.int64)
    return out


def _spans(text: str, words: list[str], labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of one language, in code points; each begins with its first word."""
    changes = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist()]
    low = text.lower()
    if len(low) != len(text):  # a letter that is longer in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    starts, at, wanted = [], 0, set(changes)
    for i, word in enumerate(words):
        found = low.find(word, at)
        at = max(found, at)
        if i in wanted:
            starts.append(at)
        at += len(word)
    starts[0] = 0
    return [{"start": a, "end": b, "lang": languages[labels[i]]}
            for i, a, b in zip(changes, starts, [*starts[1:], len(text)], strict=True)]


def _known(model: Model, strings: pa.Array) -> np.ndarray:
    """For each text, the share of its letters in spans of any language, each times how sure the span's language is."""
    if not model.languages:
        return np.zeros(len(strings))
    bounds, words, different = _words(strings)
    scores = _scores(model, different)[words]
    labels = _viterbi(scores, bounds)
    letters = np.array([len(w) for w in different], dtype=np.int64)[words] if len(words) else words
    text = np.repeat(np.arange(len(strings)), np.diff(bounds))
    starts = np.ones(len(words), dtype=bool)
    starts[1:] = (np.diff(labels) != 0) | (np.diff(text) != 0)
    span, first = np.cumsum(starts) - 1, np.flatnonzero(starts)
    k = len(model.languages)
    total = np.stack([np.bincount(span, weights=scores[:, j], minlength=len(first)) for j in range(k)], axis=1)
    ranked = np.sort(total, axis=1)
    sure = np.ones(len(first)) if k == 1 else 1 / (1 + np.exp(-np.minimum(ranked[:, -1] - ranked[:, -2], 50.0)))
    known = np.bincount(text, weights=letters * sure[span], minlength=len(strings))
    return known / np.maximum(np.bincount(text, weights=letters, minlength=len(strings)), 1)


def _label(model: Model, strings: pa.Array) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans of each text."""
    none = (UNKNOWN, 0.0, [])
    if not model.languages:
        return [none] * len(strings)
    bounds, words, different = _words(strings)
    by_word = _scores(model, different)
    size = np.array([len(w) for w in different], dtype=np.int64)
    letters = size[words] if len(words) else words
    scores = by_word[words]
    labels = _viterbi(scores, bounds)
    k = len(model.languages)
    text = np.repeat(np.arange(len(strings)), np.diff(bounds))
    share = np.stack([np.bincount(text, weights=letters * (labels == j), minlength=len(strings)) for j in range(k)], axis=1)
    total = np.stack([np.bincount(text, weights=scores[:, j], minlength=len(strings)) for j in range(k)], axis=1)
    changed = np.bincount(text[1:], weights=(np.diff(labels) != 0) & (np.diff(text) == 0), minlength=len(strings))
    out = []
    for i in range(len(strings)):
        if bounds[i] == bounds[i + 1]:
            out.append(none)
            continue
        best = int(share[i].argmax())
        # How far the words of the text, together, prefer some language to the next best one.
        first = np.sort(total[i])[::-1]
        sure = 1.0 if k == 1 else 1 / (1 + math.exp(-min(first[0] - first[1], 50.0)))
        own = share[i, best] / share[i].sum()
        whole = strings[i].as_py() if changed[i] else None
        spans = ([{"start": 0, "end": len(strings[i].as_py()), "lang": model.languages[best]}] if whole is None else
                 _spans(whole, [different[w] for w in words[bounds[i]:bounds[i + 1]].tolist()],
                        labels[bounds[i]:bounds[i + 1]], model.languages))
        out.append((model.languages[best], float(own * sure), spans))
    return out


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and spans (start, end, lang) of every row, from the text alone.

    ``und`` with score 0 and no spans is given for null and empty texts, texts without letters, and by a
    model without languages. The score is the share of letters in the language found, times how sure
    the choice of the best language is. Ties go to the first language by name. Repeated rows are
    labelled each; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=SLICE):
            found = _label(shared.value, texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], span)],
                ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def keep_known(docs: DataFrame, model: Model, beyond: float = 0.5) -> DataFrame:
    """Rows, with all their columns, of whose letters a share above ``beyond`` is found in languages of the model.

    Spans of all languages count together, each by how sure its language is; a span that says nothing, as
    one in a script that no language uses, counts half. So texts in several languages are kept too.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=SLICE):
            yield batch.filter(pa.array(_known(shared.value, texts(batch)) > beyond, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

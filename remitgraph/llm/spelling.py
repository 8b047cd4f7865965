"""Spelling variants: words that differ by one edit, found by comparing dense matrices of code points.

Two words are near if their common prefix and their common suffix together cover all but one code point
of the longer one. Words meet in groups: a word of length L is the shorter one of a pair in groups of
base L and the longer one in groups of base L - 1. A group stands for an interval of places; its words
agree before and after the interval. The place where the common prefix of a pair ends lies in exactly
one interval, so each pair is found once. Intervals begin as the two halves of a word. Groups of more
than ``GROUP`` words are split again, by halving their interval, until they are small or their interval
is a single place, where few different words are left. So no hot prefix needs a cap or many comparisons.

Tasks get whole groups, many at a time, as matrices of code points, one aligned to the left and one to
the right. The block of words that can be the shorter of a pair is compared with the block one row
further, two rows further and so on while groups reach. What leaves a task is, for each word, the number
of near words and the best of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitgraph.llm.arrow import prepare
from remitgraph.plans.staging import stage

GROUP = 256  # words of a group; larger ones are split
CELLS = 1 << 21  # code points of a matrix, about
TIMES = 10  # a form occurs so many times as often as its variant, at least

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]"


def runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of letters of a text that have ``least`` code points or more, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return F.transform(found, lambda run: F.translate(run, _UPPER, _LOWER))


def counted(words: DataFrame, least: int, often: int) -> DataFrame:
    """word and n of the different words of at least ``least`` code points that occur ``often`` times or more."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _key(a: Column, b: Column) -> Column:
    """What the words of a group agree in: everything outside of their interval."""
    before = F.substring("word", F.lit(1), a)
    after = F.substring("word", F.length("word") - (F.col("base") - b) + 1, F.col("base") - b)
    return F.xxhash64(before, after)


def _interval(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), _key(a, b).alias("key"))


def _halves(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    mid = F.floor((a + b) / 2).cast("int")
    return rows.select("word", "n", "base", F.inline(F.array(_interval(a, mid), _interval(mid, b))))


GROUP_KEY = ["base", "a", "b", "key"]


def _groups(counts: DataFrame, most: int) -> DataFrame:
    """Every word once for each group it is in; groups are small, or of a single place."""
    size = F.length("word").cast("int")
    rows = counts.select("word", "n", F.explode(F.array_compact(F.array(
        size, F.when(size > 1, size - 1)))).alias("base"))
    done, open_rows = None, stage(_halves(rows, F.lit(0), F.col("base")), "groups")
    while True:
        large = open_rows.groupBy(*GROUP_KEY).count().filter((F.col("count") > most) & (F.col("b") - F.col("a") > 1))
        large = stage(large.select(*GROUP_KEY), "large-groups")
        small = open_rows.join(large, GROUP_KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        open_rows = stage(_halves(open_rows.join(large, GROUP_KEY, "left_semi"), F.col("a"), F.col("b")), "groups")


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words aligned to the left and to the right, zeros beside them, and the lengths."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.uint8 if flat.max(initial=0) < 256 else np.uint32
    place = np.arange(width)
    left, right = np.zeros((len(words), width), dtype=kind), np.zeros((len(words), width), dtype=kind)
    left[place < size[:, None]] = flat
    right[place >= width - size[:, None]] = flat
    return left, right[:, ::-1], size


def _agree(x: np.ndarray, y: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """In how many first columns two matrices agree, row by row, at most the shorter length."""
    differ = x != y
    first = differ.argmax(axis=1)
    none = ~differ[np.arange(len(differ)), first]
    return np.minimum(np.where(none, x.shape[1], first), shorter)


def near_pairs(words: list[str], base: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words. Groups are contiguous, their words of length ``base`` first, ``end`` is where each group ends."""
    left, right, size = matrices(words, max((len(w) for w in words), default=0))
    active = np.flatnonzero(size == base)
    found_x, found_y = [], []
    for shift in range(1, len(words)):
        active = active[active + shift < end[active]]
        if not len(active):
            break
        for some in np.array_split(active, max(1, len(active) * left.shape[1] // CELLS)):
            other = some + shift
            shorter, longer = size[some], size[other]
            prefix = _agree(left[some], left[other], shorter)
            # The pair belongs to the interval in which its common prefix ends.
            own = (prefix >= a[some]) & ((prefix < b[some]) | (b[some] == base[some]))
            some, other, prefix, shorter, longer = some[own], other[own], prefix[own], shorter[own], longer[own]
            suffix = _agree(right[some], right[other], shorter)
            near = (prefix + suffix >= longer - 1) & ((prefix < shorter) | (longer > shorter))
            found_x.append(some[near])
            found_y.append(other[near])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_x), np.concatenate(found_y)) if found_x else (none, none)


def _best(words: list[str], n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """For each word with near words: how many, and the one of largest n, ties to the smallest."""
    word, near = np.concatenate((x, y)), np.concatenate((y, x))
    names = np.array(words, dtype=object)
    seen = np.unique(near)
    text_order = np.zeros(len(words), dtype=np.int64)
    text_order[seen[np.argsort(names[seen])]] = np.arange(len(seen))
    order = np.lexsort((text_order[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    many = np.diff(np.append(first, len(word)))
    return pa.RecordBatch.from_arrays(
        [pa.array(names[word[first]], pa.string()), pa.array(many, pa.int64()),
         pa.array(names[near[first]], pa.string()), pa.array(n[near[first]], pa.int64())],
        ["word", "n_near", "form", "form_n"])


def _begins(table: pa.Table) -> np.ndarray:
    """Where groups begin in sorted rows."""
    key = [table.column(c).to_numpy() for c in GROUP_KEY]
    return np.append(0, np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1)


def _compared(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
    many = np.diff(np.append(begins, table.num_rows))
    end = np.repeat(begins + many, many)
    words = table.column("word").to_pylist()
    base, a, b = [table.column(c).to_numpy().astype(np.int64) for c in GROUP_KEY[:3]]
    x, y = near_pairs(words, base, a, b, end)
    return _best(words, table.column("n").to_numpy(), x, y)


def _slices(bounds: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups (``bounds`` has their begins and the end) of bounded size, or of one group."""
    cells = np.append(0, base[bounds[1:] - 1] + 1)  # columns of a matrix that ends there; bases rise
    i = 0
    while i < len(bounds) - 1:
        fits = (bounds[i + 1:] - bounds[i]) * cells[i + 1:] <= CELLS
        step = max(1, int(fits.sum()) if not fits.all() else len(fits))
        yield int(bounds[i]), int(bounds[i + step])
        i += step


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups, as they come sorted; the last group of a batch may go on in the next one."""
    rest: pa.Table | None = None

    def compared(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start, stop in _slices(bounds, table.column("base").to_numpy()) if len(bounds) > 1 else ():
            inner = bounds[(bounds >= start) & (bounds < stop)] - start
            yield _compared(table.slice(start, stop - start), inner)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        bounds = _begins(table)
        yield from compared(table, bounds)
        rest = table.slice(bounds[-1]) if table.num_rows else None
    if rest is not None:
        yield from compared(rest, np.array([0, rest.num_rows]))


def near_words(counts: DataFrame, most: int = GROUP) -> DataFrame:
    """word, n_near, form and form_n of the words that have near words: how many, and the one of largest n."""
    prepare(counts.sparkSession)
    rows = _groups(counts, most).repartition(*[F.col(c) for c in GROUP_KEY])
    rows = rows.sortWithinPartitions(*GROUP_KEY, F.length("word"))
    partial = rows.mapInArrow(_compare, "word string, n_near long, form string, form_n long")
    best = partial.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """For each word with a form, the last of the forms that follow. Each step doubles how far a word looks."""
    ahead = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = stage(ahead.join(further, F.col("root") == F.col("_word"), "left"), "roots")
        if longer.filter("_root is not null").isEmpty():
            return longer.select("word", "root")
        ahead = longer.select("word", F.coalesce("_root", "root").alias("root"))


def variants(counts: DataFrame, times: int = TIMES, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``counts`` (word, n; different words).

    Words are near if one code point inserted, deleted or replaced makes one the other. The form of a word
    is its near word of largest n, ties to the smallest in code-point order, if that n is ``times`` the
    word's n or more; else form and form_n are null. The root is the last form that is reached from form to
    form, the word itself if it has none; counts grow on the way, so there is no circle. Null and
    empty words are left out. No words give no rows.
    """
    counts = stage(counts.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''"), "words")
    near = counts.join(near_words(counts, most), "word", "left")
    lasting = F.col("form_n") >= times * F.col("n")
    found = stage(near.select(
        "word", F.when(lasting, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(lasting, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Secrets in texts: fixed patterns, and long strings that look random.

Two Markov models give the chance of each character after the one before it: one learned from random
strings, one from ordinary words and identifiers. What the patterns leave of the text is looked at in
runs of identifier characters; a stretch of a run is a secret if its log-likelihood ratio is large
enough, so a key after a long path is found without the path. The models are two tables of fixed size,
learned from labelled samples. Everything is built of DataFrame functions.

Work grows in proportion to a text's length, however many matches it has: positions come from running
sums in two levels, text is put together from a list of its characters, and overlaps from a running
maximum of ends over the sorted spans.

Places are code points, ends exclusive. Null and empty texts have no secrets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]  # in the order of spans with the same start

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# Runs of 10 characters or more; a plain word, capital or not, is looked at from 20 letters on.
CANDIDATE = r"(?![A-Z]?[a-z]{1,18}(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{10,}+={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
LEAST_RATIO = 10.0  # nats by which a stretch must be more likely random
DROP = 10.0  # nats by which the ratio may fall within a stretch
CROSSING = 4.0  # nats that a stretch pays to go on beyond one of ``/_-``
CHUNK = 256  # values that are folded at a time
SAMPLE = 1_500  # documents that the models are fitted on, about

_SPANS = "array<struct<start: int, end: int, value: string>>"
_NONE = f"cast(array() as {_SPANS})"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers what ``combine`` makes of those before it, from 0 on, and at the end of all."""

    def fold(numbers: Column, start: Column) -> Column:
        return F.aggregate(numbers, F.array(start),
                           lambda done, v: F.array_append(done, combine(F.element_at(done, -1), v)))

    def within(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), combine))
        return _let(fold(totals, F.lit(0)), lambda before: F.concat(
            F.flatten(F.transform(chunks, lambda c, k: F.slice(fold(c, F.get(before, k)), F.lit(1), F.size(c)))),
            F.array(F.element_at(before, -1))))

    def chunked(numbers: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int"))
        chunks = F.transform(places, lambda k: F.slice(numbers, k * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(numbers) > 0, _let(chunks, within)).otherwise(F.array(F.lit(0)))

    return _let(values, chunked)


def _found(text: Column, pattern: str, value: int, quick: Column) -> Column:
    """Matches of a pattern (start, end, and a group as ``value``), from what lies between them.

    ``quick`` says, at little cost, whether a text has any.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))

    def spans(matches: Column) -> Column:
        sizes = F.transform(matches, lambda m: F.char_length(m["all"]))
        steps = F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")),
                            lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0)))
        return _let(_running(steps, lambda a, b: a + b), lambda ends: F.transform(matches, lambda m, i: F.struct(
            (F.get(ends, i + 1) - F.char_length(m["all"])).alias("start"), F.get(ends, i + 1).alias("end"),
            m["value"].alias("value"))))

    matches = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                           F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"))
    return F.when(quick, _let(matches, spans)).otherwise(F.expr(_NONE))


def _with_base(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The given columns, ``_text`` without nulls, and the matches of each base kind."""
    plain = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    text = F.col("_text")
    assign = _found(text, ASSIGN, 2, text.rlike(ASSIGN))
    return plain.select(
        "*", F.filter(assign, lambda m: F.char_length(m["value"]) >= ASSIGN_LEAST).alias("_assign"),
        _found(text, ACCESS, 0, F.contains(text, F.lit("AKIA"))).alias("_access"),
        _found(text, HEX, 0, text.rlike("[0-9a-f]{16}")).alias("_hex"))


def samples(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Labelled strings (value, random) from about ``bound`` documents, chosen by a hash of id and text, copies once.

    Random are the values that the base patterns find, and digests of the ids written in hex, in
    base 64 and in capitals; ordinary are words, and neighbouring words joined as identifiers are.
    """
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    scale = 1 << 30
    chosen = docs.select("doc_id", "text").filter(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < math.ceil(scale * min(1.0, bound / max(rows, 1)))).distinct()
    base = _with_base(chosen, [F.col("doc_id").cast("string").alias("_id")])
    digest = F.sha2(F.coalesce("_id", F.lit("")), 256)
    in_64 = F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9+/]", "")
    random = F.concat(F.transform(F.concat("_assign", "_access", "_hex"), lambda m: m["value"]),
                      F.array(digest, in_64, F.upper(in_64)))
    word = F.regexp_extract_all("_text", F.lit("[A-Za-z]{2,}+"), F.lit(0))
    joined = F.transform("_words", lambda w, i: F.concat(
        w, F.when(i % 4 == 0, "_").when(i % 4 == 1, "-").when(i % 4 == 2, "/").otherwise(""),
        F.coalesce(F.get("_words", i + 1), F.lit(""))))
    return (base.select(random.alias("_random"), word.alias("_words"))
            .select(F.explode(F.concat(F.transform("_random", lambda v: F.struct(v.alias("value"), F.lit(1).alias("random"))),
                                       F.transform(joined, lambda v: F.struct(v.alias("value"), F.lit(0).alias("random")))))
                    .alias("s")).select("s.value", "s.random"))


def fit(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of every character after every other.

    ``labelled`` has strings (value) and labels (random, 1 or 0); nulls are left out. Pairs never seen
    count half. At most 2 x 67 x 67 counts come to the driver.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    counts = (labelled.filter("value is not null and random in (0, 1) and char_length(value) > 1")
              .select("random", F.explode(pairs).alias("pair"))
              .filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect())
    n = len(ALPHABET)
    table = {0: [[0.5] * n for _ in range(n)], 1: [[0.5] * n for _ in range(n)]}
    for r in counts:
        table[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    chance = {k: [[math.log(v / sum(row)) for v in row] for row in t] for k, t in table.items()}
    return [chance[1][i][j] - chance[0][i][j] for i in range(n) for j in range(n)]


def _stretches(run: Column, model: list[float]) -> Column:
    """The stretches (start, end, from 0) of a run whose log-likelihood ratio reaches ``LEAST_RATIO``.

    A stretch begins where the ratio was last 0 and ends at its highest; it is over when the ratio has
    fallen to 0 or by ``DROP``. Going on beyond ``/_-`` costs ``CROSSING``. It is then widened to the nearest of ``/_-`` or the ends of the run, since
    the first and last characters of a key may look ordinary. Characters beyond the alphabet count 0.
    """
    table = F.from_json(F.lit(json.dumps([round(v, 6) for v in model])), "array<double>")
    begin = F.expr("struct(0 as at, 0 as start, 0D as sum, 0D as top, 0 as end, "
                   "cast(array() as array<struct<start: int, end: int>>) as out)")

    def closed(state: Column) -> Column:
        found = F.array(F.struct(state["start"].alias("start"), state["end"].alias("end")))
        return F.when(state["top"] >= LEAST_RATIO, F.concat(state["out"], found)).otherwise(state["out"])

    def step(state: Column, ratio: Column) -> Column:
        total = state["sum"] + ratio
        over = (total <= 0) | (total < state["top"] - DROP)
        higher = total > state["top"]
        after = state["at"] + 1
        return F.struct(
            after.alias("at"), F.when(over, after).otherwise(state["start"]).alias("start"),
            F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, 0.0).when(higher, total).otherwise(state["top"]).alias("top"),
            F.when(higher, after + 1).otherwise(state["end"]).alias("end"),
            F.when(over, closed(state)).otherwise(state["out"]).alias("out"))

    marks = [ALPHABET.index(c) + 1 for c in "/_-"]

    def ratios(places: Column) -> Column:
        return F.transform(places, lambda a, i: F.when(a.isin(marks), -CROSSING).when(
            (a > 0) & (F.get(places, i + 1) > 0),
            F.get(table, (a - 1) * len(ALPHABET) + F.get(places, i + 1) - 1)).otherwise(0.0))

    def breaks(places: Column) -> Column:
        """For each place, where the part that it is in begins."""
        return _running(F.transform(places, lambda a, i: F.when(a.isin(marks), i + 1).otherwise(0)), lambda a, b: F.greatest(a, b))

    def widened(places: Column, found: Column) -> Column:
        edges = F.struct(breaks(places).alias("first"), breaks(F.reverse(places)).alias("last"), F.size(places).alias("n"))
        return _let(edges, lambda e: F.array_distinct(F.transform(found, lambda s: F.struct(
            F.least(s["start"], F.get(e["first"], s["start"])).alias("start"),
            F.greatest(s["end"], e["n"] - F.get(e["last"], e["n"] - s["end"])).alias("end")))))

    def judged(places: Column) -> Column:
        return _let(F.aggregate(_let(places, ratios), begin, step, closed),
                    lambda found: F.when(F.size(found) > 0, widened(places, found)).otherwise(found))

    return _let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c)), judged)


def _covered(spans: Column) -> Column:
    """For sorted spans, where the text before each is already covered to; at the end, where all are."""
    return _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with each covered stretch replaced by ``put`` of its begin and end; spans are sorted.

    A span that begins within an earlier one gets ``put`` for what it covers beyond it.
    """
    def joined(parts: Column) -> Column:
        letters, before, own = parts["letters"], parts["before"], parts["own"]
        pieces = F.transform(own, lambda s, i: F.concat(
            F.slice(letters, F.get(before, i) + 1, F.greatest(s["start"] - F.get(before, i), F.lit(0))),
            F.array(put(s, F.get(before, i)))))
        rest = F.slice(letters, F.element_at(before, -1) + 1, F.size(letters))
        return F.array_join(F.concat(F.flatten(pieces), rest), "")

    return _let(F.struct(F.split(text, "").alias("letters"), _covered(spans).alias("before"), spans.alias("own")), joined)


def _scanned(docs: DataFrame, columns: list[Column], model: list[float]) -> DataFrame:
    """The given columns, ``_text``, the matches of each base kind, and ``_spans`` (start, rank, end) of all kinds."""

    def ranked(name: str, rank: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    def blank(span: Column, before: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(span["start"], before), F.lit(0)))

    based = _with_base(docs, columns).withColumn(
        "_base", F.array_sort(F.concat(ranked("_assign", 0), ranked("_access", 1), ranked("_hex", 2))))
    # What is left to judge keeps its place: base spans become blanks.
    left = based.withColumn("_left", F.when(F.size("_base") > 0, _replaced(F.col("_text"), F.col("_base"), blank))
                            .otherwise(F.col("_text")))
    runs = _found(F.col("_left"), CANDIDATE, 0, F.col("_left").rlike(CANDIDATE))
    judged = left.withColumn("_markov", F.flatten(F.transform(runs, lambda run: F.transform(
        _stretches(run["value"], model), lambda s: F.struct(
            (run["start"] + s["start"]).alias("start"), F.lit(3).alias("rank"), (run["start"] + s["end"]).alias("end"))))))
    return judged.withColumn("_spans", F.array_sort(F.concat("_base", "_markov")))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat(F.get(kinds, s["rank"]), F.lit(":"), s["start"], F.lit(":"), s["end"])))


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    ``spans`` are kind:start:end, comma-joined, by start and then in the order of ``KINDS``;
    ``base_sha256`` is the digest of those of the base kinds. Spans of the base kinds may overlap; the
    Markov models look at all that these leave, also right beside them. Repeated rows have a row each.
    """
    found = _scanned(docs, [F.col("doc_id")], model)
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))


def mask(docs: DataFrame, model: list[float], put: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced and ``n_chars``, if there, counted anew."""
    own = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]  # no clash with the names used here

    def once(span: Column, before: Column) -> Column:
        return F.when(span["start"] >= before, put).otherwise("")

    found = _scanned(docs, own, model)
    new = found.withColumn("_new", F.when(F.size("_spans") > 0, _replaced(F.col("_text"), F.col("_spans"), once)))
    kinds = dict(docs.dtypes)

    def changed(i: int, name: str) -> Column:
        if name == "text":
            return F.coalesce("_new", f"in_{i}")
        if name == "n_chars":
            return F.when(F.col("_new").isNotNull(), F.char_length("_new")).otherwise(F.col(f"in_{i}")).cast(kinds[name])
        return F.col(f"in_{i}")

    return new.select(*[changed(i, c).alias(c) for i, c in enumerate(docs.columns)])

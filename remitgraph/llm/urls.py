"""URL filters: allow and block rules, and naive Bayes over host words and path tokens for the rest.

Names in hosts often run several words together. Each label of a host is split by a unigram Viterbi
pass: candidates are those of its substrings that are words of the corpus, found by a join with the
word counts, so no vocabulary has to fit anywhere, and stretches of any letters, the less likely the
longer. What a host's own pages say never makes its label a word. Only different labels are split. A multinomial
naive Bayes model over the words of hosts and the tokens of paths, counted in a fixed number of
buckets, judges what no rule fits; it learns from the urls that rules do fit, and from a few
words that are known to be good or bad, counted as so many urls. What a rule itself tests (its parts
of hosts and paths) is no feature, so the model cannot just repeat the rules, and both verdicts count
as much whatever their numbers of urls. ``agreement`` states how well it does on hosts it has not seen.

A null url, or one without ``://``, has an empty host and an empty path. Of a very long label only
pieces of ``PIECE`` characters are looked up at a time; repeated rows have a row each; a table without rows has none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitgraph.llm.arrow import prepare
from remitgraph.plans.staging import stage

LOOKUP = 24  # characters by which words are looked up; what a longer word has beyond them is compared then
PIECE = 1024  # places of a label whose substrings are looked up by one row
SHORT, SHORT_COST = 3, 6.0  # a part of fewer letters, beside others, is less likely by so many nats for each that is missing
LETTERS = 26  # a word that was never seen is spelt with so many letters, each as likely
BUCKETS = 1 << 16
ALLOW, BLOCK = "allow", "block"
# Rules: host and path it fits, verdict. A parameter; these are the production values.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
         ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
# Words that speak for a verdict, and as how many urls each of them counts. A parameter.
KNOWN = {BLOCK: ("casino", "bets", "pills", "spam", "adult", "ads", "track", "porn", "viagra", "cheap", "win", "free"), ALLOW: ()}
KNOWN_WEIGHT = 0.02  # of all urls that a rule fits

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    host = F.coalesce(lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path joined) and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def labels_of(host: Column) -> Column:
    """The parts of a host between dots, hyphens and the like."""
    return F.filter(F.split(host, r"[^\p{L}\p{N}]+", -1), lambda p: p != "")


def word_counts(pages: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Words, how often they occur (n), and how much of that stands for labels of hosts (own).

    Words of titles and paths count wherever they occur, but not those that a host says of its own labels.
    A label counts once for every different host that has it beyond the first, a word known once more.
    """
    host, path = host_and_path(F.col("url"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>([^<]*)</title>", 1)
    split = pages.select(labels_of(host).alias("labels"),
                         F.concat(labels_of(lower(path)), labels_of(F.lower(title))).alias("words"))
    said = split.select(F.explode(F.filter("words", lambda w: ~F.array_contains("labels", w))).alias("word"))
    named = pages.select(host.alias("host")).distinct().select(F.explode(F.array_distinct(labels_of(F.col("host")))).alias("word"))
    listed = pages.sparkSession.createDataFrame([(w,) for w in known], "word string")
    both = said.withColumn("own", F.lit(0)).unionByName(named.withColumn("own", F.lit(1))).unionByName(listed.withColumn("own", F.lit(0)))
    own = F.greatest(F.sum("own") - 1, F.lit(0))
    return (both.groupBy("word")
            .agg((F.count(F.lit(1)) - F.sum("own") + own).alias("n"), own.alias("own")).filter("n > 0"))


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label and its words (an array) for every different label; what no words cover stays together.

    The likeliest split under the word counts. A stretch of letters that is no word is as likely as a new
    word is (by the share of words counted once) and its spelling. The label itself counts as a word
    only as often as others say it, without ``own`` if the counts have it. Short words are less likely parts. Of equally likely splits
    the one with the longer last word holds.
    """
    prepare(labels.sparkSession)
    if "own" not in counts.columns:
        counts = counts.withColumn("own", F.lit(0))
    sums = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).first()
    total = sums["n"] or 1
    new = math.log((sums["once"] + 1) / (total + 1)) if sums["once"] < total else 0.0
    # A label may be very long, so its pieces and candidates carry a digest of it.
    different = labels.select("label").distinct().withColumn("id", F.unhex(F.sha2("label", 256)))
    pieces = different.select("id", F.explode(F.sequence(F.lit(1), F.char_length("label"), F.lit(PIECE))).alias("from"), "label").select(
        "id", "from", F.substring("label", F.col("from"), F.lit(PIECE + LOOKUP - 1)).alias("piece"))
    n = F.char_length("piece")
    starts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(PIECE))), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LOOKUP), n - i + 1)),
        lambda k: F.struct((F.col("from") + i - 1).alias("at"), F.substring("piece", i, k).alias("start"))))
    parts = pieces.select("id", F.explode(F.flatten(starts)).alias("part")).select("id", "part.at", "part.start")
    hits = parts.join(counts.withColumn("start", F.substring("word", 1, LOOKUP)), "start")
    whole = different.withColumnRenamed("label", "_label")
    longer = (hits.filter(F.char_length("word") > LOOKUP).join(whole, "id")
              .filter(F.substring("_label", F.col("at"), F.char_length("word")) == F.col("word")).drop("_label"))
    size = F.char_length("word")
    own = F.when(F.col("id") == F.unhex(F.sha2("word", 256)), F.col("own")).otherwise(0)
    scored = (hits.filter(size <= LOOKUP).unionByName(longer)
              .select("id", F.struct("at", size.alias("size"), (F.col("n") - own).alias("n")).alias("part"))
              .filter("part.n > 0").groupBy("id").agg(F.collect_list("part").alias("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("label").to_pylist()
            out = [_viterbi(a, p or [], total, new) for a, p in zip(names, batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return different.join(scored, "id", "left").select("label", "parts").mapInArrow(run, "label string, words array<string>")


def _viterbi(label: str, parts: list[dict], total: int, new: float) -> list[str]:
    n = len(label)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for p in parts:
        cost = SHORT_COST * max(SHORT - p["size"], 0) if p["size"] < n else 0.0
        ending[p["at"] - 1 + p["size"]].append((p["at"] - 1, math.log(p["n"] / total) - cost))
    letter = -math.log(LETTERS)
    # The best split up to each place whose last part is a word, or a stretch of letters, and where that part begins.
    word, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
    odd, began = [-math.inf] * (n + 1), [0] * (n + 1)
    long, opened = [-math.inf] * (n + 1), [0] * (n + 1)  # of stretches that are not short
    for end in range(1, n + 1):
        for start, value in sorted(ending[end]):
            if max(word[start], odd[start]) + value > word[end]:
                word[end], came[end] = max(word[start], odd[start]) + value, start
        least = min(SHORT, n)
        if end >= least:
            long[end], opened[end] = max((long[end - 1] + letter, opened[end - 1]),
                                         (word[end - least] + new + least * letter, end - least))
        odd[end], began[end] = max([(long[end], opened[end]), *[
            (word[end - size] + new + size * letter - SHORT_COST * (SHORT - size), end - size)
            for size in range(1, min(least, end + 1))]])
    words: list[str] = []
    end, strange = n, False  # a stretch follows a word only
    while end > 0:
        strange = not strange and odd[end] > word[end]
        start = began[end] if strange else came[end]
        words.append(label[start:end])
        end = start
    return words[::-1]


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def tested(rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """The tokens that rules test: parts of their hosts, and those of their paths after a slash."""
    def parts(text: str) -> list[str]:
        return [p for p in re.split(r"[\W_]+", text) if p]

    return sorted({p for host, _, _ in rules for p in parts(host)} | {f"/{p}" for _, path, _ in rules for p in parts(path.lower())})


def fit(tokens: DataFrame, known: dict[str, Sequence[str]] = KNOWN, weight: float = KNOWN_WEIGHT) -> np.ndarray:
    """Log odds of block over allow for every bucket.

    ``tokens`` has the tokens and the verdict (null where there is none) of every url. Counts of
    a fixed number of buckets come to the driver. Those of both verdicts are brought to the same sum
    before one is added to each, so neither the prior nor a token never seen speaks for either. Without
    any verdicts all odds are even but for the words known.
    """
    marked = tokens.filter("verdict is not null")
    rows = marked.select("verdict", F.explode("tokens").alias("t")).groupBy("verdict", _bucket(F.col("t")).alias("b")).count().collect()
    urls = marked.count()
    counts = {ALLOW: np.zeros(BUCKETS), BLOCK: np.zeros(BUCKETS)}
    for r in rows:
        counts[r["verdict"]][r["b"]] += r["count"]
    words = [(v, w) for v, ws in known.items() for w in ws]
    if words:
        spark = tokens.sparkSession
        places = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for _, w in words], "w string")
                  .select("w", _bucket(F.col("w")).alias("b")).collect()}
    mean = sum(c.sum() for c in counts.values()) / 2
    for c in counts.values():
        c *= mean / c.sum() if c.sum() else 0.0
        c += 1
    for verdict, word in words:
        counts[verdict][places[word]] += 1 + weight * urls
    return np.log(counts[BLOCK] / counts[BLOCK].sum()) - np.log(counts[ALLOW] / counts[ALLOW].sum())


def tokens_of(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES),
              known: dict[str, Sequence[str]] = KNOWN) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, or null), words of the host, and tokens: what the model may see."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = split.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = base.select("host").distinct().select("host", labels_of(F.col("host")).alias("labels"))
    parts = hosts.select("host", F.posexplode("labels").alias("at", "label"))
    segmented = segment(parts, word_counts(pages, sorted({w for words in known.values() for w in words})))
    by_host = stage(parts.join(segmented, "label").groupBy("host")
                    .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"])).alias("words")),
                    "hosts")
    empty = F.array().cast("array<string>")
    tokens = F.concat(F.coalesce("words", empty), F.transform(labels_of(lower(F.col("path"))), lambda t: F.concat(F.lit("/"), t)))
    return stage(base.join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule", "verdict", F.coalesce("words", empty).alias("words"),
        F.filter(tokens, lambda t: ~t.isin(tested(rules))).alias("tokens")), "urls")


def odds_of(tokens: DataFrame, odds: np.ndarray) -> DataFrame:
    """The columns of ``tokens_of`` but the tokens, and odds: the sum of what the tokens say."""
    model = tokens.sparkSession.sparkContext.broadcast(odds)
    kept = [c for c in tokens.columns if c != "tokens"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            lists = batch.column("buckets")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(np.diff(np.asarray(lists.offsets)))
            sums = np.concatenate(([0.0], np.cumsum(table[flat])))
            values = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, pa.float64())], [*kept, "odds"])

    hashed = tokens.select(*kept, F.transform("tokens", _bucket).alias("buckets"))
    return hashed.mapInArrow(run, f"{schema}, odds double")


# Odds are differences of running sums over a batch, so a sum that is none may be some 1e-12 off.
def _says() -> Column:
    return F.when(F.col("odds") > 1e-9, BLOCK).otherwise(ALLOW)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES),
          known: dict[str, Sequence[str]] = KNOWN) -> DataFrame:
    """page_id, host, path, rule, verdict, words, odds of every row.

    ``words`` are the host's, split; ``odds`` are the method's log odds of block, whatever the rule
    says. Without a rule the verdict is block if they are above 0. Repeated rows have a row each.
    """
    prepare(pages.sparkSession)
    tokens = tokens_of(pages, rules, known)
    return odds_of(tokens, fit(tokens, known)).withColumn("verdict", F.coalesce("verdict", _says()))


def agreement(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES),
              known: dict[str, Sequence[str]] = KNOWN, folds: int = 5) -> DataFrame:
    """verdict of the rule, predicted, n: the model on urls that rules fit, of the one in ``folds`` hosts left out of the fit."""
    prepare(pages.sparkSession)
    tokens = tokens_of(pages, rules, known)
    out = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    held = tokens.filter(out & F.col("verdict").isNotNull())
    return (odds_of(held, fit(tokens.filter(~out), known)).withColumn("predicted", _says())
            .groupBy("verdict", "predicted").agg(F.count(F.lit(1)).alias("n")))

"""Document fingerprints from closed syncmers.

Of the k-mers of a text those are kept whose smallest s-mer, by hash, is the first or the last one in
them. Whether a k-mer is kept depends on its own characters only, so an edit elsewhere neither adds
nor removes anchors, and anchors keep their distances within a stretch that two texts share. A
fingerprint holds the anchors with the smallest hashes, each with its place. Two fingerprints are
alike as far as anchors match in the same order: of the smallest hashes of both, the share in the longest
chain of those that both have and that follow each other in both. So what is put in or left out between
costs its own anchors only.

A text without a syncmer, as a short one, is an anchor as a whole; an empty or null text has an empty fingerprint.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.llm.arrow import mix, prepare

S = 8  # characters of an inner substring
WINDOW = 16  # inner substrings of a k-mer
K = S + WINDOW - 1
ANCHORS = 48  # anchors of a fingerprint

# Multipliers for substrings of 1, 2, 4 ... characters.
_POWERS = [np.uint64(pow(0x100000001B3, 1 << i, 1 << 64)) for i in range(S.bit_length() - 1)]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text given as code points."""
    n = len(text)
    if n < K:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    roll = text.astype(np.uint64) + np.uint64(1)
    for i, power in enumerate(_POWERS):
        roll = roll[:-(1 << i)] * power + roll[1 << i:]
    small = mix(roll)
    least, width = small, 1
    while width < WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = np.flatnonzero((small[:n - K + 1] == least) | (small[WINDOW - 1:] == least))
    # Three s-mers cover the whole k-mer.
    own = roll[at] * np.uint64(0x9E3779B97F4A7C15) + roll[at + S]
    return at, mix(own * np.uint64(0xC2B2AE3D27D4EB4F) + roll[at + K - S])


def smallest(text: np.ndarray, at: np.ndarray, value: np.ndarray, most: int = ANCHORS) -> list[tuple[int, int]]:
    """The smallest different hashes (32 bits are kept) with their first places, by hash."""
    if not len(at) and len(text):
        return [(int.from_bytes(hashlib.blake2b(text.tobytes(), digest_size=4).digest(), "little"), 0)]
    value = value >> np.uint64(32)
    if len(value) > 4 * most:
        limit = np.partition(value, 2 * most)[2 * most]
        near = value <= limit
        if len(np.unique(value[near])) >= most:
            at, value = at[near], value[near]
    kept, first = np.unique(value, return_index=True)
    return [*zip(kept[:most].tolist(), at[first[:most]].tolist(), strict=True)]


def fingerprint(sketch: list[tuple[int, int]]) -> str:
    return " ".join([f"{h:08x}:{at:x}" for h, at in sketch])


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]], most: int = ANCHORS) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones among them."""
    if not a or not b:
        return float(a == b)
    left, right = dict(a), dict(b)
    union = sorted(left.keys() | right.keys())[:most]
    ends: list[int] = []  # the least place in b at which a chain of each length ends
    for _, place in sorted((left[h], right[h]) for h in union if h in left and h in right):
        at = bisect_left(ends, place)
        ends[at:at + 1] = [place]
    return len(ends) / len(union)


def sketch(text: str) -> list[tuple[int, int]]:
    code = points(text)
    return smallest(code, *anchors(code))


def edited_sketch(text: np.ndarray, own: tuple[np.ndarray, np.ndarray], edited: np.ndarray, same: int) -> list[tuple[int, int]]:
    """The sketch of a text of which the first ``same`` characters are those of another one.

    Anchors within them are the other text's; only what reaches beyond is looked at anew.
    """
    if len(text) < K or len(edited) < K or same < K:
        return smallest(edited, *anchors(edited))
    kept = own[0] + K <= same
    start = same - K + 1
    at, value = anchors(edited[start:]) if len(edited) - start >= K else (own[0][:0], own[1][:0])
    return smallest(edited, np.concatenate((own[0][kept], at + start)), np.concatenate((own[1][kept], value)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Every row once as itself, and the first row of every range of ids also in the range before.

    Ranges of doc_id (descending, null last) are numbered in ``_range``; in ``_order`` a range's rows
    stand in order, its borrowed row last. So the next row of any row is in its own range. Ranges are
    cut at quantiles of the ids; ``parts`` - 1 numbers come to the driver.
    """
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    number = F.lit(0)
    if cuts:
        above = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        number = F.size(F.filter(above, lambda c: F.col("doc_id") <= c))
        number = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(number)
    ranged = docs.withColumn("_range", number.cast("int")).withColumn("_hash", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_hash")
    heads = [r.asDict(recursive=True) for r in
             ranged.groupBy("_range").agg(F.max(key).alias("head")).orderBy("_range").collect()]
    # At most parts + 1 rows: the first row of each range, and the range that borrows it.
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    lent = spark.createDataFrame(
        [(heads[(i + 1) % len(heads)]["head"]["doc_id"], heads[(i + 1) % len(heads)]["head"]["_hash"], h["_range"])
         for i, h in enumerate(heads)], f"_id {kind}, _own long, _to int")
    matched = ranged.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("_id")) &
                          F.col("_hash").eqNullSafe(F.col("_own")), "left")
    places = F.array(F.struct("_range", F.lit(0).alias("_borrowed")),
                     F.struct(F.col("_to").alias("_range"), F.lit(1).alias("_borrowed")))
    return matched.select("doc_id", "text", "_hash",
                          F.inline(F.filter(places, lambda p: p["_range"].isNotNull())))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is the one with the next smaller id (of equal ids by hash of the text, null last), after
    the last one the first; a single row is its own next. The edited text has its last third replaced
    by as much of the start of the next one. Null texts are empty. Repeated rows have a row each.
    Texts are shuffled once, into ranges of ids, and read in order there.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    ordered = (rows.repartition(parts, "_range")
               .sortWithinPartitions("_range", "_borrowed", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc()))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, id, text, code points, anchors, sketch of the row before
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            ranges = batch.column("_range").to_pylist()
            borrowed = batch.column("_borrowed").to_pylist()
            for i, string in enumerate(batch.column("text")):
                text = string.as_py()
                code = points(text)
                own = anchors(code)
                now = (ranges[i], ids[i], text, code, own, smallest(code, *own), borrowed[i])
                if before is not None and before[0] == now[0] and not before[6]:
                    out.append(row(before, now))
                before = now
            columns = [*zip(*out, strict=True)] if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t or batch.schema.field("doc_id").type) for c, t in zip(columns, types, strict=True)], names)

    def row(it: tuple, following: tuple) -> tuple:
        _, id_, text, code, own, mine, _ = it
        n = len(code)
        third = n // 3
        edited = np.concatenate((code[:n - third], following[3][:third]))
        theirs = edited_sketch(code, own, edited, n - third)
        changed = text[:n - third] + following[2][:third]
        return (id_, n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mine),
                fingerprint(theirs), likeness(mine, theirs), likeness(mine, following[5]))

    return ordered.select("doc_id", "text", "_range", "_borrowed").mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")

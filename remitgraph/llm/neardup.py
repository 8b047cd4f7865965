"""Near duplicates by min-max hashing.

The set of a text holds its distinct shingles. Under each permutation both the smallest and the
largest value are kept, so a signature needs half as many hash evaluations, and the two agree with
the same chance as the sets are alike, with less variance than two independent ones. Bands of the
signature give candidates; every link is then confirmed on the full sets.

Equal sets are one class from the start. In a group of classes that share a band not all pairs are
looked at: two members, those that share most bands with others, are compared with all. Members that
are in one component by then need no more comparing. What is not in the group's largest component is
then compared with the members of the group that are near it in size (sets that are alike cannot differ
more), in blocks of bounded size, each in a task that passes over what it has found connected and emits
links only. So no link between components is lost, and no list of pairs grows with the square of a group
of copies. Links and components stay distributed throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.llm.arrow import mix, pieces, prepare, split
from remitgraph.plans.staging import stage

WORDS = 4  # words of a shingle
ALIKE = 80  # percent: sets are linked if 100 * intersection >= ALIKE * union
PERMUTATIONS = 48
ROWS = 4  # signature values of a band: at 80 percent a pair shares no band with a chance of 3e-6
SMALL_GROUP = 8  # in groups up to this size all pairs are compared at once
HUBS = 2  # in larger groups so many members are compared with all others first
BLOCK = 512  # members of a group that meet others at a time in one task, about

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(b"factor %d" % i, digest_size=8).digest(), "little") | 1
                     for i in range(PERMUTATIONS)], dtype=np.uint64)
_SHIFTS = np.array([int.from_bytes(hashlib.blake2b(b"shift %d" % i, digest_size=8).digest(), "little")
                    for i in range(PERMUTATIONS)], dtype=np.uint64)
_BANDS = 2 * PERMUTATIONS // ROWS
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(64)]


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes and their places."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    begin = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    place = (np.arange(len(raw)) - np.repeat(begin, size)).astype(np.uint64)
    value = mix(raw.astype(np.uint64) + place * np.uint64(256) + np.uint64(1))
    value2 = mix(value ^ np.uint64(0xA0761D6478BD642F))
    return mix(np.add.reduceat(value, begin) ^ mix(np.add.reduceat(value2, begin) + size.astype(np.uint64)))


def shingle_sets(strings: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of every text as sorted distinct 64-bit hashes."""
    bounds, parts = split(strings, r"[ \t-\r]+")
    coded = parts.dictionary_encode()
    hashes = _word_hashes(coded.dictionary)
    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(parts) else hashes
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        k = min(words, n)
        if n == 0:
            out.append(flat[:0])
            continue
        rolled = flat[a:b - k + 1] * _MULTIPLIERS[0]
        for i in range(1, k):
            rolled = mix(rolled) + flat[a + i:b - k + 1 + i] * _MULTIPLIERS[i]
        out.append(np.unique(mix(rolled + np.uint64(k))))
    return out


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _bands(values: np.ndarray) -> np.ndarray:
    """One number for each band of the signature, different bands never the same one by design."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    most = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        permuted = values[at:at + 1024, None] * _FACTORS + _SHIFTS
        permuted ^= permuted >> np.uint64(29)
        least = np.minimum(least, permuted.min(axis=0))
        most = np.maximum(most, permuted.max(axis=0))
    # Minima and maxima of one permutation stand in different bands.
    signature = np.concatenate((least, most)).reshape(_BANDS, ROWS)
    band = np.arange(_BANDS, dtype=np.uint64)
    for i in range(ROWS):
        band = mix(band ^ mix(signature[:, i] + np.uint64(i)))
    return band.view(np.int64)


def sets_of(docs: DataFrame, words: int = WORDS, full: bool = False) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), bands; with ``full`` the set itself instead of bands."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "values" if full else "bands"
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=8 << 20):
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([(s.view(np.int64) if full else _bands(s)) if len(s) else None for s in sets],
                          pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", last])

    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, key binary, {last} array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    left = sets.select(F.col("key").alias("a"), F.col("values").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("values").alias("right"))
    # Sizes alone rule out many pairs before their sets are brought together.
    size_a = sets.select(F.col("key").alias("a"), F.col("n_shingles").alias("na"))
    size_b = sets.select(F.col("key").alias("b"), F.col("n_shingles").alias("nb"))
    possible = (pairs.join(size_a, "a").join(size_b, "b")
                .filter(100 * F.least("na", "nb") >= alike * F.greatest("na", "nb")))
    both = possible.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_alike(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), alike)
                      for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with (root), for every node of the links (a, b).

    Every node takes the smallest neighbour as its parent, then neighbours of a node are linked to its
    smallest one instead, larger and smaller ones in turn, until nothing changes; the number of rounds
    grows with the logarithm of the number of nodes.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours are linked to the smallest.
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stage(large, "links")
        # Smaller neighbours, and the node itself, are linked to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = stage(small, "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))


def _alike(u: np.ndarray, v: np.ndarray, alike: int) -> bool:
    """Whether two sets, sorted, are alike enough."""
    if 100 * min(len(u), len(v)) < alike * max(len(u), len(v)):
        return False
    at = np.searchsorted(u, v)
    same = int((u[np.minimum(at, len(u) - 1)] == v).sum())
    return 100 * same >= alike * (len(u) + len(v) - same)


def _compare(band: int, left: pa.Table, right: pa.Table, alike: int) -> list[tuple[bytes, bytes]]:
    """Links that join the components of two blocks of a group; pairs that share an earlier band are left to it."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def columns(t: pa.Table) -> tuple[list, list, np.ndarray, list]:
        t = t.combine_chunks()
        values = t["values"].combine_chunks()
        ends = np.asarray(values.offsets)
        flat = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
        return (t["key"].to_pylist(), t["root"].to_pylist(),
                t["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, _BANDS),
                [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])

    keys, roots, bands, sets = columns(left)
    others, other_roots, other_bands, other_sets = columns(right)
    found = []
    for i, key in enumerate(keys):
        shared = other_bands == bands[i]
        first = np.flatnonzero(shared.any(axis=1) & (bands[i][shared.argmax(axis=1)] == band))
        # What shares most bands comes first: a link makes all others of its component needless.
        for j in first[np.argsort(-shared[first].sum(axis=1), kind="stable")].tolist():
            x, y = root(roots[i]), root(other_roots[j])
            if x != y and _alike(sets[i], other_sets[j], alike):
                parent[max(x, y)] = min(x, y)
                found.append((key, others[j]))
    return found


def _step(n: str, alike: int) -> F.Column:
    """The step of a set's size on a ladder on which sets that are alike are at most one step apart."""
    # Steps are a little wider than what alike sets may differ by, so rounding decides nothing.
    return F.floor(F.log(F.col(n)) / F.lit(math.log(100 / alike) * 1.001 + 1e-9)).cast("long")


def _blocks(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members to be compared, left with right, where band, step, l and r agree; of groups of several components.

    ``active`` has band, key, root and step. The left are those outside the group's largest component, the
    right all members at most one step away from them. A block has about ``BLOCK`` of either.
    """
    size = active.groupBy("band", "root", "step").agg(F.count(F.lit(1)).alias("n"))
    whole = size.groupBy("band", "root").agg(F.sum("n").alias("n"))
    major = whole.groupBy("band").agg(F.max(F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots"))
    major = major.filter("roots > 1").select("band", F.col("major.root").alias("major"))
    around = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")
    minor = (size.join(major, "band").filter("root <> major").groupBy("band", "step", "major")
             .agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("lefts")))
    near = (size.select("band", "n", around).groupBy("band", "step")
            .agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("rights")))
    split = stage(minor.join(near, ["band", "step"]), "blocks")

    def block(n: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(3), "key"), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = ["band", "key", "root"]
    left = (active.join(split, ["band", "step"]).filter("root <> major")
            .select(*own, "step", block("lefts").alias("l"), every("rights").alias("r")))
    right = (active.select(*own, around).join(split, ["band", "step"])
             .select(*own, "step", block("rights").alias("r"), every("lefts").alias("l")))
    return left, right


def _rest(active: DataFrame, sets: DataFrame, classes: DataFrame, alike: int) -> DataFrame:
    """Links within groups (band, key, root, step) of several components; only links leave a task."""
    whole = sets.join(classes.select("key", "bands"), "key").select("key", "values", "bands")
    left, right = (side.join(whole, "key") for side in _blocks(active))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, apart from the left's

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = _compare(key[0].as_py(), a, b, alike) if a.num_rows and b.num_rows else []
        return pa.table({"a": pa.array([max(f) for f in found], pa.binary()), "b": pa.array([min(f) for f in found], pa.binary())})

    group = ["band", "step", "l", "r"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, "a binary, b binary").distinct()


def links(docs: DataFrame, classes: DataFrame, words: int = WORDS, alike: int = ALIKE) -> DataFrame:
    """Confirmed links (a, b) between classes (key, doc_id, bands), enough to connect all that are connected."""
    band = classes.select("key", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(band.join(shared, "band"), "bands")
    # How many others a class meets, over its bands: the middle of a group of copies meets most.
    central = stage(members.groupBy("key").agg(F.sum("size").alias("met")), "bands")
    ids = central.select("key").join(classes.select("key", F.col("doc_id").alias("_doc")), "key").select("_doc").distinct()
    chosen = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    sets = (sets_of(chosen, words, full=True).join(central.select("key"), "key", "left_semi")
            .groupBy("key").agg(F.first("values").alias("values"), F.first("n_shingles").alias("n_shingles")))
    sets = stage(sets, "sets")
    order = Window.partitionBy("band").orderBy(F.desc("met"), "key")
    # A literal bound lets every task pass on so many rows of a group.
    top = (members.join(central, "key").withColumn("place", F.row_number().over(order))
           .filter(F.col("place") <= SMALL_GROUP).filter((F.col("size") <= SMALL_GROUP) | (F.col("place") <= HUBS))
           .select("band", F.col("key").alias("hub")))
    pairs = (members.join(top, "band").filter("key <> hub")
             .select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct())
    found = stage(_confirmed(pairs, sets, alike), "confirmed")
    left = members.filter(F.col("size") > SMALL_GROUP)
    active = (left.join(components(found).withColumnRenamed("node", "key"), "key", "left")
              .join(sets.select("key", _step("n_shingles", alike).alias("step")), "key")
              .select("band", "key", F.coalesce("root", "key").alias("root"), "step"))
    return found.union(stage(_rest(stage(active, "active"), sets, classes, alike), "confirmed"))


def near_duplicates(docs: DataFrame, words: int = WORDS, alike: int = ALIKE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Words are what lies between white space, A-Z in lower case; a text with fewer words than a shingle
    is one shingle as a whole, a null, empty or blank text has none and is linked with nothing, so it is a
    component of its own. ``component_id`` is the smallest id of the component; rows without an id
    belong to a component but never name it (null if there is no id in it). ``kept`` is true where the id
    names the component, in repeated rows for each.
    """
    sized = stage(sets_of(docs, words), "signatures")
    classes = stage(sized.filter("key is not null").groupBy("key")
                    .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    found = links(docs.select("doc_id", "text"), classes, words, alike)
    roots = components(found)
    ids = classes.select("key", "doc_id")
    # The name of each component that has links: the smallest id of its classes.
    rooted = ids.join(roots, ids["key"] == roots["node"]).select("key", "root", "doc_id")
    rooted = stage(rooted.unionByName(ids.join(roots.select(F.col("root").alias("_r")).distinct(), F.col("key") == F.col("_r"))
                                      .select("key", F.col("key").alias("root"), "doc_id")), "rooted")
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = rooted.join(names, "root").select("key", "component")
    by_class = ids.join(named, "key", "left").select("key", F.coalesce("component", "doc_id").alias("component"))
    whole = sized.select("doc_id", "n_shingles", "key").join(by_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, words: int = WORDS, alike: int = ALIKE) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest id, null last.

    Rows are told apart by a number of their own, so unlike texts that share an id, or have none, all stay;
    of rows that agree in id and text one does. Texts without words are linked with nothing and stay.
    """
    numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"), words, alike)
    ids = numbered.select("_row", F.col("doc_id").alias("_id"))
    named = found.join(ids, F.col("doc_id") == F.col("_row"))
    kept = named.groupBy("component_id").agg(F.coalesce(F.min_by("_row", "_id"), F.min("_row")).alias("_row"))
    return numbered.join(kept.select("_row"), "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

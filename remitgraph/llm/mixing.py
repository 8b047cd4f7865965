"""Mixing sources to target weights.

A document may belong to several sources. Documents are first added up by membership pattern, so what
is planned does not grow with them: a few patterns on one side, the sources' quotas on the other. A
min-cost flow routes words from patterns to quotas. Each pass over a pattern's words offers their
number once more and costs more than the one before (0, 1, 2 ...), so words are repeated only where a
quota cannot be met without. The amounts found are then turned into documents: every document of a
pattern as often as whole passes were used, and of the rest those that come first by a seeded hash, up
to the amount. Hashes are summed in ranges first, so only one range of a pattern is ever put in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.plans.staging import stage

PASSES = 3  # a document is taken so many times at most
RANGES = 1 << 12  # of the hash, for each pattern
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycling_weights(sources: Sequence[str | None]) -> dict[str | None, float]:
    """1, 2, 3 and again for sources by code point, null last."""
    ordered = sorted([s for s in sources if s is not None]) + [None] * (None in sources)
    return {s: float(i % 3 + 1) for i, s in enumerate(ordered)}


def share_out(sizes: dict, weights: dict, passes: int = PASSES) -> dict:
    """Targets: all words by weight, but no source more than ``passes`` times its own.

    What a source cannot take is shared again by weight among the others, until none is above.
    """
    targets: dict = {}
    left = float(sum(sizes.values()))
    free = {s for s in sizes if weights.get(s, 0.0) > 0}
    targets.update({s: 0.0 for s in sizes if s not in free})
    while free:
        total = sum(weights[s] for s in sorted(free, key=str))
        full = {s for s in free if left * weights[s] / total > passes * sizes[s]}
        if not full:
            targets.update({s: left * weights[s] / total for s in free})
            break
        for s in full:
            targets[s] = float(passes * sizes[s])
            left -= targets[s]
        free -= full
    return targets


def route(patterns: dict[tuple, int], quotas: dict, passes: int = PASSES) -> dict[tuple, int]:
    """Words to take of each pattern so that the sources' quotas are met as far as can be, at least cost.

    Successive shortest paths from the patterns' passes to the quotas. Words of a pattern may serve
    any of its sources.
    """
    names = sorted(patterns, key=str)
    sources = sorted(quotas, key=lambda s: (s is None, str(s)))
    begin, end = 0, 1 + len(names) + len(sources)
    arcs: list[list[int]] = []  # to, room, cost; the reverse arc is the next or the one before
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    place = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    first: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        first[name] = [arc(begin, 1 + i, patterns[name], cost) for cost in range(passes)]
        for s in name:
            if s in place:
                arc(1 + i, place[s], passes * patterns[name], 0)
    for s in sources:
        arc(place[s], end, round(quotas[s]), 0)
    while True:
        cost = [float("inf")] * (end + 1)
        came = [-1] * (end + 1)
        cost[begin] = 0
        waiting, inside = deque([begin]), {begin}
        while waiting:
            a = waiting.popleft()
            inside.discard(a)
            for k in out[a]:
                b, room, price = arcs[k]
                if room > 0 and cost[a] + price < cost[b]:
                    cost[b], came[b] = cost[a] + price, k
                    if b not in inside:
                        waiting.append(b)
                        inside.add(b)
        if came[end] < 0:
            break
        path, at = [], end
        while at != begin:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room
    return {name: sum(arcs[k ^ 1][1] for k in first[name]) for name in names}


def _sized(docs: DataFrame, members: Column, seed: int, *more: Column) -> DataFrame:
    """id, size, seeded hash, its range and the membership pattern of every row."""
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    pattern = F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))
    return docs.select("doc_id", *more, size_of(F.col("text")).alias("size"), hashed.alias("hash"),
                       F.shiftrightunsigned(hashed, 64 - RANGES.bit_length() + 1).alias("range"), pattern.alias("pattern"))


def _plan(sized: DataFrame, weights: Callable, passes: int) -> DataFrame:
    """A row for each pattern: whole passes, words beyond them, the range of the hash in which those are
    reached and how many lie before it, and size and target of the pattern's first source."""
    patterns = {tuple(r["pattern"]): r["size"] or 0 for r in sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    sizes: dict = {}
    for name, size in patterns.items():
        for s in name:
            sizes[s] = sizes.get(s, 0) + size
    # Overlapping words are there once, however many sources they belong to.
    targets = share_out(sizes, weights(list(sizes)), passes)
    all_words = sum(size for name, size in patterns.items() if name)
    scale = min(all_words / sum(targets.values()), 1.0) if sum(targets.values()) > 0 else 0.0
    targets = {s: t * scale for s, t in targets.items()}
    amounts = route({n: s for n, s in patterns.items() if n and s}, targets, passes)
    spark = sized.sparkSession
    kind = "pattern array<string>, whole long, rest long, source_size long, target double"
    plan = spark.createDataFrame(
        [(list(n), *(divmod(amounts.get(n, 0), s) if s else (0, 0)), sizes.get(n[0]) if n else None,
          targets.get(n[0]) if n else None) for n, s in patterns.items()], kind)
    before = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (sized.groupBy("pattern", "range").agg(F.sum("size").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(plan), "pattern")
            .filter("rest > 0 and before <= rest and before + n > rest")
            .select("pattern", F.col("range").alias("cut"), "before").collect())
    cut = spark.createDataFrame([tuple(r) for r in cuts], "pattern array<string>, cut long, before long")
    return stage(plan.join(F.broadcast(cut), "pattern", "left"), "mixing-plan")


def _split(known: DataFrame) -> DataFrame:
    """Rows in the range where the rest is reached, with ``more`` = 1 for those still taken, by hash."""
    order = Window.partitionBy("pattern").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    # A document counts if the amount lies beyond its middle.
    return known.filter("range = cut").withColumn("more", F.when(at + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))


def mix(docs: DataFrame, members: Column,
        weights: Callable[[Sequence[str | None]], dict] = cycling_weights,
        passes: int = PASSES, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    ``members`` is the array of sources of a row; of a row's first source ``source_size`` and ``target``
    are given (a row without sources takes nothing, and both are null). ``taken`` is a multiple of
    ``size``, up to ``passes`` times; the words taken of a pattern differ from its amount by half a
    document about. Equal rows are interchangeable but each counts. Texts are read once; sizes are
    staged. The driver gets a few rows per pattern and plans with those alone: there should be few
    sources.
    """
    sized = stage(_sized(docs, members, seed), "mixing")
    known = sized.join(F.broadcast(_plan(sized, weights, passes)), "pattern")
    simple = known.filter("cut is null or range <> cut").withColumn("more", _more())
    columns = ["doc_id", "size", "source_size", "target",
               (F.least(F.col("whole") + F.col("more"), F.lit(passes)) * F.col("size")).alias("taken")]
    return simple.select(*columns).unionByName(_split(known).select(*columns))


def _more() -> Column:
    return F.when(F.col("range") < F.col("cut"), 1).otherwise(0)


def apply_mix(docs: DataFrame, members: Column, weights: Callable[[Sequence[str | None]], dict] = cycling_weights,
              passes: int = PASSES, seed: int = 42) -> DataFrame:
    """The rows taken, with all their columns, each as often as it is taken.

    Rows without words are taken as often as the whole passes say. Of the rows only those in the range
    of the hash where a pattern's rest is reached are matched by a join; of equal rows there all are
    taken or none. Texts are not shuffled otherwise.
    """
    sized = stage(_sized(docs, members, seed), "mixing")
    plan = _plan(sized, weights, passes)
    chosen = _split(sized.join(F.broadcast(plan), "pattern")).filter("more = 1").select(
        F.col("hash").alias("_chosen"), F.col("pattern").alias("_of")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    known = _sized(docs, members, seed, whole).join(F.broadcast(plan), "pattern")
    simple = known.filter("cut is null or range <> cut").withColumn("more", _more())
    edge = known.filter("range = cut").join(
        chosen, (F.col("hash") == F.col("_chosen")) & (F.col("pattern") == F.col("_of")), "left")
    edge = edge.withColumn("more", F.when(F.col("_chosen").isNotNull(), 1).otherwise(0))
    times = F.least(F.col("whole") + F.col("more"), F.lit(passes)).cast("int")
    taken = simple.select("_row", times.alias("n")).unionByName(edge.select("_row", times.alias("n"))).filter("n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "n"))).select("_row.*")

"""A graph stored for loading in batches: what a batch does not touch is neither shuffled nor rewritten.

Each node and edge table is divided twice by hashes of its key: into ``parts``, which are folders, and
within these into buckets. A batch of nodes is reduced to its last row per key; only the parts those
keys fall into are read, merged and written again, by dynamic partition overwrite. Buckets spare the
stored side of every join its exchange. Edges are only ever added: the new ones are appended. So a load
costs what the batch costs, and the parts it falls into; choose ``parts`` so that a batch of usual size
falls into few, or that a part is small.

A batch with more rows than ``ROWS_PER_TASK`` for each bucket would keep as many tasks busy as there are
buckets, for long. It is joined over all tasks instead, both sides shuffled once, with packed ids; nothing is
joined with a table that is still empty.

Tables are external: the folder is the store, and ``open_store`` makes it known to any session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitgraph.operators import load
from remitgraph.plans.staging import COMPRESSION, packed, stage, staged, unpacked
from remitgraph.plans.tables import EDGE_ENDS, NODE_KEYS, SCHEMAS

PARTS, BUCKETS = 64, 16

# Beyond so many rows of a batch for each bucket, buckets are too few tasks.
ROWS_PER_TASK = 500_000


def _columns(table: str) -> list[str]:
    """The stored properties of a node, the two ends of an edge."""
    return list(load.NODE_TYPES[table]) if table in NODE_KEYS else [end for end, _ in EDGE_ENDS[table][1]]


def _key(table: str) -> list[str]:
    return [NODE_KEYS[table][1]] if table in NODE_KEYS else _columns(table)


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    path: str
    parts: int
    buckets: int

    def name(self, table: str) -> str:
        return f"keyed_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{table}"

    def stored(self, table: str) -> DataFrame:
        """A table with its partition column ``part``."""
        return self.spark.table(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self.stored(table).drop("part")

    def tables(self) -> dict[str, DataFrame]:
        """All eight, as ``load.as_graph`` takes them."""
        return {table: self.read(table) for table in [*NODE_KEYS, *EDGE_ENDS]}

    def is_empty(self, table: str) -> bool:
        """Whether nothing was ever put into a table: it has no parts, of which there are few."""
        return self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").isEmpty()

    def is_large(self, batch: DataFrame) -> bool:
        """Whether a staged batch is too much work for one task of each bucket."""
        return batch.count() > self.buckets * ROWS_PER_TASK

    def bucket(self, *key: str) -> Column:
        return F.pmod(F.hash(*key), F.lit(self.buckets))

    def part(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.parts)).cast("int")

    def within(self, table: str, keys: DataFrame) -> DataFrame:
        """The stored rows of the parts that ``keys``, named like the table's, fall into.

        There are never more parts than the store has, so their numbers can be listed in the filter.
        """
        found = keys.select(self.part(*_key(table)).alias("part")).distinct().collect()
        return self.stored(table).filter(F.col("part").isin([r.part for r in found]))


def open_store(spark: SparkSession, path: str, parts: int = PARTS, buckets: int = BUCKETS) -> KeyedStore:
    """A store in a folder; of a new one ``parts`` and ``buckets`` are set for good."""
    try:
        layout = spark.read.parquet(f"{path}/layout").first()
    except AnalysisException:
        spark.range(1).select(F.lit(parts).alias("parts"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
        layout = None
    store = KeyedStore(spark, path, layout.parts if layout else parts, layout.buckets if layout else buckets)
    for table in [*NODE_KEYS, *EDGE_ENDS]:
        known = spark.createDataFrame([], SCHEMAS[table]).schema
        columns = ", ".join(f"`{c}` {known[c].dataType.simpleString()}" for c in _columns(table))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {store.name(table)} ({columns}, part int) USING parquet PARTITIONED BY (part) "
                  f"OPTIONS ('compression' '{COMPRESSION}') "
                  f"CLUSTERED BY ({', '.join(_key(table))}) INTO {store.buckets} BUCKETS LOCATION '{path}/{table}'")
        if layout:
            spark.catalog.recoverPartitions(store.name(table))
    return store


@contextmanager
def _by_part(spark: SparkSession) -> Iterator[None]:
    """Overwriting replaces the parts that rows are written to, and no others."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def latest(incoming: DataFrame, key: str) -> DataFrame:
    """The last incoming row of each key, all that is shuffled of a batch."""
    values = F.struct(*[n for n in incoming.columns if n != load.SEQ])
    return incoming.groupBy(key).agg(F.max_by(values, load.SEQ).alias("row")).select("row.*")


def _long_text(*columns: str) -> list[str]:
    """Those of the columns that are packed for a shuffle."""
    return [n for n in columns if n == NODE_KEYS["transactions"][1]]


def merged_nodes(store: KeyedStore, table: str, batch: DataFrame) -> DataFrame:
    """The parts that a staged batch (one row per key) falls into, as they are after it."""
    key = NODE_KEYS[table][1]
    # Spread as the stored rows are, these need no exchange.
    spread = batch.select(key) if store.is_large(batch) else batch.repartition(store.buckets, key)
    kept = store.within(table, batch).join(spread, key, "left_anti")
    return kept.unionByName(batch.withColumn("part", store.part(key)))


def by_file(store: KeyedStore, table: str, rows: DataFrame) -> DataFrame:
    """Rows with their ``part``, brought together as they are stored, so that few tasks write into one bucket."""
    ids = _long_text(*_columns(table))
    placed = packed(rows.withColumn("_bucket", store.bucket(*_key(table))), *ids)
    return unpacked(placed.hint("rebalance", F.col("part"), F.col("_bucket")), *ids).select(*_columns(table), "part")


def upsert(store: KeyedStore, table: str, rows: DataFrame) -> None:
    """Put typed rows with ``load_seq`` into a node table; of a key the last one holds, with all its nulls."""
    key = NODE_KEYS[table][1]
    batch = unpacked(latest(packed(rows, *_long_text(key)), key), *_long_text(key))

    def put(merged: DataFrame) -> None:
        with _by_part(store.spark):
            by_file(store, table, merged).write.insertInto(store.name(table), overwrite=True)

    if store.is_empty(table):
        put(batch.withColumn("part", store.part(key)))
        return
    with staged(batch, "batch") as batch:
        put(merged_nodes(store, table, batch))


def known_edges(store: KeyedStore, table: str, batch: DataFrame) -> DataFrame:
    """The edges of a staged batch whose two nodes are stored.

    The different ends of a batch are looked up, not its edges, so a node that most edges share is looked
    up once. The edges then meet the ends that were not found: as a rule few, and then no edge is shuffled; if
    they are many, a join that is split where one end is hot.
    """
    large = store.is_large(batch)
    known = batch
    for end, nodes in EDGE_ENDS[table][1]:
        key = NODE_KEYS[nodes][1]
        ends = batch.select(F.col(end).alias(key))
        there = store.within(nodes, ends).select(key)
        if large:
            ids = _long_text(key)
            lost = unpacked(packed(ends, *ids).distinct().join(packed(there, *ids), key, "left_anti"), *ids)
        else:
            lost = ends.distinct().repartition(store.buckets, key).join(there, key, "left_anti")
        known = known.join(stage(lost, "lost-ends").withColumnRenamed(key, end), end, "left_anti")
    return known.select(*_columns(table))


def new_edges(store: KeyedStore, table: str, batch: DataFrame) -> DataFrame:
    """The edges of a batch (different ones) that are not stored."""
    ends = _columns(table)
    return batch.repartition(store.buckets, *ends).join(store.within(table, batch), ends, "left_anti")


def added_edges(store: KeyedStore, table: str, batch: DataFrame, rows: int) -> DataFrame:
    """As ``new_edges`` for a batch of many rows, with their ``part``; the batch may repeat an edge.

    Batch and stored edges are shuffled once, to where the new ones are written, and each is seen there with all
    its copies. Slices of a bucket keep tasks at about ``ROWS_PER_TASK`` rows of the batch.
    """
    ends, here = _columns(table), F.lit(False).alias("stored")
    seen = batch.select(*ends, here)
    if not store.is_empty(table):
        seen = seen.unionByName(store.within(table, batch).select(*ends, F.lit(True).alias("stored")))
    files = store.parts * store.buckets
    slices = 1 + rows // (files * ROWS_PER_TASK)
    place = ["part", "_bucket", "_slice"]
    placed = seen.withColumns({"part": store.part(*ends), "_bucket": store.bucket(*ends),
                               "_slice": F.pmod(F.xxhash64(F.lit("slice"), *ends), F.lit(slices))})
    met = packed(placed, *_long_text(*ends)).repartition(files * slices, *place).groupBy(*place, *ends).agg(F.max("stored").alias("stored"))
    return unpacked(met.filter(~F.col("stored")), *_long_text(*ends)).select(*ends, "part")


def add_edges(store: KeyedStore, table: str, rows: DataFrame) -> None:
    """Append typed edges whose nodes are stored and that are not stored themselves."""
    ends = _columns(table)

    def put(added: DataFrame) -> None:
        added.select(*ends, "part").write.insertInto(store.name(table), overwrite=False)

    with staged(rows.dropna(), "batch") as batch:
        known = known_edges(store, table, batch)
        if store.is_large(batch):
            put(added_edges(store, table, known, batch.count()))
            return
        with staged(known.distinct(), "batch") as known:  # read by the parts it falls into and by the join
            put(new_edges(store, table, known).withColumn("part", store.part(*ends)))


def load_batch(store: KeyedStore, incoming: dict[str, DataFrame]) -> None:
    """Load exported tables, or some of them, on top of what is stored: nodes first, then edges.

    The same rules as ``load.load_graph``: node frames carry ``load_seq``, a repeated key overwrites, an
    edge is kept once and only if both its nodes are there. A batch that is loaded again changes nothing.
    """
    for table in NODE_KEYS:
        if table in incoming:
            upsert(store, table, load.typed_nodes(table, incoming[table]))
    for table in EDGE_ENDS:
        if table in incoming:
            add_edges(store, table, load.typed_edges(table, incoming[table]))

"""Shared building blocks for plans that must hold at any size.

``stage`` writes an intermediate result as Parquet into the folder the cluster shares for
checkpoints and reads it back; what an application staged is removed when it ends. This cuts the
lineage (a lost executor rereads files, nothing is recomputed) and gives the optimizer the real size
of the data, so that Spark's own limit (``spark.sql.autoBroadcastJoinThreshold``) decides between a
broadcast and a shuffle join. No broadcast hint is needed, and none is used on data whose size is not
known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
COMPRESSION = "zstd"  # ids are hashes in hex digits: this codec finds the four bits a digit holds, others store eight
_HEX, _TEXT = b"\x00", b"\x01"  # first byte of packed text


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse; both are shared by a cluster."""
    folder = spark.conf.get(_SETTING, None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


_MARKED: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the folder, removed when its driver ends."""
    own = f"{shared_folder(spark)}/remitgraph/{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(own)
    return own


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """As ``stage``, for as long as the block lasts: what is needed once does not stay on disk."""
    spark = df.sparkSession
    kept = stage(df, name)
    try:
        yield kept
    finally:
        for folder in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; what the named columns are made of is computed once for each.

    A filter on a column, also one that a join adds, is pushed below what computes it and so computes it again, for
    ids as often as there are filters. It is not pushed below a generator that the column comes out of.
    """
    if not names:
        return df
    others = [n for n in df.columns if n not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(*df.columns)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """Text columns as bytes for a shuffle: text of hex digits, as ids are, in half its length. Other columns stay.

    Equal text gives equal bytes and the reverse, so what is packed can be grouped and joined.
    """
    if not names:
        return df
    digits = {n: F.unhex(n) for n in names}
    bytes_of = computed_once(df, *names).withColumns({n: F.when(F.lower(F.hex(bytes_)) == F.col(n), F.concat(F.lit(_HEX), bytes_)).otherwise(
        F.concat(F.lit(_TEXT), F.col(n).cast("binary"))) for n, bytes_ in digits.items()})
    return computed_once(bytes_of, *names)


def unpacked(df: DataFrame, *names: str) -> DataFrame:
    body = {n: F.substring(n, 2, 2**31 - 1) for n in names}
    return df.withColumns({n: F.when(F.substring(n, 1, 1) == F.lit(_HEX), F.lower(F.hex(bytes_))).otherwise(
        bytes_.cast("string")) for n, bytes_ in body.items()})


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their position in ``row_number``.

    A literal bound on ``row_number`` lets Spark cut every group to ``k`` rows before the
    shuffle, so a group holding a third of all rows sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("row_number", F.row_number().over(window)).filter(F.col("row_number") <= k)


def within_reach(df: DataFrame, group: list[str], first: str, k: int) -> DataFrame:
    """Rows that may be among the first ``k`` of their group when ordered by ``first`` (nulls last), then by others.

    Rows of a group are dealt into ``2 * k`` slices, in any way. The smallest values of ``k`` slices belong to ``k``
    different rows, so the k-th smallest of them is a bound that no row of the first ``k`` exceeds; about 1.4 ``k``
    rows of a group are within it, and those equal to it. A group with fewer values is kept whole. Bounds
    come from sums as small as the groups, in one pass more over ``df``; only what is left is sorted.
    """
    dealt = df.select(*group, first, F.pmod(F.monotonically_increasing_id(), F.lit(2 * k)).alias("_slice"))
    least = dealt.groupBy(*group, "_slice").agg(F.min(first).alias("least"))
    bounds = stage(least.groupBy(*[F.col(n).alias(f"_{n}") for n in group]).agg(
        F.try_element_at(F.sort_array(F.collect_list("least")), F.lit(k)).alias("_bound")), "bounds")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in group]
    near = df.join(bounds, reduce(Column.__and__, same))
    return near.filter(F.col("_bound").isNull() | (F.col(first) <= F.col("_bound"))).select(*df.columns)


def both_ways(df: DataFrame, sides: list[Column]) -> DataFrame:
    """Give every row once per side (each side a struct) in a single scan of the input."""
    kept = [F.col(c) for c in df.columns]
    return df.select(*kept, F.inline(F.array(*sides)))

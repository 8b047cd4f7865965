"""Samples of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANK = "sample_rank"
_DIGITS = 12  # hex digits compared against the threshold


def random_sample(df: DataFrame, fraction: float, seed: int, limit: int | None = None) -> DataFrame:
    """Spark's Bernoulli sample; depends on how the input is partitioned."""
    picked = df.sample(fraction=fraction, seed=seed)
    return picked if limit is None else picked.limit(limit)


def sample_rank(keys: list[str], seed: int) -> Column:
    """Uniform hex text that depends only on the key values and the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _threshold(share: float) -> str:
    return format(min(int(share * 16**_DIGITS), 16**_DIGITS - 1), f"0{_DIGITS}x")


def repeatable_sample(
    df: DataFrame, keys: list[str], fraction: float, seed: int = 42, limit: int | None = None
) -> DataFrame:
    """Rows whose hashed key falls below ``fraction``; of those the ``limit`` lowest hashes.

    The same rows come back for any partitioning. With a limit, one pass over the key columns
    counts how many rows fall below each of a falling series of thresholds; only rows below the
    smallest sufficient one are then ordered, so the final top-k sees about twice the limit
    instead of the whole sample.
    """
    ranked = df.withColumn(_RANK, sample_rank(keys, seed))
    chosen = ranked.filter(F.col(_RANK) < _threshold(fraction))
    if limit is None:
        return chosen.drop(_RANK)
    shares = [fraction / 2**step for step in range(41)]
    counts = chosen.agg(*[
        F.count_if(F.col(_RANK) < _threshold(s)).alias(f"s{i}") for i, s in enumerate(shares)
    ]).first()
    enough = [s for s, n in zip(shares, counts) if n >= limit]
    narrowed = chosen.filter(F.col(_RANK) < _threshold(min(enough))) if enough else chosen
    return narrowed.orderBy(_RANK, *keys).limit(limit).drop(_RANK)

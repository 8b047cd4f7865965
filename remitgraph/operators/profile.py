"""Profiling: shapes, schemas, previews, numeric summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from remitgraph.plans.staging import stage

QUARTILES = (0.25, 0.5, 0.75)


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows ``(table_name, row_count, column_count)``, in one job."""
    frames = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def column_types(df: DataFrame) -> DataFrame:
    """Per column: position, name, type and the number of rows that have a value."""
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("filled_rows"),
        )
        for i, f in enumerate(df.schema)
    ]
    filled = df.agg(*[F.count(f"`{name}`").alias(f"c{i}") for i, name in enumerate(df.columns)])
    return filled.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, n: int = 5, order: list[Column | str] | None = None) -> DataFrame:
    """First n rows; pass an order for a repeatable choice."""
    return (df.orderBy(*order) if order else df).limit(n)


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, sample deviation, min, exact quartiles, max.

    Quartiles interpolate between the two neighbouring values. They are exact without holding a
    column in one place, see ``quantiles``.
    """
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    long_form = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(n).cast("double").alias("value")) for n in names
    ])))
    stats = long_form.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return stats.join(quantiles(long_form, QUARTILES), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min",
        *[F.col(f"q{i}").alias(f"p{int(q * 100)}") for i, q in enumerate(QUARTILES)], "max",
    )


def quantiles(long_form: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Exact interpolated quantiles ``q0, q1, ...`` per ``column_name`` of ``value``.

    The histogram is written in global order, so every file is a run of neighbouring values.
    Rows are counted per file, and only the files that hold a wanted rank are looked into.
    """
    histogram = stage(
        long_form.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count("*").alias("copies"))
        .orderBy("column_name", "value"),
        "histogram",
    )
    sliced = histogram.withColumn("slice", F.col("_metadata.file_path"))

    # One row per column and file: running totals over them are cheap.
    per_slice = sliced.groupBy("column_name", "slice").agg(
        F.sum("copies").alias("n"), F.min("value").alias("start"))
    by_slice = Window.partitionBy("column_name").orderBy("start")
    whole = Window.partitionBy("column_name")
    per_slice = per_slice.select(
        "column_name", "slice", (F.sum("n").over(by_slice) - F.col("n")).alias("before"), "n",
        F.sum("n").over(whole).alias("total"),
    )
    position = (F.col("total") - 1) * F.col("share")
    wanted = per_slice.select("*", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    wanted = wanted.select(
        "column_name", "slice", "before", "n", "share", (position - F.floor(position)).alias("part"),
        F.inline(F.array(
            F.struct(F.lit("low").alias("side"), F.floor(position).alias("rank")),
            F.struct(F.lit("high").alias("side"), F.ceil(position).alias("rank")),
        )),
    ).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))

    # At most two files per share and column are wanted, so these are small enough to broadcast.
    slices = wanted.select("column_name", "slice", "before").distinct()
    inside = Window.partitionBy("column_name", "slice").orderBy("value")
    located = sliced.join(F.broadcast(slices), ["column_name", "slice"]).select(
        "column_name", "slice", "value", "copies",
        (F.col("before") + F.sum("copies").over(inside)).alias("upto"),
    )
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("copies"))
    found = located.join(F.broadcast(wanted), ["column_name", "slice"]).filter(hit)

    def value(i: float, side: str) -> Column:
        return F.max(F.when((F.col("share") == i) & (F.col("side") == side), F.col("value")))

    def at(i: float) -> Column:
        part = F.max(F.when(F.col("share") == i, F.col("part")))
        return value(i, "low") + (value(i, "high") - value(i, "low")) * part

    return found.groupBy("column_name").agg(*[at(s).alias(f"q{i}") for i, s in enumerate(shares)])

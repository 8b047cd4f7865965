"""Reading and writing files: CSV scans, sinks, manifests."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitgraph.operators.build import name_account_sides

CSV_OPTIONS = {"header": True, "emptyValue": "", "nullValue": ""}


def read_text_table(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    """CSV with a header. Columns are text unless ``infer`` asks for the extra pass over the data."""
    return spark.read.option("header", True).option("inferSchema", infer).csv(path)


def read_raw_transactions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return name_account_sides(read_text_table(spark, path))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Manifest ``(file_path, file_name, file_size)`` below a folder; contents are not read.

    ``file_name`` is the path relative to the folder. The pattern is held against the last part of it,
    regardless of case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # Paths come encoded as in a URL, but with plus signs as they are.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = folder.rstrip("/").removeprefix("file:") + "/"
    listed = files.select(path.alias("file_path"), F.substring_index(path, root, -1).alias("file_name"),
                          F.col("_metadata.file_size").alias("file_size"))
    last = F.lower(F.substring_index("file_name", "/", -1))
    return listed.filter(last.rlike("^" + fnmatch.translate(pattern.lower())))


def read_matching(spark: SparkSession, folder: str, pattern: str) -> dict[str, DataFrame]:
    """One text table per file whose name matches, keyed by its path below the folder without ``.csv``.

    Files may have different columns, so each keeps its own header.
    """
    found = list_files(spark, folder, pattern).orderBy("file_name").toLocalIterator()
    return {r.file_name.removesuffix(".csv"): read_text_table(spark, r.file_path) for r in found}


def copy_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Name (relative to the folder) and size of every data file, for comparing two copies."""
    hidden = F.substring_index("file_name", "/", -1).rlike(r"^[._]")
    return list_files(spark, folder).filter(~hidden).select("file_name", "file_size")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """One directory, one file per task; null and empty text are both blank in CSV."""
    writer = df.write.mode("overwrite")
    if compression:
        writer.option("compression", compression)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a table; the schema is always stated."""
    return spark.createDataFrame(rows, schema)

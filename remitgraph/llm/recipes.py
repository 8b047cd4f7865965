"""Exact duplicates by recipes of content-defined chunks, with built-in functions only.

A text without white space is cut where its own bytes say so, so equal texts have equal chunks and a
passage that many texts share mostly gives equal chunks too. Each chunk is known by a 64-bit hash. The
different chunks move once, reduced by every task before the shuffle, and show which hashes stand for
more than one content; such a hash gets a number for each of its contents. Hash and number are a
verified identifier: equal if and only if the chunks are. A text is then its recipe, the ordered list
of its identifiers, and only recipes are grouped and joined, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitgraph.plans.staging import stage

SPACE = "[ \\t-\\r]+"
SHORTEST, LONGEST = 512, 16_384  # bytes of a chunk; a chunk without a cut ends at the second
BITS = 64  # of a chunk's hash

# A cut follows three bytes of these classes; in prose about one place in some hundreds.
_CLASSES = "".join("[" + "".join(f"\\x{b:02x}" for b in range(256) if (b * factor + 7) % 256 < 40) + "]"
                   for factor in (167, 101, 59))
_CHUNK = f"(?s).{{{SHORTEST - 3},{LONGEST - 3}}}?{_CLASSES}|.{{1,{LONGEST}}}"


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def chunks(text: Column) -> Column:
    """The chunks of a text, in order, as strings of one character per byte of its UTF-8 form."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(_CHUNK), F.lit(0))


def _hashes(pieces: Column, bits: int) -> Column:
    return F.transform(pieces, lambda piece: F.shiftright(F.xxhash64(piece), 64 - bits))


def _cut(docs: DataFrame, bits: int) -> DataFrame:
    """The chunk store: every row under a number of its own, with its chunks and their hashes."""
    plain = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                        without_space(F.col("text")).alias("plain"))
    cut = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars",
                       F.sha2("plain", 256).alias("text_sha256"), chunks(F.col("plain")).alias("chunks"))
    return stage(cut.withColumn("hashes", _hashes(F.col("chunks"), bits)), "chunks")


def _contents(store: DataFrame) -> DataFrame:
    """The contents of hashes that stand for several, numbered; as good as none with 64 bits."""
    pieces = store.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("p")).select(
        F.col("p.hashes").alias("hash"), F.col("p.chunks").alias("chunk"))
    contents = pieces.distinct()
    several = contents.groupBy("hash").count().filter("count > 1").select("hash")
    number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))
    # The hashes are few: staged, so that the contents are not sorted to find them.
    numbered = pieces.join(stage(several, "shared-hashes"), "hash", "left_semi").distinct()
    return stage(numbered.withColumn("number", number), "numbered")


def recipes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """row, doc_id, n_chars, text_sha256 and the recipe of every row.

    A recipe is the list of the chunks' hashes, and the numbers of those chunks whose hash stands for
    several contents. Equal recipes mean equal texts, whatever ``bits`` is.
    """
    store = _cut(docs, bits)
    numbered = _contents(store)
    touched = store.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("at", "p")).select(
        "row", "at", F.col("p.hashes").alias("hash"), F.col("p.chunks").alias("chunk"))
    of_rows = touched.join(numbered, ["hash", "chunk"]).groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "number"))), lambda x: x["number"]).alias("numbers"))
    return store.join(of_rows, "row", "left").select(
        "row", "doc_id", "n_chars", "text_sha256", "hashes",
        F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"))


def exact_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if they are identical without the characters space and U+0009 to U+000D; null is an
    empty text, and empty texts are equal to each other. Of equal texts the row with most code points
    stays, then the one with the smallest doc_id, a null id last. Of rows that agree in both, one stays
    (``kept``), whichever; keep_id is null only if all rows of largest text have no id. text_sha256 is
    of the text without white space, in UTF-8. Other columns are not looked at; no rows give no rows.
    """
    rows = stage(recipes(docs, bits), "recipes")
    key = ["hashes", "numbers"]
    # Three small steps instead of one order by several columns: numbers are aggregated without sorting.
    equal = rows.groupBy(*key, "n_chars", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    as_long = equal.groupBy(*key, "n_chars").agg(
        F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.sum("n").alias("n"))
    groups = as_long.groupBy(*key).agg(
        F.max_by("keep_id", "n_chars").alias("keep_id"), F.max_by("keep_row", "n_chars").alias("keep_row"),
        F.sum("n").alias("group_size"))
    # Staged, so that both sides of the join are plain exchanges, and a recipe that many rows share can be split.
    return rows.join(stage(groups, "groups"), key).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")

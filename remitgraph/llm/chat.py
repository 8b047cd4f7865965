"""Chat formatting from event logs.

A conversation is a log of events, each with a sequence number and the message it is about:

- ``delta`` adds its text to the message (so does an event of any other or no name),
- ``edit`` replaces the message's text so far by its own,
- ``regenerate`` drops the message's text so far and all later messages, and begins the message anew.

Folding needs no state: what counts of a message are its events from the last edit or regeneration
of it on, that come after the last regeneration of any earlier message. Logs are partitioned by
conversation once; messages, offsets and the rendered text all follow from that partitioning.

A conversation becomes one value, so it must fit in memory; conversations are independent.

The template puts every message between control strings. In roles and texts a backslash goes before
every backslash and into every ``<|``, and in roles before every line end, so no text can end its message
and everything can be read back. Everything is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"  # the role whose texts are under the loss mask
_MASK = "array<struct<start: bigint, end: bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log with one delta for each row.

    Rows of a conversation go by turn (null first), then role, then text, so equal turns are
    messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("delta").alias("event"),
        F.row_number().over(order).cast("long").alias("message"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the messages that remain of a log.

    Null texts add nothing, the role is the first one given (else empty), null numbers come before all
    others. Of events with the same number edits and regenerations come first.
    """
    least = F.lit(-(1 << 62))
    log = events.select("conv_id", F.coalesce(F.col("seq").cast("long"), least).alias("seq"),
                        F.coalesce("event", F.lit("delta")).alias("event"),
                        F.coalesce(F.col("message").cast("long"), least).alias("message"), "role", "text")
    cut = F.col("event").isin("edit", "regenerate")
    own = Window.partitionBy("conv_id", "message")
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    marked = log.select("*", F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(earlier).alias("gone"),
                        F.max(F.when(cut, F.col("seq"))).over(own).alias("anew"),
                        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own)["role"].alias("first"))
    kept = marked.filter((F.col("gone").isNull() | (F.col("seq") > F.col("gone"))) &
                         (F.col("anew").isNull() | (F.col("seq") >= F.col("anew"))))
    part = F.struct("seq", (~cut).alias("later"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]))
    return kept.groupBy("conv_id", "message").agg(F.coalesce(F.min("first"), F.lit("")).alias("role"), whole.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: the text of every conversation and where in it its loss applies.

    ``mask`` lists the code points (end exclusive) of the escaped texts of assistants. Messages go by
    number; of equal numbers by role and text.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = messages.select("conv_id", "message", "role", role.alias("_role"), text.alias("_text")).select(
        "*", F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(END)).alias("_all"),
        (F.char_length("_role") + len(START) + 1).alias("_head"))
    before = Window.partitionBy("conv_id").orderBy("message", "role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = head.select("*", F.coalesce(F.sum(F.char_length("_all")).over(before), F.lit(0)).alias("_at"))
    start = F.col("_at") + F.col("_head")
    masked = F.struct(start.alias("start"), (start + F.char_length("_text")).alias("end"))
    return placed.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_at", "_all"))), lambda m: m["_all"])).alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == LEARNED, masked))).cast(_MASK).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (the unescaped text under the mask), n_formatted, from the output alone."""
    whole = F.col("formatted")
    parts = F.filter(F.split(whole, r"<\|im_end\|>\n", -1), lambda p: p != "")
    header = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, header, 1)
        body = F.substring(part, F.char_length(role) + (len(START) + 2), F.char_length(part))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    learned = F.transform("mask", lambda m: unescape(
        F.substring(whole, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"),
                            F.concat_ws("", learned).alias("loss"), F.char_length(whole).cast("long").alias("n_formatted"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    line = F.lit("\n")
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)))
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("n_formatted").alias("formatted_chars"))

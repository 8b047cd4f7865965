"""Column helpers: every function takes columns and returns a column.

All of them are built-in expressions, so they stay inside code generation and can be pushed
towards the scan. Nothing here raises on dirty input: text that does not parse becomes null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide keys and ids, so they must not change.
KEY_SEPARATOR = "|"
ID_SEPARATOR = "||"
NULL_MARK = "<NULL>"
RAW_TIME_PATTERN = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$"

# Exact decimal used for money totals, so that a total does not depend on row order.
MONEY = "decimal(30,8)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.trim(col(c).cast("string"))


def long(c: Column | str) -> Column:
    return col(c).try_cast("bigint")


def double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def missing(c: Column | str, trim: bool = True) -> Column:
    """True for null and empty text; with ``trim`` also for text of blanks only."""
    body = text(c) if trim else col(c).cast("string")
    return F.coalesce(body == "", F.lit(True))


def present(c: Column | str) -> Column:
    return ~missing(c)


def account_key(bank_id: Column | str, account_number: Column | str) -> Column:
    """``bank|number``, or null when either part is absent (never a partial key)."""
    bank, number = col(bank_id), col(account_number)
    return F.when(
        bank.isNotNull() & present(number),
        F.concat(bank.cast("string"), F.lit(KEY_SEPARATOR), number),
    )


def raw_time(c: Column | str) -> Column:
    """``yyyy/MM/dd HH:mm`` text to a zone-free timestamp; anything else is null.

    The cast goes straight to TIMESTAMP_NTZ, so the session time zone (and its daylight-saving
    gaps) cannot move the value.
    """
    return F.when(
        col(c).rlike(RAW_TIME_PATTERN),
        F.translate(col(c), "/", "-").try_cast("timestamp_ntz"),
    )


def iso_time(c: Column | str) -> Column:
    """Zone-free timestamp to ``yyyy-MM-ddTHH:mm:ss`` text."""
    return F.translate(F.substring(col(c).cast("string"), 1, 19), " ", "T")


def local_time(c: Column | str) -> Column:
    """ISO text, with ``T`` or a space, to a zone-free timestamp; blank or bad text is null."""
    return F.when(present(c), F.translate(text(c), " ", "T").try_cast("timestamp_ntz"))


def code_flag(c: Column | str) -> Column:
    """1 is true, any other number false, null stays null (rule for raw rows)."""
    return col(c).try_cast("int") == 1


def text_flag(c: Column | str) -> Column:
    """``1`` or ``true`` in any case is true, everything else false (rule for loading)."""
    return F.coalesce(F.lower(text(c)).isin("1", "true"), F.lit(False))


def or_null_mark(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(NULL_MARK))


def money_text(c: Column | str) -> Column:
    """Two-decimal text of an amount, the same in every SQL engine."""
    return col(c).try_cast("decimal(18,2)").cast("string")


def row_id(*parts: Column | str) -> Column:
    """SHA-256 over the parts in order; equal rows always get equal ids."""
    return F.sha2(F.concat_ws(ID_SEPARATOR, *[or_null_mark(p) for p in parts]), 256)


def money_total(c: Column | str) -> Column:
    """Exact total as double; a group without amounts totals 0."""
    return F.coalesce(F.sum(col(c).try_cast(MONEY)).cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is null)."""
    return F.when(condition, 1).otherwise(0)


def direction(subject: Column | str, sender: Column | str, outgoing: str, incoming: str) -> Column:
    return F.when(col(sender) == col(subject), F.lit(outgoing)).otherwise(F.lit(incoming))


def same_name(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def clamp(c: Column | str, low: int = 1, high: int = 20, default: int = 5) -> Column:
    return F.least(F.greatest(F.coalesce(col(c), F.lit(default)), F.lit(low)), F.lit(high))


def result_cap(c: Column | str, most: int = 50) -> Column:
    """A missing limit becomes ``most`` and a larger one is lowered to it."""
    return F.least(F.coalesce(col(c), F.lit(most)), F.lit(most))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Column expressions for text clean-up, tolerant parsing and id lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The three accepted timestamp layouts, tried in this order.
TIMESTAMP_LAYOUTS = ("yyyy/M/d H:m", "yyyy-M-d H:m:s", "yyyy-M-d H:m")


def clean_text(value: Column) -> Column:
    """Text without surrounding white space; null becomes the empty string."""
    return F.coalesce(F.btrim(value.cast("string"), F.lit(WHITESPACE)), F.lit(""))


def parse_timestamp(value: Column) -> Column:
    """The first layout that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)) for layout in TIMESTAMP_LAYOUTS])


def safe_double(value: Column, fill: float | None = 0.0) -> Column:
    """Number or ``fill`` when the text is no number; ``fill=None`` keeps null."""
    number = value.try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    return number if fill is None else F.coalesce(number, F.lit(float(fill)))


def split_ids(value: Column, separators: str = ";") -> Column:
    """Trimmed, non-blank items of a delimited list, in order, duplicates kept."""
    items = F.transform(F.split(clean_text(value), f"[{separators}]"), clean_text)
    return F.filter(items, lambda item: item != "")


def contains_any(parts: Sequence[Column], terms: Sequence[str]) -> Column:
    """Do the joined, lower-cased parts contain any term as a substring?

    The terms look at one element of an array, so the text is put together once and not for every term.
    """
    text = F.concat_ws(" ", *[F.lower(clean_text(p)) for p in parts])
    wanted = [term.strip().lower() for term in terms]
    return F.exists(F.array(text), lambda t: reduce(lambda found, w: found | F.contains(t, F.lit(w)), wanted, F.lit(False)))


def money(value: Column) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(value, 2)


def account_role(account: Column, sender: Column, receiver: Column) -> Column:
    """How an account takes part in a payment."""
    return (
        F.when((sender == account) & (receiver == account), "self")
        .when(sender == account, "sender")
        .when(receiver == account, "receiver")
        .otherwise("unrelated")
    )

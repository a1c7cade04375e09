"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.schemas import MONEY

#: The characters that count as blank at the ends of form text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(text: Column) -> Column:
    """Text without surrounding whitespace; NULL when nothing is left."""
    return F.nullif(F.trim(text, F.lit(BLANKS)), F.lit(""))


def display_name() -> Column:
    """A customer's company name, else the person's name."""
    return F.coalesce(F.col("company_name"), F.col("full_name"))


def label(*parts: Column | str) -> Column:
    """Parts joined by ' / '; NULL as soon as one part is NULL."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = [columns[0]]
    for column in columns[1:]:
        joined += [F.lit(" / "), column]
    return F.concat(*joined)


def customer_label() -> Column:
    """'NAME / mail'; a missing name counts as empty."""
    name = F.upper(display_name())
    mail = F.lower(F.coalesce(F.col("email"), F.lit("no-email")))
    return F.concat_ws("", name, F.lit(" / "), mail)


def money(value: Column) -> Column:
    """Rounded half away from zero to cents."""
    return F.round(value, 2).cast(MONEY)


def line_amount(quantity: Column, unit_price: Column) -> Column:
    """The stored amount of a document line."""
    return money(quantity * unit_price)


def markup(price: Column, rate: str = "1.10") -> Column:
    """Price times a decimal rate, not rounded."""
    return price * F.expr(f"{rate}BD")


def document_number(prefix: str, number: Column) -> Column:
    """Prefix and the number padded to four digits; longer numbers stay whole."""
    return F.concat(F.lit(prefix), F.format_string("%04d", number))


def days_left(day: Column, as_of: date) -> Column:
    """Days from ``as_of`` to ``day``; negative once past."""
    return F.datediff(day, F.lit(as_of))


def expiry_class(day: Column, as_of: date, soon_days: int = 7) -> Column:
    """'expired', 'expiring' within ``soon_days`` or 'ok'."""
    return (
        F.when(day < F.lit(as_of), "expired")
        .when(day <= F.lit(as_of + timedelta(days=soon_days)), "expiring")
        .otherwise("ok")
    )


def in_days(stamp: Column, start: date, end: date) -> Column:
    """Whether a timestamp falls on a day from ``start`` to ``end``, both included.

    Written as a half-open range on the raw column so the scan can skip row groups.
    """
    first = datetime.combine(start, time())
    after = datetime.combine(end + timedelta(days=1), time())
    return (stamp >= F.lit(first)) & (stamp < F.lit(after))


def same_text(left: Column, right: Column) -> Column:
    """Equality in which NULL and '' are the same."""
    return F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit(""))


def record_id(*keys: str) -> Column:
    """'k1=v1, k2=v2' with the word null for a missing value."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]
    return F.concat_ws(", ", *parts)


def row_json(*columns: str) -> Column:
    """The columns as a JSON object that keeps NULL members."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def default_period(as_of: date, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """The last 30 days up to ``as_of`` unless given."""
    return start or as_of - timedelta(days=30), end or as_of

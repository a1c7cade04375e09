"""Form text in bulk: typed values and an error list per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.scalars import clean_text

#: Words that mean yes.
TRUE_WORDS = ("on", "true", "1", "yes")


@dataclass(frozen=True)
class FormField:
    name: str
    kind: str  # text, bool, int, decimal, date or datetime
    required: bool = False


def parse_bool(text: Column) -> Column:
    """True for on, true, 1 and yes in any case; everything else, NULL too, is false."""
    return F.coalesce(F.lower(text).isin(*TRUE_WORDS), F.lit(False))


def _int(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def _decimal(text: Column) -> Column:
    return text.try_cast("decimal(38,10)")


def _date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text).try_cast("date")


def _datetime(text: Column) -> Column:
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{1,2}$"), text)
    return shaped.try_cast("timestamp_ntz")


_PARSERS = {"int": _int, "decimal": _decimal, "date": _date, "datetime": _datetime}
_ERRORS = {"int": "not_an_integer", "decimal": "not_a_number", "date": "not_a_date", "datetime": "not_a_datetime"}


def parse_form_batch(forms: DataFrame, fields: list[FormField]) -> DataFrame:
    """Replaces the text columns by typed ones and adds ``errors``: 'field:problem' entries.

    A blank value is an error only where it is required.
    """
    names = {field.name for field in fields}
    cleaned = forms.select(
        *[c for c in forms.columns if c not in names],
        *[(F.col(f.name) if f.kind == "bool" else clean_text(F.col(f.name))).alias(f"_{f.name}") for f in fields],
    )

    def value(field: FormField) -> Column:
        text = F.col(f"_{field.name}")
        if field.kind == "bool":
            return parse_bool(text)
        return _PARSERS[field.kind](text) if field.kind in _PARSERS else text

    def problem(field: FormField) -> Column:
        text = F.col(f"_{field.name}")
        found = F.when(F.lit(field.required) & text.isNull(), F.lit(f"{field.name}:required"))
        if field.kind in _PARSERS:
            unread = text.isNotNull() & F.col(field.name).isNull()
            found = found.when(unread, F.lit(f"{field.name}:{_ERRORS[field.kind]}"))
        return found

    typed = cleaned.select("*", *[value(f).alias(f.name) for f in fields])
    problems = F.array_compact(F.array(*[problem(f) for f in fields if f.kind != "bool"]))
    return typed.select(*forms.columns, problems.alias("errors"))

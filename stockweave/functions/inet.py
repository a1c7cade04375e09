"""Network addresses as text, parsed to a canonical form in expressions.

Accepted are IPv4 with four decimal parts and IPv6 in full, shortened by ``::`` or with a dotted IPv4 end, each with an
optional prefix length behind a slash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOUR = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))


def _padded(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), "")


def _hex_of_six(text: Column) -> Column:
    """The 32 hex digits of IPv6 groups, NULL if they are not well formed."""

    def joined(left: Column, right: Column, short: Column) -> Column:
        known = F.size(left) + F.size(right)
        good = F.forall(F.concat(left, right), lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}$"))
        fits = F.when(short, known <= 7).otherwise(known == 8)
        zeros = F.repeat(F.lit("0000"), 8 - known)
        return F.when(good & fits, F.concat(_padded(left), zeros, _padded(right)))

    return _let(
        F.split(text, "::"),
        lambda halves: F.when(
            F.size(halves) <= 2,
            joined(
                _groups(F.get(halves, F.lit(0))),
                _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))),
                F.size(halves) == 2,
            ),
        ),
    )


def _parsed(address: Column, prefix: Column) -> Column:
    dotted = F.regexp_extract(address, rf"(?:^|:)({_FOUR})$", 1)
    parts = F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("int"))
    in_range = (dotted != "") & F.forall(parts, lambda x: F.coalesce(x <= 255, F.lit(False)))
    digits = F.lower(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))
    head = F.substring(address, F.lit(1), F.length(address) - F.length(dotted))
    six = F.when(dotted == "", address).when(
        in_range, F.concat(head, F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
    )
    four = in_range & (address == dotted)
    value = F.when(four, F.concat(F.lit("00000000000000000000ffff"), digits)).when(
        address.contains(":"), _hex_of_six(six)
    )
    most = F.when(four, 32).otherwise(128)
    length = F.when(prefix.isNull(), most).otherwise(F.when(prefix.rlike(r"^\d{1,3}$"), prefix.try_cast("int")))
    return _let(
        F.struct(value.alias("value"), length.alias("length"), most.alias("most"), four.alias("four")),
        lambda x: F.when(
            x["value"].isNull(), _result(None, None, None, F.lit("not_an_address"))
        ).when(
            F.coalesce((x["length"] > x["most"]), F.lit(True)), _result(None, None, None, F.lit("prefix_out_of_range"))
        ).otherwise(_result(F.when(x["four"], 4).otherwise(6), x["value"], x["length"], None)),
    )


def _result(family, value, prefix, reason) -> Column:
    def made(x, kind: str) -> Column:
        return (F.lit(None) if x is None else x).cast(kind)

    return F.struct(
        made(family, "int").alias("family"),
        made(value, "string").alias("value"),
        made(prefix, "int").alias("prefix"),
        made(reason, "string").alias("reason"),
    )


def parse_inet(text: Column) -> Column:
    """struct(family 4 or 6, value of 32 hex digits, prefix, reason) of an address.

    IPv4 takes the digits of its mapped IPv6 form. Text that is no address gives NULLs and a reason; NULL gives four NULLs.
    """
    parts = F.split(text, "/")
    return F.when(text.isNull(), _result(None, None, None, None)).otherwise(
        F.when(F.size(parts) > 2, _result(None, None, None, F.lit("not_an_address"))).otherwise(
            _parsed(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
        )
    )

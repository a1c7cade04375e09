"""Column functions, distributed scans and NULL semantics."""

from datetime import date, datetime
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockweave.functions.joins import left_lookup
from stockweave.functions.labels import display_flag, translate_code
from stockweave.functions.ordering import asc, desc
from stockweave.functions.parsing import FormField, parse_form_batch
from stockweave.functions.scalars import (
    clean_text,
    customer_label,
    default_period,
    document_number,
    expiry_class,
    in_days,
    label,
    row_json,
    same_text,
)
from stockweave.functions.scan import numbered, order_number, running_total


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df):
    return [r[0] for r in df.collect()]


def test_clean_text(spark):
    df = column(spark, ["  a b ", "\t\n", "", None, " x "])
    assert values(df.select(clean_text(F.col("v")))) == ["a b", None, None, None, "x"]


def test_label_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "x string, y int")
    assert values(df.select(label(F.col("x"), F.col("y")))) == ["a / 1", None]


def test_customer_label_skips_nulls(spark):
    df = spark.createDataFrame([(None, "Ann", None), (None, None, "A@B")], "company_name string, full_name string, email string")
    assert values(df.select(customer_label())) == ["ANN / no-email", " / a@b"]


def test_document_numbers_keep_long_ids(spark):
    df = column(spark, [7, 9999, 10000, 123456], "bigint")
    assert values(df.select(document_number("INV-WEB-", F.col("v")))) == [
        "INV-WEB-0007",
        "INV-WEB-9999",
        "INV-WEB-10000",
        "INV-WEB-123456",
    ]


def test_expiry_classes(spark):
    df = column(spark, [date(2026, 1, 9), date(2026, 1, 10), date(2026, 1, 17), date(2026, 1, 18)], "date")
    assert values(df.select(expiry_class(F.col("v"), date(2026, 1, 10)))) == ["expired", "expiring", "expiring", "ok"]


def test_period_includes_both_days(spark):
    stamps = [datetime(2026, 1, 1), datetime(2026, 1, 2, 23, 59, 59), datetime(2026, 1, 3)]
    df = column(spark, stamps, "timestamp_ntz")
    assert df.filter(in_days(F.col("v"), date(2026, 1, 1), date(2026, 1, 2))).count() == 2
    assert default_period(date(2026, 1, 31)) == (date(2026, 1, 1), date(2026, 1, 31))


def test_same_text_treats_null_as_blank(spark):
    df = spark.createDataFrame([(None, ""), (None, None), ("a", None), ("a", "a")], "x string, y string")
    assert values(df.select(same_text(F.col("x"), F.col("y")))) == [True, True, False, True]


def test_null_placement(spark):
    df = column(spark, [2, None, 1], "int")
    assert values(df.orderBy(asc("v"))) == [1, 2, None]
    assert values(df.orderBy(desc("v"))) == [None, 2, 1]


def test_row_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert values(df.select(row_json("a", "b"))) == ['{"a":1,"b":null}']


def test_translate_codes(spark):
    df = column(spark, ["paid", "Administrator, Client", "x, y", "free text", "", None, "system"])
    assert values(df.select(translate_code(F.col("v")))) == [
        "Оплачен",
        "Администратор, Клиент",
        "x, y",
        "free text",
        "—",
        "—",
        "система",
    ]
    assert values(column(spark, [True, False, None], "boolean").select(display_flag(F.col("v")))) == ["Да", "Нет", "—"]


def test_form_parsing(spark):
    rows = [
        (" 12 ", "1.50", "2026-1-5", "2026-01-05T08:30", "ON"),
        ("1.5", "x", "2026-02-30", "2026-01-05 8:5", "no"),
        ("  ", None, None, None, None),
    ]
    forms = spark.createDataFrame(rows, "i string, d string, day string, at string, flag string")
    fields = [
        FormField("i", "int", required=True),
        FormField("d", "decimal"),
        FormField("day", "date"),
        FormField("at", "datetime", required=True),
        FormField("flag", "bool"),
    ]
    got = parse_form_batch(forms, fields).collect()
    assert (got[0].i, got[0].d, got[0].day, got[0].at, got[0].flag, got[0].errors) == (
        12,
        D("1.5000000000"),
        date(2026, 1, 5),
        datetime(2026, 1, 5, 8, 30),
        True,
        [],
    )
    assert got[1].errors == ["i:not_an_integer", "d:not_a_number", "day:not_a_date"]
    assert got[1].at == datetime(2026, 1, 5, 8, 5)
    assert got[2].errors == ["i:required", "at:required"] and got[2].flag is False


def test_lookup_spreads_rows_without_key(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 2 else None) for i in range(40)], "id int, k int")
    side = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    got = {r.id: r.name for r in left_lookup(rows, side, "k", "id").collect()}
    assert got == {i: ({1: "one", 2: "two"}.get(i % 3) if i % 2 else None) for i in range(40)}


def test_text_order_number_follows_text(spark):
    words = ["", "1", "10", "10-2", "2", "9-1-1", "A", "a", "я", "яя"]
    df = column(spark, words)
    numbers = values(df.select(order_number(df, "v")))
    assert numbers == sorted(numbers)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(1, 100)), min_size=1, max_size=60
    )
)
def test_running_total_equals_loop(spark, items):
    rows = [(k, d, i * 7 % 1009, v) for i, (k, d, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    got = {r.id: r.total for r in running_total(df, ["k"], ["day", "id"], {"v": "total"}, group_by_day="day").collect()}
    want, sums = {}, {}
    for k, d, i, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want


def test_numbering_is_dense_and_ordered(spark):
    ids = [5, 900000000000, 7, 8, 9, 10, -3, 400, 401]
    got = [(r.v, r.number) for r in numbered(column(spark, ids, "bigint"), "v", start=100).collect()]
    assert sorted(got) == [(v, 101 + i) for i, v in enumerate(sorted(ids))]


def test_numbering_of_nothing(spark):
    assert numbered(column(spark, [], "bigint"), "v").count() == 0


def test_inet_forms(spark):
    """Against the standard library, for well-formed and broken addresses."""
    import ipaddress

    from stockweave.functions.inet import parse_inet

    texts = ["1.2.3.4", "255.255.255.255/0", "10.0.0.1/24", "::", "::1", "1::", "fe80::1:2/64", "2001:DB8:0:0:8:800:200C:417A"]
    texts += ["::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "64:ff9b::10.0.0.1/96", "::1.2.3.4"]
    bad = ["", " ", "1.2.3", "1.2.3.256", "1.2.3.4.5", "a.b.c.d", "1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::"]
    bad += ["g::1", ":1", "1:", "1.2.3.4:5", "1.2.3.4/1/2", "::1.2.3.999", "1:2:3:4:5:6:7:1.2.3.4", "host", "1.2.3.4 ", "[::1]"]
    wide = ["1.2.3.4/33", "::1/129", "1.2.3.4/", "::1/x", "1.2.3.4/-1"]
    df = spark.createDataFrame([(t,) for t in [*texts, *bad, *wide, None]], "t string")
    got = {r.t: r for r in df.select("t", parse_inet(F.col("t")).alias("p")).select("t", "p.*").collect()}
    for text in texts:
        address, _, prefix = text.partition("/")
        known = ipaddress.ip_address(address)
        whole = int(known) + (0xFFFF << 32 if known.version == 4 else 0)
        r = got[text]
        assert (r.family, r.value, r.reason) == (known.version, f"{whole:032x}", None), text
        assert r.prefix == int(prefix or known.max_prefixlen)
    assert {got[t].reason for t in bad} == {"not_an_address"} and {got[t].reason for t in wide} == {"prefix_out_of_range"}
    assert all(got[t].value is None and got[t].family is None for t in [*bad, *wide])
    assert tuple(got[None])[1:] == (None, None, None, None)


def test_text_ids_with_a_common_beginning_spread_over_chunks(spark):
    from stockweave.functions.scan import with_chunk

    ids = spark.range(1_000_000).select(F.format_string("ORD-WEB-%s-%07d", F.when(F.col("id") % 2 == 0, "A").otherwise("B"), "id").alias("t"))
    chunked = with_chunk(ids, "t")
    sizes = [r["count"] for r in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 20_000
    ordered = chunked.groupBy("_chunk").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("_chunk").collect()
    assert all(x.b < y.a for x, y in zip(ordered, ordered[1:]))

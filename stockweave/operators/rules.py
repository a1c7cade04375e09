"""Integrity rules as data-quality operators: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from stockweave.functions.scalars import record_id
from stockweave.integrity import RULES, Reference, Unique
from stockweave.schemas import PRIMARY_KEYS
from stockweave.session import cut_lineage

TableSet = Mapping[str, DataFrame]


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows; neighbours are united first, so that no part is analysed more often than the tree is high."""
    rows = list(parts)
    while len(rows) > 1:
        rows = [a.unionByName(b) for a, b in zip(rows[::2], rows[1::2])] + rows[len(rows) - len(rows) % 2 :]
    return rows[0]


def _broken_rows(df: DataFrame, table: str, predicates: dict[str, str]) -> DataFrame:
    """(table_name, rule, record_id) for every row and predicate that is false; NULL passes.

    All predicates of a table are tested in one scan.
    """
    failed = F.array(
        *[F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(rule)) for rule, sql in predicates.items()]
    )
    return (
        df.select(record_id(*PRIMARY_KEYS[table]).alias("record_id"), F.array_compact(failed).alias("failed"))
        .filter(F.size("failed") > 0)
        .select(F.lit(table).alias("table_name"), F.explode("failed").alias("rule"), "record_id")
    )


def check_rules(t: TableSet, tables: Iterable[str]) -> DataFrame:
    """Rows that break a row check."""
    return _union(_broken_rows(t[n], n, RULES[n].row_checks()) for n in tables if RULES[n].row_checks())


def conditional_rules(t: TableSet, tables: Iterable[str]) -> DataFrame:
    """Rows that break a check whose demand depends on a type or status."""
    return _union(_broken_rows(t[n], n, RULES[n].conditional) for n in tables if RULES[n].conditional)


def not_null_rules(t: TableSet, tables: Iterable[str]) -> DataFrame:
    """Rows with a NULL in a required column."""
    return _union(
        _broken_rows(t[n], n, {f"{c}_required": f"{c} IS NOT NULL" for c in RULES[n].required})
        for n in tables
        if RULES[n].required
    )


def unique_rules(t: TableSet, tables: Iterable[str]) -> DataFrame:
    """(table_name, rule, key_values, row_count) for every key that occurs more than once.

    Keys are counted by their hashes first, for all rules of a table in one pass; the hashes that occur more than once are
    written as a table in the shared folder. Only keys of rules with such hashes are read again and counted themselves, so
    the columns of the other keys, which are most, never move.
    """
    names = [n for n in tables if RULES[n].unique]
    repeated = cut_lineage(_union(_repeated_hashes(t[n], n, RULES[n].unique) for n in names))
    nothing = F.col("table_name").alias("rule"), F.col("table_name").alias("key_values"), F.col("key_hash").alias("row_count")
    parts = [repeated.limit(0).select("table_name", *nothing)]
    found = sorted(map(tuple, repeated.select("table_name", "number").distinct().collect()))
    for name in names:
        numbers = [number for table, number in found if table == name]
        if numbers:
            hashes = repeated.filter(F.col("table_name") == name).select("number", "key_hash")
            parts.append(_repeated_keys(t[name], name, {i: RULES[name].unique[i] for i in numbers}, hashes))
    return _union(parts)


def _counted(rule: Unique) -> Column:
    """Whether the rule counts a row."""
    counts = F.expr(rule.where) if rule.where else F.lit(True)
    return counts if rule.nulls_equal else reduce(lambda a, c: a & F.col(c).isNotNull(), rule.columns, counts)


def _repeated_hashes(df: DataFrame, table: str, rules: Sequence[Unique]) -> DataFrame:
    """(table_name, number, key_hash) of the rules' keys that share their hash with the key of another row."""
    entries = [
        F.struct(F.when(_counted(rule), F.lit(number)).alias("number"), F.xxhash64(*rule.columns).alias("key_hash"))
        for number, rule in enumerate(rules)
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("entry"))
        .select("entry.*")
        .filter(F.col("number").isNotNull())
        .groupBy("number", "key_hash")
        .agg(F.count("*").alias("row_count"))
        .filter(F.col("row_count") > 1)
        .select(F.lit(table).alias("table_name"), "number", "key_hash")
    )


def _repeated_keys(df: DataFrame, table: str, rules: Mapping[int, Unique], hashes: DataFrame) -> DataFrame:
    """The keys that occur more than once, among those with one of the ``hashes``, which are written to the shared folder."""
    columns = sorted({c for rule in rules.values() for c in rule.columns})
    kinds = {c: df.schema[c].dataType for c in columns}
    entries, names, texts = [], F.lit(None), F.lit(None)
    for number, rule in rules.items():
        keys = [F.col(c) if c in rule.columns else F.lit(None).cast(kinds[c]) for c in columns]
        number_of = F.when(_counted(rule), F.lit(number)).alias("number")
        key_hash = F.xxhash64(*rule.columns).alias("key_hash")
        entries.append(F.struct(number_of, key_hash, *[key.alias(c) for key, c in zip(keys, columns)]))
        names = F.when(F.col("number") == number, F.lit(rule.name)).otherwise(names)
        texts = F.when(F.col("number") == number, record_id(*rule.columns)).otherwise(texts)
    shared = (
        df.select(F.explode(F.array(*entries)).alias("entry"))
        .select("entry.*")
        .filter(F.col("number").isNotNull())
        .join(hashes, ["number", "key_hash"], "left_semi")
        .select("number", *columns)
    )
    return (
        cut_lineage(shared)
        .groupBy("number", *columns)
        .agg(F.count("*").alias("row_count"))
        .filter(F.col("row_count") > 1)
        .select(F.lit(table).alias("table_name"), names.alias("rule"), texts.alias("key_values"), "row_count")
    )


#: References that one pass tells apart by the bits of a number; the next bit says that the parent has the key.
BITS = 62

#: What stands in keys that are numbers, days, times or ids made of them, beside digits; each has a hex digit instead.
SIGNS = {"-": "A", "\u0001": "B", ".": "D", ":": "E", " ": "F"}


def short_key(text: Column) -> Column:
    """The text as bytes, two characters to a byte where it has only digits and ``SIGNS``; other texts keep their length.

    Different texts stay different: short ones begin with a byte from C0 to CF, others with 00.
    """
    known = "^[0-9" + "".join(rf"\x{ord(sign):02x}" for sign in SIGNS) + r"]*\z"
    digits = reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit(SIGNS[sign])), SIGNS, text)
    lead = F.when(F.octet_length(text) % 2 == 1, F.lit("C")).otherwise(F.lit("CC"))
    plain = F.concat(F.lit(b"\0"), text.cast("binary"))
    return F.when(text.rlike(known), F.unhex(F.concat(lead, digits))).otherwise(plain)


def key_text(key: Column) -> Column:
    """The text that ``short_key`` made the bytes of."""
    digits = F.hex(key)
    short = F.substr(digits, F.when(digits.startswith("CC"), F.lit(3)).otherwise(F.lit(2)))
    short = reduce(lambda x, sign: F.replace(x, F.lit(SIGNS[sign]), F.lit(sign)), SIGNS, short)
    return F.when(digits.startswith("C"), short).otherwise(F.substr(key, F.lit(2)).cast("string"))


def _target(rule: Reference) -> str:
    return ".".join([rule.parent, *rule.parent_columns])


def _reference_key(t: TableSet, rule: Reference, of_parent: bool) -> tuple[str, Column]:
    """The kind of the key, whole or text, and the key in the types of the parent; NULL where a part is NULL.

    Texts, and keys of several columns, are bytes of ``short_key``.
    """
    kinds = [t[rule.parent].schema[p].dataType for p in rule.parent_columns]
    names = rule.parent_columns if of_parent else rule.columns
    if len(kinds) == 1 and isinstance(kinds[0], IntegralType):
        return "whole", F.col(names[0]).cast("bigint")
    parts = [F.col(c).cast(kind).cast("string") for c, kind in zip(names, kinds)]
    joined = [x for part in parts for x in (F.lit("\u0001"), part)]
    return "text", short_key(F.concat(*joined[1:]))


def _references(t: TableSet, tables: Iterable[str]) -> list[tuple[str, Reference]]:
    return [(n, rule) for n in tables for rule in RULES[n].references if rule.parent in t]


def reference_keys(t: TableSet, references: Sequence[tuple[str, Reference]]) -> DataFrame:
    """(target, whole, text, held) of every key that a parent has or a child refers to.

    The key is a whole number or a text. ``held`` has a bit for each of ``references``, of at most ``BITS``, that uses
    the key, and bit ``BITS`` if the parent has it. Each table is read once for all keys of one kind that it has and
    refers to, and one aggregate for each kind serves all parents. A key that many rows refer to is one row per task
    before it moves, and nothing but the key and the bits does.
    """
    targets = sorted({_target(rule) for _, rule in references})
    entries: dict[tuple[str, str], list[Column]] = {}

    def add(name: str, rule: Reference, of_parent: bool, bit: int) -> None:
        kind, key = _reference_key(t, rule, of_parent)
        entry = F.struct(
            F.lit(targets.index(_target(rule))).alias("target"),
            key.alias("key"),
            F.lit(1 << bit).cast("bigint").alias("held"),
        )
        entries.setdefault((kind, name), []).append(entry)

    for number, (name, rule) in enumerate(references):
        add(name, rule, False, number)
    for rule in {_target(rule): rule for _, rule in references}.values():
        add(rule.parent, rule, True, BITS)
    parts = []
    for kind in sorted({kind for kind, _ in entries}):
        rows = _union(
            t[n].select(F.explode(F.array(*found)).alias("e")).select("e.*").filter(F.col("key").isNotNull())
            for (k, n), found in entries.items()
            if k == kind
        )
        key = {"whole": F.lit(None).cast("bigint"), "text": F.lit(None).cast("binary"), kind: F.col("key")}
        parts.append(
            rows.groupBy("target", "key")
            .agg(F.bit_or("held").alias("held"))
            .select("target", key["whole"].alias("whole"), key["text"].alias("text"), "held")
        )
    return _union(parts)


def _held_numbers(references: Sequence) -> Column:
    return F.filter(F.array(*[F.lit(i) for i in range(len(references))]), lambda i: F.getbit("held", i) == 1)


def fk_rules(t: TableSet, tables: Iterable[str]) -> DataFrame:
    """Rows that refer to a parent that does not exist; a NULL in the reference passes.

    The keys without a parent are found first, for all references together, and written as a table in the shared
    folder. Only children that hold such keys are read again, to name their rows.
    """
    every = _references(t, tables)
    parts = []
    for start in range(0, len(every), BITS):
        references = every[start : start + BITS]
        missing = cut_lineage(
            reference_keys(t, references)
            .filter(F.getbit("held", F.lit(BITS)) == 0)
            .select(F.explode(_held_numbers(references)).alias("number"), "whole", "text")
        )
        nothing = F.lit("").alias("table_name"), F.lit("").alias("rule"), F.col("text").cast("string").alias("record_id")
        parts.append(missing.limit(0).select(*nothing))
        for (number,) in sorted(missing.select("number").distinct().collect()):
            name, rule = references[number]
            kind, key = _reference_key(t, rule, of_parent=False)
            lost = missing.filter(F.col("number") == number).select(F.col(kind).alias("missing_key"))
            parts.append(
                t[name]
                .join(lost, key == F.col("missing_key"), "left_semi")
                .select(
                    F.lit(name).alias("table_name"),
                    F.lit(rule.name).alias("rule"),
                    record_id(*PRIMARY_KEYS[name]).alias("record_id"),
                )
            )
    return _union(parts)


def delete_restrict(t: TableSet, parent: str) -> DataFrame:
    """Rows of ``parent`` that may not be deleted, with the reference that holds them."""
    every = [(n, rule) for n, rule in _references(t, [n for n in RULES if n in t]) if rule.parent == parent]
    rows = []
    for columns in sorted({rule.parent_columns for _, rule in every}):
        references = [(n, rule) for n, rule in every if rule.parent_columns == columns]
        kind, key = _reference_key(t, references[0][1], of_parent=True)
        for start in range(0, len(references), BITS):
            some = references[start : start + BITS]
            names = F.array(*[F.lit(f"{n}.{rule.name}") for n, rule in some])
            held = (
                _child_keys(t, some)
                .groupBy("held_key")
                .agg(F.bit_or("held").alias("held"))
                .select("held_key", F.transform(_held_numbers(some), lambda i: F.get(names, i)).alias("names"))
            )
            rows.append(
                t[parent]
                .join(held, key == F.col("held_key"))
                .select(
                    F.lit(parent).alias("table_name"),
                    record_id(*PRIMARY_KEYS[parent]).alias("record_id"),
                    F.explode("names").alias("held_by"),
                )
            )
    return _union(rows)


def _child_keys(t: TableSet, references: Sequence[tuple[str, Reference]]) -> DataFrame:
    """(held_key, held) of the references to one parent; each child is read once."""
    entries: dict[str, list[Column]] = {}
    for number, (name, rule) in enumerate(references):
        _, key = _reference_key(t, rule, of_parent=False)
        entry = F.struct(key.alias("held_key"), F.lit(1 << number).cast("bigint").alias("held"))
        entries.setdefault(name, []).append(entry)
    return _union(
        t[n].select(F.explode(F.array(*found)).alias("e")).select("e.*").filter(F.col("held_key").isNotNull())
        for n, found in entries.items()
    )


def delivery_expiry(t: TableSet) -> DataFrame:
    """Delivery lines that expire on or before the delivery day, or have no delivery."""
    headers = t["raw_material_deliveries"].select("delivery_id", "delivery_date")
    reason = F.when(F.col("delivery_date").isNull(), "delivery_missing").when(
        F.col("expiry_date") <= F.col("delivery_date"), "expiry_not_after_delivery"
    )
    return (
        t["delivery_items"]
        .join(headers, "delivery_id", "left")
        .select("delivery_item_id", "delivery_id", "delivery_date", "expiry_date", reason.alias("rule"))
        .filter(F.col("rule").isNotNull())
    )


def shipment_dates(t: TableSet) -> DataFrame:
    """Shipments that left before their order was placed, or have no order; unshipped ones pass."""
    headers = t["customer_orders"].select("order_id", "order_date")
    reason = F.when(F.col("order_date").isNull(), "order_missing").when(
        F.col("shipped_at") < F.col("order_date"), "shipped_before_order"
    )
    return (
        t["shipments"]
        .filter(F.col("shipped_at").isNotNull())
        .join(headers, "order_id", "left")
        .select("shipment_id", "order_id", "order_date", "shipped_at", reason.alias("rule"))
        .filter(F.col("rule").isNotNull())
    )


def rows_with_unfit_user(
    t: TableSet, table: str, column: str, role_codes: tuple[str, ...], required: bool = False
) -> DataFrame:
    """Rows of ``table`` whose user in ``column`` is not an active holder of one of the roles.

    A missing user passes unless ``required``.
    """
    holders = t["user_roles"].join(t["roles"].filter(F.col("role_code").isin(*role_codes)), "role_id").select("user_id")
    fit = (
        t["users"]
        .filter(F.col("status_code") == "active")
        .join(holders, "user_id", "left_semi")
        .select(F.col("user_id").alias(column))
    )
    named = t[table] if required else t[table].filter(F.col(column).isNotNull())
    return named.join(fit, column, "left_anti")


def role_holder_check(
    t: TableSet, table: str, column: str, role_codes: tuple[str, ...], required: bool = False
) -> DataFrame:
    """The rows of ``rows_with_unfit_user`` as rule violations."""
    return rows_with_unfit_user(t, table, column, role_codes, required).select(
        F.lit(table).alias("table_name"),
        record_id(*PRIMARY_KEYS[table]).alias("record_id"),
        F.lit(column).alias("user_column"),
        F.col(column).alias("user_id"),
    )

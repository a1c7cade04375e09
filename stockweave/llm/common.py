"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words, from the spaces left after runs of white space become one."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    spaces = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", F.lit(0).cast("long")).otherwise((spaces + 1).cast("long"))


def text_key(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart; null differs from empty."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def md5_number(text: Column) -> Column:
    """60 bits of the MD5 of a text, as a number that other engines can make too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi join on columns of one name, null equal to null; the keys of ``right`` are dropped."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(renamed[f"_right_{name}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{name}" for name in names])


def quoted(name: str) -> str:
    """A column name that may hold dots or back-ticks, for a path."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the others as one struct ``row``, so that no name of theirs can clash with one used here."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(others or [F.lit(None).alias("none")])).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, *names: str, sized: bool = False) -> DataFrame:
    """The columns of ``docs`` from the ``packed`` form; ``sized`` lets ``n_chars``, where there is one, follow ``text``."""
    columns = []
    for field in docs.schema:
        here = F.col(field.name if field.name in names else f"row.{quoted(field.name)}")
        if sized and field.name == "n_chars":
            here = F.length("text").cast(field.dataType)
        columns.append(here.alias(field.name))
    return rows.select(*columns)

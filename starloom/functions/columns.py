"""Column expressions of the dimensional model. All are built-ins, so they stay in code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels and members that tables must share to join.
BEGINNING, FOREVER = "1900-01-01 00:00:00", "9999-12-31 23:59:59"
UNKNOWN, NOT_APPLICABLE = "UNKNOWN", "NOT_APPLICABLE"
SEPARATOR, MISSING = "\u001f", "\u0000"


def beginning(kind: str = "timestamp") -> Column:
    """The instant before all data, in the type of the column that it stands beside."""
    return F.lit(BEGINNING).cast(kind)


def forever(kind: str = "timestamp") -> Column:
    """The instant after all data."""
    return F.lit(FOREVER).cast(kind)


def surrogate_key(*keys: Column | str) -> Column:
    """SHA-256 of the keys as text, null as UNKNOWN, so that equal members get equal keys everywhere."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(UNKNOWN)) for k in keys]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def unknown_key() -> Column:
    return F.sha2(F.lit(UNKNOWN), 256)


def fingerprint(*names: str) -> Column:
    """One text of several columns in which no two different rows agree; null differs from empty."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(n).cast("string"), F.lit(MISSING)) for n in names])


def differs(names: list[str], before: dict[str, Column]) -> Column:
    """Whether any column is distinct from its earlier value, nulls compared as values."""
    return reduce(lambda a, b: a | b, [~F.col(n).eqNullSafe(before[n]) for n in names])


def date_key(day: Column | str) -> Column:
    """yyyymmdd as int, by arithmetic rather than through text."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def category_code(category: Column, kind: Column, product: Column, carrying: tuple[str, ...] = ("DEBIT",), never: tuple[str, ...] = ("HOME_LOAN", "TERM_DEPOSIT")) -> Column:
    """The category, or what its absence means: UNKNOWN where one should be, else NOT_APPLICABLE.

    One should be on kinds of ``carrying`` unless the product is one that ``never`` has any.
    """
    expected = kind.isin(*carrying) & ~F.coalesce(product, F.lit("")).isin(*never)
    return F.when(~is_blank(category), category).when(expected, F.lit(UNKNOWN)).otherwise(F.lit(NOT_APPLICABLE))


def title_of(code: Column) -> Column:
    """A code as a name: underscores as spaces, each word capitalised."""
    return F.initcap(F.regexp_replace(code, "_", " "))


def money(value: Column, kind: str = "decimal(18,2)") -> Column:
    """A sum back in its declared type, null as zero."""
    return F.coalesce(value, F.lit(0)).cast(kind)

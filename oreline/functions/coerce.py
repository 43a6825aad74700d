"""Null-like values, ratios and means in the conventions the metrics use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$"
# Label vocabularies.
POSITIVE = ("1", "true", "yes", "y", "supported", "correct", "equivalent", "match")
NEGATIVE = ("0", "false", "no", "n", "unsupported", "incorrect", "not_equivalent", "mismatch")


def nan() -> Column:
    return F.lit(float("nan"))


def strip(c: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def opt_str(c: Column, zero: bool = False) -> Column:
    """Stripped text, empty for null; ``zero``: also for the number 0 and false."""
    s = F.coalesce(strip(c.cast("string")), F.lit(""))
    return F.when(s.isin("0", "0.0", "false"), F.lit("")).otherwise(s) if zero else s


def first_non_empty(*cs: Column) -> Column:
    """The first value that is non-empty when stripped, else empty."""
    return F.coalesce(*[F.when(opt_str(c) != "", opt_str(c)) for c in cs], F.lit(""))


def text_list(c: Column) -> Column:
    """Stripped non-empty elements of an array of strings; null gives an empty array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: opt_str(x)), lambda x: x != "")


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(default))


def rate(n: Column, d: Column) -> Column:
    """``n / d``, NaN where there is nothing to divide by."""
    return F.when(d > 0, n / d).otherwise(nan())


def rate_zero(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def rate_floor(n: Column, d: Column) -> Column:
    """``n / max(1, d)``."""
    return n / F.greatest(F.lit(1), d)


def mean(c: Column) -> Column:
    """Aggregate mean, NaN over nothing."""
    return F.coalesce(F.avg(c), nan())


def low_if_missing(c: Column) -> Column:
    """Null and NaN become minus infinity, as Spark sorts NaN above all numbers."""
    return F.when(c.isNull() | F.isnan(c), F.lit(float("-inf"))).otherwise(c.cast("double"))


def high_if_missing(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(float("inf"))).otherwise(c.cast("double"))


def label_to_bool(c: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """True, false or null by vocabulary, whatever the letter case."""
    s = F.lower(opt_str(c))
    return F.when(s.isin(*positive), F.lit(True)).when(s.isin(*negative), F.lit(False))


def count_true(c: Column) -> Column:
    """Aggregate count of true; null counts as false."""
    return F.count_if(F.coalesce(c, F.lit(False)))


def require(df, *columns: str) -> None:
    """Raise if a column is missing."""
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")


def only_where(df, need: Column, body, otherwise=lambda x: x):
    """``body`` over the rows that need it, the others as they are with its columns null (or after
    ``otherwise``): unlike a conditional expression this keeps a Python or model UDF from running on rows
    that skip it. What comes before is computed on both sides, so a costly step belongs inside."""
    marked = once(df, _need=F.coalesce(need, F.lit(False)))
    return body(marked.where("_need").drop("_need")).unionByName(otherwise(marked.where("not _need").drop("_need")), allowMissingColumns=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df, **columns: Column):
    """``df`` with columns that are evaluated once a row: a generator stands between them and what uses
    them, so that neither filters nor projections copy a costly expression."""
    made = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.col(f"_once.{k}").alias(k) for k in columns])

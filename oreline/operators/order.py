"""Order as data: global positions without a global window, top rows per key, seeded shuffles."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_rank(df: DataFrame, by: list[Column], keys: list[str] | None = None, name: str = "rank", total: str | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with the position (from 1) of each row of its group in the order ``by``, and optionally
    the group's size, although a group (with no ``keys``: the whole table) may be very large.

    Rows are range-partitioned by (keys, by); counts per partition and group give the offsets, and each
    partition only counts on. ``by`` should be a total order; nulls of keys form a group. With a ``weight``
    a row counts as so many, and its position is the last of them."""
    keys = keys or []
    sort = [*[F.col(k) for k in keys], *by]
    ranged = cut_lineage(df.repartitionByRange(*sort).withColumn("_p", F.spark_partition_id())) if sort else df
    group = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys]
    ranged = ranged.withColumn("_g", F.concat_ws("\x01", *group) if group else F.lit(""))
    size = F.lit(1) if weight is None else F.col(weight)
    counts = ranged.groupBy("_g", "_p").agg(F.sum(size).alias("_n"))
    over = Window.partitionBy("_g")
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(over)).drop("_n")
    within = Window.partitionBy("_g", "_p").orderBy(*by)
    local = ranged.withColumn("_r", F.row_number().over(within) if weight is None else F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(offsets, ["_g", "_p"]).withColumn(name, F.col("_before") + F.col("_r"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_g", "_p", "_r", "_before", "_total")


def first_per(df: DataFrame, keys: list[str], by: list[Column], also: dict[str, Column] | None = None) -> DataFrame:
    """The first row of each group in the order ``by``, as a partial aggregate of one row per group and task:
    no group is gathered (the aggregate sorts by key, so rows should be slim). ``by`` are ascending
    comparable columns (negate for descending); ``also``: aggregates of the group to keep beside it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)])).alias("x"), *[c.alias(k) for k, c in (also or {}).items()]).select("x.*", *(also or {}))


def seeded(key: Column, seed: int) -> Column:
    """A shuffle key: rows sorted by it are in a seeded random order, however they are partitioned."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def permutation(n: int, seed: int) -> list[int]:
    """Order of 0..n-1 after a seeded Mersenne Twister shuffle: ``result[k]`` is the row at place k."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def permuted(df: DataFrame, order: str, seed: int, most: int = 5_000_000, name: str = "shuffled") -> DataFrame:
    """``df`` with its place after the same shuffle; ``order`` numbers its rows from 0. Exact parity
    needs the permutation on the driver, so tables above ``most`` rows are refused (use :func:`seeded`)."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for a driver-made permutation")
    places = [(row, place) for place, row in enumerate(permutation(n, seed))]
    spark = df.sparkSession
    table = spark.createDataFrame(places or [], f"{order} bigint, {name} bigint")
    return df.withColumn(order, F.col(order).cast("bigint")).join(table, order)

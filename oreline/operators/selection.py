"""Selection and confidence: best candidate per example, terciles, ranks, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import low_if_missing, nan
from .order import first_per, global_rank


def selection_score(margin: Column, support: Column, f1: Column, evidence: Column) -> Column:
    """Stored beside the candidates; ranking goes by the keys of :func:`best_candidates`."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.coalesce(margin * 100.0, F.lit(-1e6)) + 10.0 * z(support) + 5.0 * z(f1) - 0.1 * z(evidence)


def best_candidates(df: DataFrame, key: str = "id", order: str = "_ord") -> DataFrame:
    """The best hard-passing candidate of each example: largest margin (null last), support rate and
    token F1, fewest quotes (none is worst), smallest ``candidate_id``, first in order. ``group_order`` is
    the place of the example's first passing candidate: sorted by it, examples come as first seen."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    quotes = F.when(z("evidence_count") == 0, F.lit(float("inf"))).otherwise(z("evidence_count"))
    by = [-low_if_missing(F.col("margin")), -z("support_rate"), -z("token_f1"), quotes, F.coalesce("candidate_id", F.lit(0)), F.col(order)]
    return first_per(df.where("hard_pass"), [key], by, {"group_order": F.min(order)})


def first_valid(df: DataFrame, key: str = "id", order: str = "_ord") -> DataFrame:
    """The hard-passing candidate with the smallest ``candidate_id``, then first in order, with ``group_order``."""
    return first_per(df.where("hard_pass"), [key], [F.coalesce("candidate_id", F.lit(0)), F.col(order)], {"group_order": F.min(order)})


def tercile(rank: Column, n: Column, low: str = "low", high: str = "high") -> Column:
    """Label by ascending rank: the lowest and highest thirds rounded down, one row medium, two rows low
    and high."""
    third = F.floor(n / 3)
    return (
        F.when(n == 1, "medium").when(n == 2, F.when(rank == 1, low).otherwise(high))
        .when(rank <= third, low).when(rank > n - third, high).otherwise("medium")
    )


def with_terciles(df: DataFrame, value: str, order: str = "_ord", keys: list[str] | None = None, name: str = "derived_confidence", reverse: bool = False) -> DataFrame:
    """``df`` with the tercile of ``value`` among its non-null values, ties in input order; ``reverse``:
    the lowest value is ``high``. Rows without a value get null."""
    have = global_rank(df.where(F.col(value).isNotNull()), [F.col(value), F.col(order)], keys, "_rank", "_size")
    label = tercile(F.col("_rank"), F.col("_size"), *(("high", "low") if reverse else ("low", "high")))
    done = have.withColumn(name, label).drop("_rank", "_size")
    return done.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("string")))


def average_rank(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """``df`` with the rank of ``value`` in its group, equal values sharing their mean rank. Only distinct
    values are ranked, with the number of their rows as weight, and in ranges, so that a continuous value
    of one large group isn't one task's."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = global_rank(counts, [F.col(value)], keys, "_upto", weight="_c").withColumn(name, F.col("_upto") - (F.col("_c") - 1) / 2.0).drop("_c", "_upto")
    return df.join(ranks, [*keys, value])


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation from moments; null for fewer than two pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    pick = lambda c: F.when(both, c)
    n = F.count_if(both)
    cov = F.covar_pop(pick(F.col(x)).cast("double"), pick(F.col(y)).cast("double"))
    den = F.stddev_pop(pick(F.col(x))) * F.stddev_pop(pick(F.col(y)))
    return F.when((n >= 2) & (den > 0), cov / F.when(den > 0, den))


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``pearson, spearman, n`` of the pairs without nulls, by group."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_rank(average_rank(pairs, "x", keys, "rx"), "y", keys, "ry")
    return ranked.groupBy(*keys).agg(pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def buckets(df: DataFrame, keys: list[str], bucket: str, labels: list[str], **means: str) -> DataFrame:
    """Count and means per group and label, labels without rows included (count 0, NaN)."""
    domain = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in labels])).alias(bucket))
    stats = df.groupBy(*keys, bucket).agg(F.count("*").alias("n"), *[F.avg(c).alias(k) for k, c in means.items()])
    return domain.join(stats, [*keys, bucket], "left").select(*keys, bucket, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(k, nan()).alias(k) for k in means])


def murphy(df: DataFrame, keys: list[str], bucket: str, y: str) -> DataFrame:
    """Normalised resolution of a binary outcome over buckets, and the rows it rests on; NaN without
    uncertainty. Two partial aggregates."""
    per = df.groupBy(*keys, bucket).agg(F.count(y).alias("m"), F.sum(F.col(y).cast("double")).alias("s")).where("m > 0")
    mu = F.sum("s") / F.sum("m")
    # sum of m (s/m - mu)^2 = sum of s^2/m - (sum of s)^2 / sum of m
    res = (F.sum(F.col("s") * F.col("s") / F.col("m")) - F.sum("s") * F.sum("s") / F.sum("m")) / F.sum("m")
    unc = mu * (1 - mu)
    return per.groupBy(*keys).agg(F.when(unc > 0, F.greatest(res, F.lit(0.0)) / F.when(unc > 0, unc)).otherwise(nan()).alias("resolution"), F.sum("m").alias("n"))


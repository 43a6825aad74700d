"""Problem 9: mixing sources to target weights, as a time-varying curriculum.

Every source has a weight schedule over training time; its integral is the source's cumulative token
demand. Documents are laid out by cumulative tokens in hash order, each repetition after the other,
and the inverse of the demand turns a document's offset into its training position, by which the
mixture is sorted in ranges. Prefix sums go through hash ranges, so no source is gathered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Mixtures of more sources than this are refused: schedules are broadcast.
MAX_SOURCES = 100_000


def token_count(path: str = TOKENIZER):
    """A function from a text column to its number of tokens under the vocabulary file ``path``
    (ranks, base64); special strings are ordinary text, null and empty texts have 0 tokens."""
    made: list = []

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if not made:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            made.append(tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        encode = made[0].encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def sized(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``; the source trimmed, blank is null."""
    source = F.trim("source")
    return docs.select("doc_id", F.when(source != "", source).alias("source"), F.coalesce(token_count(path)(F.col("text")), F.lit(0)).alias("n_tokens"))


def capacity(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``source, target_permille, max_repeats, n_tokens`` (all its documents once),
    and ``total`` (all documents of all sources)."""
    by_source = cut_lineage(sizes.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")))  # read twice: tokens are counted once
    whole = by_source.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).scalar()
    t = targets.select(F.trim("source").alias("source"), "target_permille", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    joined = t.join(by_source.where("source is not null"), "source", "left").withColumn("total", whole)
    return joined.select("source", "target_permille", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "total")


def schedules(targets: list[tuple[str, float]], tilt: dict[str, float] | None = None) -> list[tuple[str, list[float], list[float]]]:
    """``(source, times, weights)`` with straight lines between: constant at the share, or rising
    (falling) over time by ``tilt`` in -1..1 of the share. The integral stays the share."""
    tilt = tilt or {}
    out = []
    for source, share in targets:
        a = max(-1.0, min(1.0, tilt.get(source, 0.0)))
        out.append((source, [0.0, 1.0], [share * (1 - a), share * (1 + a)]))
    return out


def integrate(times: list[float], weights: list[float]) -> list[float]:
    """Cumulative integral of the piecewise linear weights at each time."""
    if len(times) != len(weights) or len(times) < 2 or any(b <= a for a, b in zip(times, times[1:])) or min(weights) < 0:
        raise ValueError("a schedule needs rising times and non-negative weights")
    out = [0.0]
    for k in range(len(times) - 1):
        out.append(out[-1] + (weights[k] + weights[k + 1]) / 2 * (times[k + 1] - times[k]))
    return out


def invert(y: Column, times: Column, weights: Column, cumulative: Column) -> Column:
    """Time at which the cumulative demand reaches ``y``: find the segment, solve its quadratic."""
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(cumulative, lambda c: c <= y)), F.size(times) - 1))
    t0, t1 = F.element_at(times, k), F.element_at(times, k + 1)
    w0, w1 = F.element_at(weights, k), F.element_at(weights, k + 1)
    rest = F.greatest(y - F.element_at(cumulative, k), F.lit(0.0))
    slope = (w1 - w0) / (t1 - t0)
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    return F.least(t1, t0 + F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(F.lit(0.0)))


def curriculum(sizes: DataFrame, targets: DataFrame, tilt: dict[str, float] | None = None) -> DataFrame:
    """The plan of a mixture as large as all of ``sizes``, one row per target source (at most
    :data:`MAX_SOURCES`, so it may be broadcast): ``source, target, total, demand`` (tokens asked for by the
    end, from the integral of its schedule), ``own`` (tokens it has), ``epochs`` (repetitions begun),
    ``runs_dry`` (training time at which its last repetition ends; null if it lasts), ``times, weights,
    cumulative``."""
    spark = sizes.sparkSession
    caps = capacity(sizes, targets).limit(MAX_SOURCES + 1).collect()
    if len(caps) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source = {r.source: r for r in caps}
    rows = []
    for source, times, weights in schedules([(r.source, (r.target_permille or 0) / 1000) for r in by_source.values()], tilt):
        r = by_source[source]
        cumulative = integrate(times, weights)
        demand = cumulative[-1] * r.total
        epochs = int(min(r.max_repeats, -(-demand // r.n_tokens))) if r.n_tokens > 0 and demand > 0 else 0
        rows.append((source, (r.target_permille or 0) / 1000, float(r.total), demand, int(r.n_tokens), epochs, float(r.n_tokens * r.max_repeats), times, weights, cumulative))
    plan = spark.createDataFrame(rows, "source string, target double, total double, demand double, own bigint, epochs int, most double, times array<double>, weights array<double>, cumulative array<double>")
    dry = F.when(F.col("most") < F.col("demand"), invert(F.col("most") / F.col("total"), F.col("times"), F.col("weights"), F.col("cumulative")))
    return plan.withColumn("runs_dry", dry).drop("most")


def unreachable(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``source`` of every target that runs dry before the mixture ends: its tokens times ``max_repeats`` fall
    short of its demand, its share of all tokens of ``docs``. Null sources count in the whole, a source
    without documents has no tokens."""
    return curriculum(sized(docs, path), targets).where("runs_dry is not null").select("source")


def mixture(docs: DataFrame, targets: DataFrame, tilt: dict[str, float] | None = None, path: str = TOKENIZER, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``position, doc_id, source, copy, n_tokens`` of the mixture, sorted by position in 0..1.

    As large as all of ``docs``; a document is used at most ``max_repeats`` times, and only begun
    while its source's demand isn't met (so a source overshoots by less than one document). Documents
    of other or null sources and those without tokens aren't used. Repeated rows of a document are
    distinct documents here. Empty tables give an empty mixture."""
    sizes = cut_lineage(sized(docs, path))
    return laid_out(sizes, curriculum(sizes, targets, tilt), seed, buckets)


def laid_out(sizes: DataFrame, plan: DataFrame, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """The mixture of ``sizes(doc_id, source, n_tokens)`` under the plan of :func:`curriculum`."""
    plan = F.broadcast(plan.where("epochs > 0"))
    used = sizes.where("n_tokens > 0").join(plan.select("source"), "source", "left_semi").withColumn("k", F.xxhash64(F.lit(seed), "doc_id"))
    used = used.withColumn("b", F.shiftright("k", 64 - (buckets - 1).bit_length()))
    starts = used.groupBy("source", "b").agg(F.sum("n_tokens").alias("m"))
    starts = starts.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "b").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = used.withColumn("inside", inside).join(starts, ["source", "b"]).join(plan, "source")
    copies = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    at = F.col("copy") * F.col("own") + F.col("before") + F.col("inside")
    placed = copies.withColumn("at", at).where("at < demand")
    position = invert((F.col("at") + F.col("n_tokens") / 2) / F.col("total"), F.col("times"), F.col("weights"), F.col("cumulative"))
    return placed.select(position.alias("position"), "doc_id", "source", "copy", "n_tokens").orderBy("position", "doc_id", "copy")


def reached_shares(docs: DataFrame, targets: DataFrame, tilt: dict[str, float] | None = None, path: str = TOKENIZER) -> DataFrame:
    """``source, target, share, share_of_demand, most_copies`` per target source: its share of the
    mixture's tokens, the part of its demand met, and how often a document of it was used at most."""
    sizes = cut_lineage(sized(docs, path))
    plan = curriculum(sizes, targets, tilt)
    by = cut_lineage(laid_out(sizes, plan).groupBy("source").agg(F.sum("n_tokens").alias("got"), F.max("copy").alias("last")))
    whole = by.agg(F.sum("got").alias("all")).scalar()
    return (
        plan.join(by, "source", "left").withColumn("all", whole)
        .select(
            "source", "target",
            F.when(F.col("all") > 0, F.coalesce("got", F.lit(0)) / F.col("all")).alias("share"),
            F.when(F.col("demand") > 0, F.coalesce("got", F.lit(0)) / F.col("demand")).alias("share_of_demand"),
            F.coalesce(F.col("last") + 1, F.lit(0)).alias("most_copies"),
        )
    )

"""Problem 1: splits that keep related records together.

Records are joined, directly or through others, when they name the same source.
Components of source names come from hash-to-min label exchange, kept as rows
``(node, member)`` so that no cluster is ever held in one task's memory; the
components are then spread over the splits by weighted rendezvous hashing, with
weights calibrated to the shares wanted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Full-width forms written out for ``translate``: digits, letters and the hyphen.
_WIDE = "".join(chr(c + 0xFEE0) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2D))
_NARROW = "".join(chr(c) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2D))


def source_name(value: Column) -> Column:
    """One writing for a source name: width and letter case folded, separators (spaces, dashes,
    underscores, invisible characters) made one hyphen, leading zeros dropped; blank is null."""
    c = F.lower(F.translate(value, _WIDE, _NARROW))
    c = F.regexp_replace(c, r"[​-‏⁠﻿­]", "")
    c = F.regexp_replace(c, r"[\s\p{Z}_\p{Pd}\p{Cc}]+", "-")
    c = F.regexp_replace(c, r"^-+|-+$", "")
    c = F.regexp_replace(c, r"(?<![0-9])0+(?=[0-9])", "")
    return F.when(c != "", c)


def named_sources(records: DataFrame) -> DataFrame:
    """``records`` with ``own`` and ``raw``, the canonical names of the record's source and of the
    raw source it was derived from. A null ``source_id`` is read from ``id`` (text before the first
    colon); a record without any name forms a group of its own."""
    own = F.coalesce(
        source_name(F.col("source_id")),
        source_name(F.substring_index(F.col("id"), ":", 1)),
    )
    raw = source_name(F.col("metadata.raw_source_id"))
    return records.withColumns({"own": F.coalesce(own, raw, F.concat(F.lit("\0rec:"), F.col("rec_id").cast("string"))), "raw": raw})


def numbered(names: DataFrame, most: int = 8) -> tuple[DataFrame, int]:
    """``name, node`` for the distinct ``names(name)``, and the salt of the hash that numbers them. Should two
    names share a number, the next salt is taken, so numbers stand for names exactly."""
    one = cut_lineage(names.where("name is not null").distinct())
    for salt in range(most):
        table = one.withColumn("node", F.xxhash64(F.lit(salt), "name"))
        if table.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return table, salt
    raise RuntimeError(f"names share numbers under {most} salts")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Hash-to-min: in each round every node sends its members to its minimum and the minimum to its
    members, until nothing changes. Nodes are 64-bit numbers; state is one row per (node, member), minima
    are partial hash aggregates and the joins are by node with AQE skew handling, so a component that holds
    a third of all nodes stays spread. Empty input gives an empty result; nulls in either column are ignored.
    Raises after ``max_rounds`` without a fixed point (rounds grow with the log of the diameter).
    """
    e = cut_lineage(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).dropna().distinct())
    names, salt = numbered(e.select(F.explode(F.array("a", "b")).alias("name")))
    both = lambda x, y: F.explode(F.array(F.struct(F.col(x).alias("node"), F.col(y).alias("member")), F.struct(F.col(y).alias("node"), F.col(x).alias("member"))))
    linked = e.where("a <> b").select(F.xxhash64(F.lit(salt), "a").alias("a"), F.xxhash64(F.lit(salt), "b").alias("b"))
    own = linked.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("member"))
    state = cut_lineage(linked.select(both("a", "b").alias("x")).select("x.*").unionByName(own).distinct())
    mark = _fingerprint(state)
    if mark[0]:
        for _ in range(max_rounds):
            low = state.groupBy("node").agg(F.min("member").alias("low"))
            state = cut_lineage(state.join(low, "node").select(both("low", "member").alias("x")).select("x.*").distinct())
            before, mark = mark, _fingerprint(state)
            if mark == before:
                break
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    labels = state.groupBy("node").agg(F.min("member").alias("label"))
    labelled = cut_lineage(names.join(labels, "node", "left").select(F.col("name").alias("node"), F.coalesce("label", "node").alias("label")))
    first = labelled.groupBy("label").agg(F.min("node").alias("component"))
    return labelled.join(first, "label").select("node", "component")


def _fingerprint(state: DataFrame) -> tuple:
    """Row count and order-free hash sum: two numbers, whatever the size."""
    row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def source_groups(records: DataFrame) -> DataFrame:
    """``rec_id, component, split``: each row's group, the records joined through source names, and its present
    split, cleaned. The one table that :func:`straddling` and :func:`assign_splits` work on, made once; rows
    without a ``rec_id`` are no records."""
    records = records.where("rec_id is not null")
    split = clean_label(F.col("data_split")) if "data_split" in records.columns else F.lit(None).cast("string")
    named = named_sources(records).select("rec_id", "own", "raw", split.alias("split"))
    parts = connected_components(named.select(F.col("own").alias("a"), F.coalesce("raw", "own").alias("b")).where("a <> b").distinct())
    return cut_lineage(named.join(parts, named.own == parts.node, "left").select("rec_id", F.coalesce("component", "own").alias("component"), "split"))


def clean_label(value: Column) -> Column:
    """Trimmed lower case; blank is null."""
    c = F.lower(F.regexp_replace(value, r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", ""))
    return F.when(c != "", c)


def straddling(records: DataFrame) -> DataFrame:
    """``rec_id`` of every record with a split whose group holds at least two different splits.

    Null or blank splits neither count nor appear. The group's splits are two partial aggregates
    (min and max), so a hot group is never gathered."""
    g = source_groups(records).where("split is not null")
    mixed = g.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component")
    return g.join(mixed, "component", "left_semi").select("rec_id").distinct()


def rendezvous(key: Column, weights: Mapping[str, float], salt: str = "split") -> Column:
    """Name with the largest ``-w / ln(u)``, ``u`` a hash of (salt, key, name) in (0, 1): shares follow
    the weights, and changing one weight moves only the keys it must. Zero weights never win."""
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    scored = []
    for name, weight in sorted(weights.items()):
        if weight > 0:
            u = (F.xxhash64(F.lit(salt), key, F.lit(name)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
            scored.append(F.struct((F.lit(float(weight)) / -F.ln(u)).alias("s"), F.lit(name).alias("n")))
    return F.array_max(F.array(*scored))["n"]


def calibrated(sizes: DataFrame, weights: Mapping[str, float], salt: str = "split", rounds: int = 24, close: float = 0.001) -> dict[str, float]:
    """Rendezvous weights under which the components of ``sizes(component, n)`` fill the splits in proportion
    to ``weights``. Each round places all components, compares the shares filled with those wanted and scales
    the weights; the best weights seen stand. One row per split comes back a round."""
    names = sorted(k for k, w in weights.items() if w > 0)
    whole = float(sum(weights[k] for k in names))
    want = {k: weights[k] / whole for k in names}
    now, best, least, pace = dict(want), dict(want), float("inf"), 1.0
    for _ in range(rounds):
        got = {r.s: r.n for r in sizes.groupBy(rendezvous(F.col("component"), now, salt).alias("s")).agg(F.sum("n").alias("n")).collect()}
        total = float(sum(got.values()))
        if not total:
            break
        off = max(abs(got.get(k, 0) / total - want[k]) for k in names)
        best, least, pace = (dict(now), off, pace) if off < least else (best, least, pace * 0.7)
        if least <= close:
            break
        now = {k: now[k] * min(4.0, max(0.25, want[k] / max(got.get(k, 0) / total, want[k] / 8))) ** pace for k in names}
        scale = sum(now.values())
        now = {k: w / scale for k, w in now.items()}
    return best


def assign_splits(records: DataFrame, weights: Mapping[str, float], salt: str = "split") -> DataFrame:
    """``rec_id, component, assigned_split``: all records of a component get the same split.

    Every component, whatever its size, goes where weighted rendezvous hashing sends it; the weights are
    calibrated so that the shares hold over all rows although one source may have a third of them (then they
    hold as nearly as whole components allow). Ties are broken by name. An empty table gives an empty result."""
    rendezvous(F.lit(""), weights, salt)  # refuses unusable weights
    g = source_groups(records)
    sizes = cut_lineage(g.groupBy("component").agg(F.count("*").alias("n")))
    return g.select("rec_id", "component", rendezvous(F.col("component"), calibrated(sizes, weights, salt), salt).alias("assigned_split"))


def split_shares(assigned: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``assigned_split, n_rows, share, target`` for every split, also an empty one."""
    spark = assigned.sparkSession
    total = float(sum(weights.values()))
    targets = spark.createDataFrame([(k, v / total) for k, v in sorted(weights.items())], "assigned_split string, target double")
    counts = assigned.groupBy("assigned_split").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    whole = F.sum(n).over(Window.partitionBy())  # one row per split
    return targets.join(counts, "assigned_split", "left").select("assigned_split", n.alias("n_rows"), F.when(whole > 0, n / whole).alias("share"), "target")

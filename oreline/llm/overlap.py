"""Problem 6: same or near-same records across splits, by a weighted cosine join.

A record is a unit vector over the words of its question and of its knowledge, half the squared
length each, with damped inverse-document-frequency weights. Vectors are ordered by rarity; only the
terms that an at-least-``least`` pair can first meet in are put into the inverted lists (pruned by
residual norm, by the other side's largest residual and by its largest weights), lists of the two
sides are joined, and the pairs left get exact dot products per field. Identical records are joined
once, as one class, and their pairs are listed at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .charform import Speller
from .splits import clean_label, source_name

#: Term statistics are kept by hash in this many counters: what is broadcast never grows beyond.
COUNTERS = 1 << 18
#: Least cosine of the whole vector, and of the question and the knowledge alone.
LEAST, LEAST_QUESTION, LEAST_KNOWLEDGE = 0.78, 0.6, 0.7
#: Question terms in a smaller part of the classes than this are marked in the lists.
RARER = 0.05
#: Entries of a list above which it is split.
LONGEST = 50_000
_SLACK = 1e-4
#: Low bits of a packed term, and the steps of one in them (the logarithm of any number of classes fits).
_LOW, _STEPS = (1 << 12) - 1, 64
TRAIN, HELD_OUT = ("train_sft_raw",), ("validation", "test")

_TOKEN = re.compile(r"[^\W_]+")


@F.pandas_udf(T.StringType())
def _words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower-case words of the consistent character form, joined by blanks."""
    speller = Speller()
    for texts in batches:
        yield texts.map(lambda t: " ".join(_TOKEN.findall(speller.canonical(t).lower())), na_action="ignore")


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of records with the same words: ``class_id, held_out, q, k`` (one row each) and
    ``class_id, rec_id`` (membership). The class id is its smallest ``rec_id``. Records without question
    or knowledge, or outside both splits, are in none; a class with members on both sides has a row
    for each side."""
    split = clean_label(F.col("data_split"))
    sided = records.select("rec_id", "question", "knowledge", F.when(split.isin(*HELD_OUT), True).when(split.isin(*TRAIN), False).alias("held_out")).where("rec_id is not null and held_out is not null and question is not null and knowledge is not null")
    worded = sided.select("rec_id", "held_out", _words("question").alias("q"), _words("knowledge").alias("k")).where("q <> '' and k <> ''")
    keyed = cut_lineage(worded.withColumns({"h1": F.xxhash64("q", "k"), "h2": F.xxhash64("k", F.lit(1), "q")}))
    groups = keyed.groupBy("h1", "h2", "held_out").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("n"))
    one = keyed.join(groups.select("class_id", "held_out"), (keyed.rec_id == groups.class_id) & (keyed.held_out == groups.held_out), "left_semi").select(F.col("rec_id").alias("class_id"), "held_out", "q", "k")
    single = groups.where("n = 1").select("class_id", "held_out", F.col("class_id").alias("rec_id"))
    several = keyed.join(groups.where("n > 1").drop("n"), ["h1", "h2", "held_out"]).select("class_id", "held_out", "rec_id")
    return one, single.unionByName(several)


def term_counts(one: DataFrame) -> np.ndarray:
    """Number of classes per term counter; at most :data:`COUNTERS` rows reach the driver."""
    terms = one.select(F.explode(F.concat(F.transform(F.array_distinct(F.split("q", " ")), lambda w: F.concat(F.lit("q:"), w)), F.array_distinct(F.split("k", " ")))).alias("t"))
    rows = terms.groupBy(F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(COUNTERS)).cast("int").alias("c")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[rows["c"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _term(word: str) -> int:
    """64-bit id of a term whose low bits are its counter."""
    raw = word.encode()
    return (xxhash.xxh64_intdigest(raw) >> 19 << 18) | crc32(raw) % COUNTERS


def _idf(counts: np.ndarray) -> np.ndarray:
    """Damped inverse document frequency by counter, against the most frequent one."""
    return np.sqrt(np.log1p(max(1, int(counts.max())) / np.maximum(counts, 1)))


_VECTOR = "class_id bigint, held_out boolean, tq array<bigint>, wq array<float>, tk array<bigint>, wk array<float>"


def vectors(one: DataFrame, counts: np.ndarray) -> DataFrame:
    """``class_id, held_out, tq, wq, tk, wk``: term ids and weights of question and knowledge, each field
    of squared length a half."""
    shared = one.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = _idf(shared.value)
        cache: dict[str, int] = {}

        def field(head: str, text: str) -> tuple[np.ndarray, np.ndarray]:
            bag = Counter(text.split(" "))
            ids = []
            for w in bag:
                t = cache.get(head + w)
                if t is None:
                    if len(cache) > 500_000:
                        cache.clear()
                    t = cache[head + w] = _term(head + w)
                ids.append(t)
            ids = np.array(ids, dtype=np.int64)
            w = (1 + np.log(np.fromiter(bag.values(), dtype=np.float64, count=len(bag)))) * idf[ids & (COUNTERS - 1)]
            return ids, (w / (sqrt(2.0) * (np.linalg.norm(w) or 1.0))).astype(np.float32)

        for pdf in batches:
            out = [(c, h, *field("q:", q), *field("", k)) for c, h, q, k in zip(pdf["class_id"], pdf["held_out"], pdf["q"], pdf["k"])]
            yield pd.DataFrame(out, columns=["class_id", "held_out", "tq", "wq", "tk", "wk"])

    return one.select("class_id", "held_out", "q", "k").mapInPandas(run, _VECTOR)


def _ordered(tq: np.ndarray, wq: np.ndarray, tk: np.ndarray, wk: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms by rarity (then by id), their weights, and the norm of each term's suffix."""
    t, w = np.concatenate([tq, tk]), np.concatenate([wq, wk]).astype(np.float64)
    order = np.lexsort((t, counts[t & (COUNTERS - 1)]))
    t, w = t[order], w[order]
    return t, w, np.sqrt(np.cumsum((w * w)[::-1])[::-1])


def bounds(vecs: DataFrame, counts: np.ndarray) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Per side the largest weight and the largest suffix norm of each term counter (0: no term). Each
    task sends one row per counter it saw."""
    shared = vecs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = {side: (np.zeros(COUNTERS), np.zeros(COUNTERS)) for side in (True, False)}
        for pdf in batches:
            for h, tq, wq, tk, wk in zip(pdf["held_out"], pdf["tq"], pdf["wq"], pdf["tk"], pdf["wk"]):
                t, w, s = _ordered(tq, wq, tk, wk, shared.value)
                at = t & (COUNTERS - 1)
                np.maximum.at(most[h][0], at, w)
                np.maximum.at(most[h][1], at, s)
        for side, (w, s) in most.items():
            c = np.nonzero(w)[0]
            yield pd.DataFrame({"held_out": side, "c": c.astype(np.int32), "w": w[c], "s": s[c]})

    rows = vecs.mapInPandas(run, "held_out boolean, c int, w double, s double").groupBy("held_out", "c").agg(F.max("w").alias("w"), F.max("s").alias("s")).toPandas()
    out = {}
    for side in (True, False):
        w, s = np.zeros(COUNTERS), np.zeros(COUNTERS)
        own = rows[rows["held_out"] == side]
        w[own["c"].to_numpy()], s[own["c"].to_numpy()] = own["w"], own["s"]
        out[side] = (w, s)
    return out


def inverted_lists(vecs: DataFrame, counts: np.ndarray, limits: dict[bool, tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """``held_out, term, class_id, suffix, m1, m2, lost, top, common, packed, scale``: the terms in which a pair can
    first meet, with a sketch of the question (as a unit vector) and the question itself, packed.

    ``m1, m2`` have a bit for each of the question's rarer terms, ``lost`` is how many of them share a
    bit, ``top`` their largest weight and ``common`` the norm of the other terms' part: two questions
    can be no more alike than shared bits x largest weights + the product of the common parts. ``packed`` has
    a term's hash and, in the low twelve bits, its squared inverse document frequency rounded up, ``scale`` the
    largest ratio of a weight to that frequency: the sum over shared terms times both scales is no less than the
    cosine (and hardly more), so pairs that fall short need not leave the join."""
    shared = vecs.sparkSession.sparkContext.broadcast((counts, limits))
    frequent = RARER * max(1, int(counts.max()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, lim = shared.value
        idf = _idf(n)
        squares = np.minimum(_LOW, np.ceil(idf**2 * _STEPS)).astype(np.int64)
        for pdf in batches:
            cols: dict[str, list] = {k: [] for k in ("held_out", "term", "class_id", "suffix", "m1", "m2", "lost", "top", "common", "packed", "scale")}
            for c, h, tq, wq, tk, wk in zip(pdf["class_id"], pdf["held_out"], pdf["tq"], pdf["wq"], pdf["tk"], pdf["wk"]):
                t, w, s = _ordered(tq, wq, tk, wk, n)
                at = t & (COUNTERS - 1)
                most, longest = lim[not h][0][at], lim[not h][1][at]
                reach = np.cumsum((w * most)[::-1])[::-1]
                good = np.nonzero((most > 0) & (s * longest >= least - _SLACK) & (reach >= least - _SLACK))[0]
                if len(good):
                    rare = n[tq & (COUNTERS - 1)] <= frequent
                    bit = ((tq[rare] >> 18) & 127).astype(np.uint64)
                    m1 = np.bitwise_or.reduce(np.uint64(1) << bit[bit < 64], initial=np.uint64(0))
                    m2 = np.bitwise_or.reduce(np.uint64(1) << (bit[bit >= 64] - np.uint64(64)), initial=np.uint64(0))
                    unit = sqrt(2.0) * wq.astype(np.float64)
                    one = {"held_out": h, "class_id": c, "m1": m1.astype(np.int64), "m2": m2.astype(np.int64), "lost": int(rare.sum()) - len(set(bit.tolist())), "top": unit[rare].max(initial=0.0), "common": sqrt(float((unit[~rare] ** 2).sum())), "scale": 1.00001 * float((unit / idf[tq & (COUNTERS - 1)]).max())}
                    for k, v in one.items():
                        cols[k].append(np.full(len(good), v))
                    cols["term"].append(t[good])
                    cols["suffix"].append(s[good])
                    packed = np.empty(len(good), dtype=object)
                    packed[:] = [(tq & ~np.int64(_LOW)) | squares[tq & (COUNTERS - 1)]] * len(good)
                    cols["packed"].append(packed)
            if cols["term"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in cols.items()})

    return vecs.mapInPandas(run, "held_out boolean, term bigint, class_id bigint, suffix float, m1 bigint, m2 bigint, lost int, top float, common float, packed array<bigint>, scale float")


def split_lists(one: DataFrame, other: DataFrame, most: int = LONGEST) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides' lists and the columns they join by. A list of ``other`` above ``most`` entries is dealt out in
    parts, and the entries of ``one`` under its term are repeated for each, so no term is one task's."""
    long = cut_lineage(other.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if long.isEmpty():
        return one, other, ["term"]
    parts = F.coalesce("parts", F.lit(1))
    dealt = other.join(long, "term", "left").withColumn("part", F.pmod(F.xxhash64("class_id"), parts).cast("int")).drop("parts")
    repeated = one.join(long, "term", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return repeated, dealt, ["term", "part"]


@F.pandas_udf(T.DoubleType())
def _dot(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.Series:
    """Cosine of one field: twice the dot product, as each field has squared length a half. All pairs
    of a batch are matched in one sort by (pair, term)."""
    n = len(ta)
    if not n:
        return pd.Series([], dtype="float64")
    rows = [np.repeat(np.arange(n), np.fromiter(map(len, t), dtype=np.int64, count=n)) for t in (ta, tb)]
    row, term = np.concatenate(rows), np.concatenate([*ta, *tb])
    weight = np.concatenate([*wa, *wb]).astype(np.float64)
    order = np.lexsort((term, row))
    row, term, weight = row[order], term[order], weight[order]
    same = np.nonzero((row[1:] == row[:-1]) & (term[1:] == term[:-1]))[0]
    return pd.Series(2.0 * np.bincount(row[same], weight[same] * weight[same + 1], minlength=n))


def class_pairs(one: DataFrame, least: float = LEAST, least_question: float = LEAST_QUESTION, least_knowledge: float = LEAST_KNOWLEDGE) -> DataFrame:
    """``a, b, question, knowledge``: held-out and training classes whose exact cosines reach the
    thresholds (the whole vector's is the mean of the two). Questions are compared first, so that few
    pairs carry their knowledge."""
    counts = term_counts(one)
    vecs = cut_lineage(vectors(one, counts))
    limits = bounds(vecs, counts)
    of = lambda held: inverted_lists(vecs.where(F.col("held_out") == held), counts, limits, least)
    side = lambda df, x: df.select(*[c for c in ("term", "part") if c in df.columns], F.col("class_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("suffix", "m1", "m2", "lost", "top", "common", "packed", "scale")])
    held, train, keys = split_lists(of(True), cut_lineage(of(False)))
    shared = F.bit_count(F.col("m1_a").bitwiseAND(F.col("m1_b"))) + F.bit_count(F.col("m2_a").bitwiseAND(F.col("m2_b"))) + F.least("lost_a", "lost_b")
    alike = shared * F.col("top_a") * F.col("top_b") + F.col("common_a") * F.col("common_b") >= least_question - _SLACK
    question = F.aggregate(F.array_intersect("packed_a", "packed_b"), F.lit(0).cast("bigint"), lambda total, x: total + x.bitwiseAND(_LOW)) * F.col("scale_a") * F.col("scale_b")
    near = side(held, "a").join(side(train, "b"), keys).where((F.col("suffix_a") * F.col("suffix_b") >= least - _SLACK) & alike)
    met = near.where(question >= (least_question - _SLACK) * _STEPS).select("a", "b").distinct()
    part = lambda h, x, f: vecs.where(F.col("held_out") == h).select(F.col("class_id").alias(x), F.col(f"t{f}").alias(f"t{x}"), F.col(f"w{f}").alias(f"w{x}"))

    def scored(pairs: DataFrame, f: str, name: str) -> DataFrame:
        both = pairs.join(part(True, "a", f), "a").join(part(False, "b", f), "b")
        return both.withColumn(name, _dot("ta", "wa", "tb", "wb")).drop("ta", "wa", "tb", "wb")

    asked = cut_lineage(scored(met, "q", "question").where(F.col("question") >= least_question))
    known = scored(asked, "k", "knowledge")
    return known.where((F.col("knowledge") >= least_knowledge) & ((F.col("question") + F.col("knowledge")) / 2 >= least))


def overlapping(records: DataFrame, least: float = LEAST) -> DataFrame:
    """``rec_id_a, rec_id_b, question, knowledge``: every pair of a held-out and a training record whose
    question and knowledge are the same or nearly so; the smaller ``rec_id`` first.

    Records delivered again make pairs of their own. Null or blank splits, questions and knowledge make
    none, nor do rows without an id. An empty table gives an empty result; other columns are not read."""
    one, members = classes(records)
    pairs = class_pairs(one, least)
    ma = members.where("held_out").select(F.col("class_id").alias("a"), F.col("rec_id").alias("ra"))
    mb = members.where("not held_out").select(F.col("class_id").alias("b"), F.col("rec_id").alias("rb"))
    return pairs.join(ma, "a").join(mb, "b").select(F.least("ra", "rb").alias("rec_id_a"), F.greatest("ra", "rb").alias("rec_id_b"), "question", "knowledge").distinct()


def overlaps_by_source(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """``data_split, source, n_records, n_overlapping``: per held-out split and source how many records
    there are and how many are found again in training."""
    named = records.select("rec_id", clean_label(F.col("data_split")).alias("data_split"), F.coalesce(source_name(F.col("source_id")), source_name(F.substring_index("id", ":", 1))).alias("source")).where(F.col("data_split").isin(*HELD_OUT))
    hit = pairs.select(F.explode(F.array("rec_id_a", "rec_id_b")).alias("rec_id")).distinct().withColumn("hit", F.lit(1))
    return named.join(hit, "rec_id", "left").groupBy("data_split", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))

"""Problem 3: text cut off by field limits.

Near-copies are found by the rarest 5-grams of words, without a miss, and aligned; the copy whose alignment ends
early, in the middle of a sentence of the other, is cut. Unmatched texts are judged by the terminality of their
closing words (:mod:`.endings`), raw JSON by whether its outermost object closes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .endings import bare, cut_off

#: Words of a shingle, least part of a copy's shingles that its other has.
SHINGLE, LEAST = 5, 0.8
#: Longest members of a band compared in the first round, and growth of that number from round to round.
BANDS, STEP = 64, 8
#: Letters of a text's last word that stand for it in the name of a band.
STEM = 32
#: Most words of a copy's end that may differ from the other's before it is a text of its own.
LOOSE = 6


def json_cut(text: Column) -> Column:
    """Whether raw JSON output lacks its end: null for text without an object.

    The span from the first brace must parse, or at least close all the braces it opens outside
    strings; what follows it may only be white space or a code fence."""
    t = F.regexp_replace(bare(text), r"[\s`]+$", "")
    span = F.regexp_extract(t, r"(?s)(\{.*)$", 1)
    plain = F.regexp_replace(span, r'"(?:\\.|[^"\\])*+(?:"|$)', "")
    closed = span.endswith("}") & (F.length(F.regexp_replace(plain, r"[^{]", "")) == F.length(F.regexp_replace(plain, r"[^}]", "")))
    return F.when(span == "", None).otherwise(~(closed | F.try_parse_json(span).isNotNull()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _grams(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The hash of every 5-gram in order; none for texts under six words."""
    n = len(words) - SHINGLE + 1
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    codes = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        grams = _mixed(grams + codes[k : k + n])
    return grams.astype(np.int64)


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower()) if text else []


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text's 5-grams in order. As its last word may be half a word, a copy is asked for without the last."""
    known: dict[str, int] = {}
    for texts in batches:
        if len(known) > 500_000:
            known.clear()
        yield texts.map(lambda t: _grams(_words(t), known))


def _named(gram: int, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{gram} {word[:STEM]}") - (1 << 63)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _tails(texts: pd.Series) -> pd.Series:
    """``[gram, band]`` of the 5-grams a copy that ends early must share one of, in bands by gram and last word."""

    def of(text: str) -> list[list[int]]:
        words = _words(text)
        return [[int(g), _named(int(g), words[-1])] for g in set(_grams(words, {})[:-1][-LOOSE:])]

    return texts.map(of)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _heads(texts: pd.Series, asked: pd.Series) -> pd.Series:
    """The bands by gram and last word of all texts that may end early beside this one, for the grams ``asked``:
    every word near which such a text may end, whole where the text goes on behind it, and its beginnings."""

    def of(text: str, asked: np.ndarray) -> list[int]:
        words = _words(text)
        at = {int(g): k for k, g in enumerate(_grams(words, {}))}
        out = set()
        for g in map(int, asked):
            for k in range(at[g] + SHINGLE - 2, min(len(words), at[g] + SHINGLE + LOOSE + 2)):
                w = words[k]
                out.update(_named(g, w[:n]) for n in range(1, min(len(w), STEM) + 1) if n < len(w) or n == STEM or k + 1 < len(words))
        return list(out)

    return pd.Series([of(t, g) for t, g in zip(texts, asked)], dtype=object)


def _ends_early(short: str, long: str) -> bool | None:
    """Whether ``short``, whose 5-grams ``long`` has (0.8 of them), stops in mid-sentence or before the full
    stop while ``long`` goes on; null if it is no near-copy."""
    a, b = [list(re.finditer(r"[^\W_]+", t.lower())) for t in (short, long)]
    wa, wb = [m[0] for m in a], [m[0] for m in b]
    ga = [tuple(wa[k : k + SHINGLE]) for k in range(len(wa) - SHINGLE)]
    at = {tuple(wb[k : k + SHINGLE]): k for k in range(len(wb) - SHINGLE + 1)}
    kinds = set(ga)
    if not ga or len(wa) > len(wb) or sum(g in at for g in kinds) < LEAST * len(kinds):
        return None
    last = max(k for k, g in enumerate(ga) if g in at)
    rest = len(wa) - last - SHINGLE  # words after the last shared 5-gram
    if rest > LOOSE:
        return False
    near = at[ga[last]] + SHINGLE + rest - 1  # where the last word would stand, give or take an edit
    for k in sorted(range(max(0, near - 2), min(len(wb), near + 3)), key=lambda k: abs(k - near)):
        if wb[k].startswith(wa[-1]):
            if wb[k] != wa[-1]:
                return True
            return k + 1 < len(wb) and not re.match(r"[^\w\n.!?…。]*\n", long[b[k].end() :]) and not re.search(r"[.!?。][)\]\"'”’»]*\s*$", short)
    return False


@F.pandas_udf(T.BooleanType())
def _early(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([_ends_early(a, b) for a, b in zip(short, long)], dtype=object)


def _candidates(hashed: DataFrame, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``h, key`` of every text that may end early and ``h, other_key, other_size, other_words`` of its partners
    to be tried; together they hold every pair that :func:`_ends_early` can say yes to.

    A near-copy has ``LEAST`` of the text's 5-grams, so of any that are more than the rest one at least: the
    rarest are taken, and a text without enough 5-grams in other texts has no partner. Where even these are
    common, in more than ``BANDS`` texts, one of its last 5-grams together with the last word is looked
    for, which the other must have near by, whole or as a beginning."""
    each = hashed.select("key", "asks", F.posexplode(F.array_distinct(F.concat("own", "g"))).alias("at", "g"), (F.col("at") < F.size("own")).alias("mine"))
    counts = each.groupBy("g").agg(F.count("*").alias("n"), F.bool_or(F.col("asks") & F.col("mine")).alias("asked")).where("asked and n > 1").select("g", "n")
    shared = each.where("asks and mine").join(counts, "g").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("s"))
    spare = F.size("s") - F.ceil(F.lit(LEAST) * F.size("own")).cast("int") + 1
    picked = cut_lineage(shared.join(hashed.select("key", "own"), "key").where(spare > 0).select("key", F.slice("s", F.lit(1), spare).alias("s")))
    common = F.element_at("s", -1)["n"] > BANDS
    asks = picked.where(~common).select(F.explode("s.g").alias("h"), "key")
    has = each.join(asks.select(F.col("h").alias("g")).distinct(), "g", "left_semi").select(F.col("g").alias("h"), F.col("key").alias("other_key"))
    hot = picked.where(common).select("key")
    if not hot.isEmpty():
        tails = cut_lineage(hot.join(one, "key").select("key", F.explode(_tails("text")).alias("t")).select("key", F.col("t")[0].alias("g"), F.col("t")[1].alias("h")))
        asks = asks.unionByName(tails.select("h", "key"))
        holders = each.join(tails.select("g").distinct(), "g", "left_semi").groupBy("key").agg(F.collect_list("g").alias("asked"))
        heads = holders.join(one, "key").select(F.explode(_heads("text", "asked")).alias("h"), F.col("key").alias("other_key"))
        has = has.unionByName(heads.join(tails.select("h").distinct(), "h", "left_semi"))
    return asks, has


def early_copies(texts: DataFrame) -> DataFrame:
    """``text, partner`` of every distinct text that ends early beside a near-copy, and the longest of these.

    A text that ends with a full stop can't, so only the others look for partners, among the texts of no fewer
    words (:func:`_candidates`). The longest members of each band are tried first, then ``STEP`` times
    as many, round by round, until none is left that is longer than the partner found. Keys travel through the
    bands, texts only to the pairs left. Null, short and identical texts match nothing."""
    one = cut_lineage(texts.where("text is not null").select("text").distinct().select("text", F.xxhash64("text").alias("key")))
    ends = bare(F.col("text")).rlike(r"[.!?。！？؟][)\]\"'”’»›]*$")
    read = one.select("key", F.length("text").alias("size"), ends.alias("ends"), _bands("text").alias("g")).where(F.size("g") > 1)
    own = F.array_distinct(F.slice("g", F.lit(1), F.size("g") - 1))
    hashed = cut_lineage(read.select("key", "size", F.size("g").alias("words"), (~F.col("ends")).alias("asks"), own.alias("own"), "g"))
    asks, has = _candidates(hashed, one)
    size = hashed.select(F.col("key").alias("other_key"), F.col("size").alias("other_size"), F.col("words").alias("other_words"))
    place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("other_size"), F.desc("other_key")))
    long = cut_lineage(has.join(size, "other_key").withColumn("place", place))
    left = cut_lineage(asks.join(hashed.select("key", "words"), "key").withColumn("best", F.struct(F.lit(0).alias("other_size"), F.lit(0).cast("long").alias("other_key"))))
    low, high, out = 0, BANDS, None
    other = F.struct("other_size", "other_key")
    while not left.isEmpty():
        near = left.join(long.where((F.col("place") > low) & (F.col("place") <= high)), "h").where((F.col("other_key") != F.col("key")) & (F.col("other_words") >= F.col("words")) & (other > F.col("best"))).select("key", "other_key", "other_size").distinct()
        if out is not None:
            near = near.join(out.select("key", "other_key"), ["key", "other_key"], "left_anti")
        pairs = near.join(one.select("key", "text"), "key").join(one.select(F.col("key").alias("other_key"), F.col("text").alias("other")), "other_key")
        pairs = cut_lineage(pairs.select("key", "other_key", "other_size", _early("text", "other").alias("early")))
        out = pairs if out is None else out.unionByName(pairs)
        more = long.where(F.col("place") == high + 1).select("h", other.alias("next"))
        found = pairs.where("early").groupBy("key").agg(F.max(other).alias("now"))
        left = left.join(more, "h").join(found, "key", "left").withColumn("best", F.coalesce("now", "best")).where(F.col("next") > F.col("best"))
        left = cut_lineage(left.select("h", "key", "words", "best"))
        low, high = high, high * STEP
    if out is None:
        return one.select("text", F.col("text").alias("partner")).limit(0)
    best = out.where("early").groupBy("key").agg(F.max(other).alias("p")).select("key", F.col("p.other_key").alias("other_key"))
    return best.join(one.select("key", "text"), "key").join(one.select(F.col("key").alias("other_key"), F.col("text").alias("partner")), "other_key").select("text", "partner")


def generations(api: DataFrame, local: DataFrame) -> DataFrame:
    """``gen_id, rec_id, model_tag, raw, text`` of the calls that returned a text; ``raw``: JSON output."""
    a = api.where("ok and text is not null").select("gen_id", "rec_id", "model_tag", F.coalesce(F.col("prompt_style") == "structured", F.lit(False)).alias("raw"), "text")
    b = local.where("text is not null").select("gen_id", "rec_id", "model_tag", F.lit(False).alias("raw"), "text")
    return a.unionByName(b)


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")


def judged(api: DataFrame, local: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``gen_id, model_tag, cut, by`` for every delivered row of a generation with a text; ``by``: what shows
    the cut, ``json``, ``alignment`` or ``ending``.

    Structured output is cut if its JSON doesn't close. Other texts are cut if a near-copy shows that
    they end early, or else by their ending. A text that is only the record's question without its
    mark (``questions``: ``rec_id, question``) ends where the question does and isn't cut."""
    rows = generations(api, local)
    is_json = F.col("raw") & F.contains("text", F.lit("{"))
    raw = rows.where(is_json).select("gen_id", "model_tag", F.coalesce(json_cut(F.col("text")), F.lit(False)).alias("cut")).withColumn("by", F.when(F.col("cut"), "json"))
    flat = rows.where(~is_json).select("gen_id", "rec_id", "model_tag", "text")
    ended = cut_lineage(cut_off(flat, "text", "model_tag").drop("ending"))
    early = early_copies(ended).select("text", F.lit(True).alias("early"))
    seen = ended.join(early, "text", "left").withColumn("by", F.when(F.col("early"), "alignment").when(F.col("cut"), "ending")).withColumn("cut", F.col("by").isNotNull())
    if questions is not None:
        asked = seen.where("cut").join(questions.select("rec_id", "question"), "rec_id", "left")
        same = F.coalesce(F.trim(_letters(bare(F.col("text")))) == F.trim(_letters(bare(F.col("question")))), F.lit(False))
        seen = asked.select("gen_id", "model_tag", (~same).alias("cut"), F.when(~same, F.col("by")).alias("by")).unionByName(seen.where("not cut").select("gen_id", "model_tag", "cut", "by"))
    return raw.unionByName(seen.select("gen_id", "model_tag", "cut", "by"))


def cut_generations(api: DataFrame, local: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``gen_id`` of every generation whose text was cut off before its end. Failed calls, null and
    blank texts and short complete answers are none; repeated deliveries count once."""
    return judged(api, local, questions).where("cut").select("gen_id").distinct()


def cut_rates(api: DataFrame, local: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``model_tag, n_texts, n_cut, n_by_alignment, share`` over distinct generations with a text."""
    each = judged(api, local, questions).groupBy("gen_id").agg(F.max("model_tag").alias("model_tag"), F.bool_or("cut").alias("cut"), F.bool_or(F.col("by").eqNullSafe("alignment")).alias("aligned"))
    return each.groupBy("model_tag").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if("aligned").alias("n_by_alignment")).withColumn("share", F.col("n_cut") / F.col("n_texts"))

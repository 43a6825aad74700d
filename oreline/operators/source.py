"""Source construction: salted-hash splits, answerable examples with sentence windows, derived
negatives, expansion. Everything is row-local array work without a shuffle."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConstructSettings, NegativeSettings, SplitSettings
from ..functions.coerce import first_non_empty, once, opt_str
from ..functions.text import stable_ratio
from ..schemas import DOCUMENTS, SUPPORTS


def source_key(df: DataFrame) -> Column:
    """First truthy of ``_id``, ``id`` and ``_source_index`` (0 isn't truthy)."""
    cs = [opt_str(F.col(c), zero=c == "_source_index") for c in ("_id", "id", "_source_index") if c in df.columns]
    return first_non_empty(*cs) if cs else F.lit("")


def data_split(key: Column, source_split: Column, cfg: SplitSettings = SplitSettings()) -> Column:
    """``train_sft_raw`` for training sources, else validation or test by the key's salted hash."""
    total = cfg.validation + cfg.test
    if total <= 0:
        raise ValueError("validation and test shares must sum to a positive number")
    s = F.lower(opt_str(source_split))
    return (
        F.when(s == "train", "train_sft_raw")
        .when(s == "validation", F.when(stable_ratio(key, cfg.data_salt) < cfg.validation / total, "validation").otherwise("test"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown source split: "), s)).cast("string"))
    )


def answerability_split(key: Column, cfg: SplitSettings = SplitSettings()) -> Column:
    total = cfg.answerable + cfg.unanswerable + cfg.both
    if total <= 0:
        raise ValueError("answerability shares must sum to a positive number")
    v = stable_ratio(key, cfg.answerability_salt)
    low = cfg.answerable / total
    return F.when(v < low, "answerable").when(v < low + cfg.unanswerable / total, "unanswerable").otherwise("both")


def tagged(rows: DataFrame, cfg: SplitSettings = SplitSettings()) -> DataFrame:
    """Rows with ``hotpot_source_split`` in lower case, ``data_split`` and ``answerability_split``.
    A row without a key or with another source split fails the job."""
    key = source_key(rows)
    checked = F.when(key != "", key).otherwise(F.raise_error(F.lit("row without a source key")).cast("string"))
    split = F.lower(opt_str(F.col("hotpot_source_split")))
    return rows.withColumns({"hotpot_source_split": split, "data_split": data_split(checked, split, cfg), "answerability_split": answerability_split(checked, cfg)})


def context_documents(context: Column) -> Column:
    """Documents of parallel arrays ``title`` and ``sentences`` (the shorter wins), stripped, with
    empty sentences removed before they are numbered."""
    titles = F.coalesce(context["title"], F.array().cast("array<string>"))
    texts = F.coalesce(context["sentences"], F.array().cast("array<array<string>>"))
    n = F.least(F.size(titles), F.size(texts))
    docs = F.arrays_zip(F.slice(titles, 1, n).alias("title"), F.slice(texts, 1, n).alias("sentences"))
    empty = F.array().cast("array<string>")
    return F.transform(docs, lambda d: F.struct(opt_str(d["title"]).alias("title"), F.filter(F.transform(F.coalesce(d["sentences"], empty), lambda x: opt_str(x)), lambda s: s != "").alias("sentences")))


def window(sentences: Column, center: Column, size: int) -> Column:
    """The sentence at ``center`` (from 0) with ``size`` neighbours on each side."""
    left = F.greatest(F.lit(0), center - size)
    return F.filter(F.slice(sentences, left + 1, F.greatest(F.lit(0), F.least(F.size(sentences), center + size + 1) - left)), lambda s: s != "")


def block(title: Column, text: Column, prefix: bool = True) -> Column:
    t = opt_str(text)
    return F.when((title != "") & title.isNotNull(), F.concat(title, F.lit(": "), t)).otherwise(t) if prefix else t


def _doc_of(docs: Column, title: Column) -> Column:
    """The last document of that title, null if there is none."""
    same = F.filter(docs, lambda d: (d["title"] == title) & (d["title"] != ""))
    return F.try_element_at(same, F.lit(-1))


def answerable(rows: DataFrame, cfg: ConstructSettings = ConstructSettings()) -> DataFrame:
    """Rows that make an answerable example, with ``source_id, difficulty, question_type, docs,
    supports, knowledge`` beside their own columns. A row is dropped if a required field is empty, it
    has too many supports or one of them isn't found."""
    empty_t, empty_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    facts = F.col("supporting_facts")
    titles, ids = F.coalesce(facts["title"], empty_t), F.coalesce(facts["sent_id"].cast("array<int>"), empty_i)
    n = F.least(F.size(titles), F.size(ids))
    pairs = F.array_distinct(F.transform(F.arrays_zip(F.slice(titles, 1, n).alias("title"), F.slice(ids, 1, n).alias("sent_id")), lambda p: F.struct(opt_str(p["title"]).alias("title"), p["sent_id"].alias("sent_id"))))
    df = once(
        rows, source_id=source_key(rows), question=opt_str(F.col("question")), reference_answer=opt_str(F.col("answer")),
        difficulty=first_non_empty(F.col("level"), F.lit("unknown")), question_type=opt_str(F.col("type")), docs=context_documents(F.col("context")), pairs=pairs,
    ).where((F.col("question") != "") & (F.col("reference_answer") != "") & (F.col("source_id") != "") & (F.size("pairs") > 0))
    if cfg.drop_over_max:
        df = df.where(F.size("pairs") <= cfg.max_supports)

    def support(p: Column) -> Column:
        sentences = _doc_of(F.col("docs"), p["title"])["sentences"]
        near = window(sentences, p["sent_id"], cfg.window_size)
        return F.struct(
            p["title"].alias("title"), p["sent_id"].alias("sent_id"),
            F.when((p["sent_id"] >= 0) & (p["sent_id"] < F.size(sentences)), F.try_element_at(sentences, p["sent_id"] + 1)).alias("sentence"),
            near.alias("window_sentences"), block(p["title"], F.array_join(near, " "), cfg.title_prefix).alias("window_text"),
        )

    df = once(df, supports=F.transform("pairs", support)).where(F.forall("supports", lambda s: s["sentence"].isNotNull()))
    joined = F.array_join(F.filter(F.array_distinct(F.transform("supports", lambda s: s["window_text"])), lambda b: b != ""), "\n\n")
    return once(df, knowledge=joined).where("knowledge <> ''").drop("pairs")


_SENTENCE = "array<struct<title:string,sent_id:int,sentence:string>>"


def candidates(docs: Column, supports: Column, s: Column, cfg: NegativeSettings) -> Column:
    """Replacement candidates of a support: unused sentences within the radius, else (by setting) any
    of its document, else the first sentences of the documents beside it."""
    doc = _doc_of(docs, s["title"])
    numbered = F.transform(doc["sentences"], lambda x, i: F.struct(s["title"].alias("title"), i.alias("sent_id"), x.alias("sentence")))
    free = F.filter(numbered, lambda c: ~F.exists(supports, lambda u: (u["title"] == c["title"]) & (u["sent_id"] == c["sent_id"])))
    near = F.filter(free, lambda c: F.abs(c["sent_id"] - s["sent_id"]) <= cfg.radius)
    same = F.when(F.size(near) > 0, near).otherwise(free) if cfg.any_sentence_fallback else near
    last = F.size(docs) - F.array_position(F.reverse(F.transform(docs, lambda d: d["title"])), s["title"])  # from 0; the last of equal titles
    beside = F.flatten(F.transform(F.filter(F.array(last - 1, last + 1), lambda k: (k >= 0) & (k < F.size(docs))), lambda k: F.transform(F.slice(F.get(docs, k.cast("int"))["sentences"], 1, max(0, cfg.adjacent_limit)), lambda x, i: F.struct(F.get(docs, k.cast("int"))["title"].alias("title"), i.alias("sent_id"), x.alias("sentence")))))
    adjacent = F.when(doc.isNotNull(), beside) if cfg.adjacent_limit > 0 else F.array().cast(_SENTENCE)
    return F.coalesce(F.when(F.size(same) > 0, same), adjacent, F.array().cast(_SENTENCE))


def hash_draws(seed_text: Column, n: Column, sizes: Column, cfg: NegativeSettings) -> Column:
    """Native draws: the supports with the smallest hashes, and per support a candidate by hash."""
    most = F.least(F.lit(cfg.replace_max), n)
    least = F.greatest(F.lit(1), F.least(F.lit(cfg.replace_min), most))
    draw = lambda tag: F.conv(F.substring(F.sha1(F.concat(seed_text, F.lit(":"), tag)), 1, 8), 16, 10).cast("bigint")
    k = least + F.pmod(draw(F.lit("n")), (most - least + 1).cast("bigint")).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(draw(F.concat(F.lit("s"), i.cast("string"))).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda x: F.struct(x["i"].alias("support"), F.when(F.get(sizes, x["i"]) > 0, F.pmod(draw(F.concat(F.lit("c"), x["i"].cast("string"))), F.get(sizes, x["i"]).cast("bigint")).cast("int")).alias("candidate")))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("support", T.IntegerType()), T.StructField("candidate", T.IntegerType())])))
def _twister_draws(seed_text: pd.Series, sizes: pd.Series, least: pd.Series, most: pd.Series) -> pd.Series:
    out = []
    for text, sizes_, lo, hi in zip(seed_text, sizes, least, most):
        rng = random.Random(text)
        hi = min(int(hi), len(sizes_))
        k = rng.randint(max(1, min(int(lo), hi)), hi)
        row = []
        for i in rng.sample(range(len(sizes_)), k=k):
            row.append({"support": i, "candidate": rng.choice(range(int(sizes_[i]))) if sizes_[i] else None})
            if not sizes_[i]:
                break
        out.append(row)
    return pd.Series(out)


def negatives(examples: DataFrame, cfg: NegativeSettings = NegativeSettings(), parity: bool = False) -> DataFrame:
    """Unanswerable counterparts of answerable examples: some supports replaced by other sentences.

    ``examples`` are rows of :func:`answerable` with ``answerability_split``; an example is dropped if a
    chosen support has no candidate or the knowledge doesn't change. Draws are hashes of the row's own
    identity, so they don't depend on partitioning; ``parity`` draws them from a Mersenne Twister seeded
    with the same text (a Python UDF over a few numbers per row)."""
    track = F.when(F.col("answerability_split") == "both", "paired_answerable").otherwise("external_raw")
    seed = F.concat_ws("::", F.concat(F.lit(f"{cfg.seed}:"), F.col("source_id")), F.lit("answerable"), track, F.coalesce("answerability_split", F.lit("")))
    df = once(examples, options=F.transform("supports", lambda s: candidates(F.col("docs"), F.col("supports"), s, cfg)))
    df = once(df, sizes=F.transform("options", lambda o: F.size(o)), origin_track=track, _seed=seed)
    sizes, seed = F.col("sizes"), F.col("_seed")
    draws = _twister_draws(seed, sizes, F.lit(cfg.replace_min), F.lit(cfg.replace_max)) if parity else hash_draws(seed, F.size("supports"), sizes, cfg)
    df = once(df, draws=draws).where(F.forall("draws", lambda d: d["candidate"].isNotNull()))
    chosen = F.transform("draws", lambda d: F.get(F.get(F.col("options"), d["support"]), d["candidate"]))
    df = once(df, replacement_sentences=chosen, replaced_supports=F.transform("draws", lambda d: F.struct(F.get(F.col("supports"), d["support"])["title"].alias("title"), F.get(F.col("supports"), d["support"])["sent_id"].alias("sent_id"))), chosen=F.transform("draws", lambda d: d["support"]))

    def piece(s: Column, i: Column) -> Column:
        at = F.array_position(F.col("chosen"), i)
        new = F.get(F.col("replacement_sentences"), (at - 1).cast("int"))
        return F.when(at > 0, block(new["title"], new["sentence"], cfg.title_prefix)).otherwise(opt_str(s["window_text"]))

    blocks = F.filter(F.array_distinct(F.transform("supports", piece)), lambda b: b != "")
    df = once(df, changed=F.array_join(blocks, "\n\n")).where((F.col("changed") != "") & (F.col("changed") != F.col("knowledge")))
    return df.withColumn("knowledge", F.col("changed")).drop("options", "sizes", "_seed", "draws", "chosen", "changed")


EXAMPLE = ("id", "source_id", "variant_id", "data_split", "answerability_split", "question", "knowledge", "reference_answer", "answerability_label", "difficulty", "supporting_sentences", "context_documents", "metadata")


def examples(rows: DataFrame, construct: ConstructSettings = ConstructSettings(), negative: NegativeSettings = NegativeSettings(), parity: bool = False) -> DataFrame:
    """Prepared examples of tagged rows: none, one or two each, by ``answerability_split``."""
    base = answerable(rows, construct)
    strategy = F.struct(F.lit(construct.window_size).alias("window_size"), F.lit(construct.title_prefix).alias("include_title_prefix")).alias("knowledge_strategy")
    replaced = "struct<mode:string,replaced_supports:array<struct<title:string,sent_id:int>>,replacement_sentences:array<struct<title:string,sent_id:int,sentence:string>>,same_doc_candidate_radius:int,adjacent_doc_sentence_limit:int>"

    def out(df: DataFrame, variant: Column, label: str, track: Column, change: Column) -> DataFrame:
        meta = F.struct(F.col("question_type"), strategy, change.cast(replaced).alias("negative_strategy"), track.alias("origin_track"), F.col("source_id").alias("raw_source_id"), F.col("hotpot_source_split"))
        return df.select(
            F.concat_ws(":", "source_id", variant).alias("id"), "source_id", variant.alias("variant_id"), "data_split", "answerability_split", "question", "knowledge", "reference_answer",
            F.lit(label).alias("answerability_label"), "difficulty", F.col("supports").alias("supporting_sentences"), F.col("docs").alias("context_documents"), meta.alias("metadata"),
        )

    yes = out(base.where(F.col("answerability_split").isin("answerable", "both")), F.lit("answerable"), "answerable", F.lit("answerable"), F.lit(None))
    derived = negatives(base.where(F.col("answerability_split").isin("unanswerable", "both")), negative, parity)
    change = F.struct(F.lit("support_replace_v1").alias("mode"), F.col("replaced_supports"), F.col("replacement_sentences"), F.lit(negative.radius).alias("same_doc_candidate_radius"), F.lit(negative.adjacent_limit).alias("adjacent_doc_sentence_limit"))
    variant = F.when(F.col("origin_track") == "paired_answerable", "unanswerable-paired-v1").otherwise("unanswerable-external-v1")
    return yes.unionByName(out(derived, variant, "unanswerable", F.col("origin_track"), change))


def split_counts(df: DataFrame, *dims: str) -> DataFrame:
    """``dim, value, n`` for several columns in one pass (grouping sets of single columns)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dims])).alias("p")
    return df.select(pairs).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def restored(rows: DataFrame) -> DataFrame:
    """Examples read back from their written form, coerced to their types: texts stripped (null is empty, but for
    the two splits), positions whole numbers, empty sentences dropped, missing columns empty."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    text = lambda c: opt_str(have(c)).alias(c)
    split = lambda c: F.when(have(c).isNotNull(), opt_str(have(c))).alias(c)
    sentences = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: opt_str(x)), lambda x: x != "")
    number = lambda x: F.coalesce(x.cast("string").try_cast("int"), F.lit(0))
    empty = lambda kind: F.array().cast(kind)
    supports = F.transform(F.col("supporting_sentences"), lambda s: F.struct(opt_str(s["title"]).alias("title"), number(s["sent_id"]).alias("sent_id"), opt_str(s["sentence"]).alias("sentence"), sentences(s["window_sentences"]).alias("window_sentences"), opt_str(s["window_text"]).alias("window_text"))) if "supporting_sentences" in rows.columns else F.lit(None)
    documents = F.transform(F.col("context_documents"), lambda d: F.struct(opt_str(d["title"]).alias("title"), sentences(d["sentences"]).alias("sentences"))) if "context_documents" in rows.columns else F.lit(None)
    return rows.select(
        *[text(c) for c in ("id", "source_id", "variant_id")], split("data_split"), split("answerability_split"), *[text(c) for c in ("question", "knowledge", "reference_answer", "answerability_label", "difficulty")],
        F.coalesce(supports, empty(SUPPORTS)).alias("supporting_sentences"), F.coalesce(documents, empty(DOCUMENTS)).alias("context_documents"), *[c for c in ("metadata",) if c in rows.columns],
    )

"""The loaders of the evaluation: rows in a seeded order, normalised, those that lack what is needed dropped
or tagged, and the first so many of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import NEGATIVE, POSITIVE, first_non_empty, label_to_bool, opt_str, require, safe_int, text_list
from ..operators import calibrate, evaluate
from ..operators.dataset import up_to_nth_kept
from ..operators.order import global_rank, permuted, seeded
from .files import with_position


def shuffled(df: DataFrame, seed: int, exact: bool = False, order: str = "_ord", name: str = "_place") -> DataFrame:
    """``df`` with its place from 0 in a seeded order. ``exact``: that of a Mersenne Twister shuffle of the
    row numbers, for tables the driver can number; else by seeded hashes, for any size."""
    rows = df if order in df.columns else with_position(df, order)
    if exact:
        return permuted(rows, order, seed, name=name)
    ranks = global_rank(rows.select(order), [seeded(F.col(order), seed), F.col(order)], None, name).select(order, (F.col(name) - 1).alias(name))
    return rows.join(ranks, order)


def first_n(df: DataFrame, n: int, place: str = "_place") -> DataFrame:
    """The ``n`` rows with the lowest places (0 or less: all)."""
    if n <= 0:
        return df
    kept = global_rank(df.select(place), [F.col(place)], None, "_at").where(F.col("_at") <= n).select(place)
    return df.join(kept, place, "left_semi")


def source_rows(df: DataFrame, seed: int = 42, most: int = 20_000, exact: bool = False) -> DataFrame:
    """Raw rows in seeded order, the first ``most``, with ``_source_index`` (the row's number in the source,
    where it has none of its own)."""
    placed = first_n(shuffled(df, seed, exact), most)
    own = F.col("_source_index").cast("bigint") if "_source_index" in df.columns else F.lit(None).cast("bigint")
    return placed.withColumn("_source_index", F.coalesce(own, F.col("_ord").cast("bigint"))).drop("_ord", "_place")


def generation_items(df: DataFrame, seed: int = 42, most: int = 0) -> DataFrame:
    """Items to generate for; rows without question or knowledge don't count."""
    return first_n(evaluate.generation_items(shuffled(df, seed), "_place"), most).drop("_place")


def generated_rows(df: DataFrame, seed: int = 42, most: int = 0, source: str = "answer") -> DataFrame:
    """Normalised generated rows; rows without answer, question or knowledge don't count."""
    return first_n(evaluate.generated_rows(shuffled(df, seed), source, "_place"), most).drop("_place")


def loss_rows(df: DataFrame, seed: int = 42, most: int = 0) -> DataFrame:
    """``sample_id, source_id, prompt, completion, skip_reason`` up to the ``most``-th row that has both texts;
    rows that lack one are kept and tagged."""
    placed = shuffled(df, seed)
    have = lambda c: opt_str(F.col(c)) if c in df.columns else F.lit("")
    at = F.col("_place").cast("int")
    sample = F.when(F.coalesce(F.col("sample_id").cast("string").try_cast("int"), F.lit(0)) != 0, F.col("sample_id").cast("int")).otherwise(at) if "sample_id" in df.columns else at
    reason = F.when((have("prompt") == "") | (have("completion") == ""), "missing_prompt_or_completion").otherwise("")
    rows = placed.select("_place", sample.alias("sample_id"), first_non_empty(have("source_id"), have("id"), at.cast("string")).alias("source_id"), have("prompt").alias("prompt"), have("completion").alias("completion"), reason.alias("skip_reason"), F.lit(1).alias("_all"))
    return up_to_nth_kept(rows, ["_all"], F.col("skip_reason") == "", [F.col("_place")], most).drop("_all", "kept", "_place")


def annotation_rows(df: DataFrame, seed: int = 42, most: int = 0) -> DataFrame:
    """Annotated pack rows with a task, their human label as true, false or null."""
    return first_n(calibrate.annotations(shuffled(df, seed), "_place"), most).drop("_place", "_ord")


def labelled_rows(
    df: DataFrame, seed: int = 42, most: int = 0, question: str = "question", answer: str = "answer", knowledge: str = "knowledge", context: str = "contexts", label: str = "label",
    positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE, allow_unlabeled: bool = False, model_tag: str = "model_tag", model_step: str = "model_step", model_path: str = "model_path", sample_id: str = "sample_id", source_id: str = "source_id",
) -> DataFrame:
    """Rows labelled elsewhere, whatever their fields are called: ``model_tag, model_step, model_path, sample_id,
    source_id, question, knowledge, answer, gold_supported, raw_label``. Rows without question, answer or
    knowledge (or, unless allowed, without a label of the vocabulary) don't count."""
    placed = shuffled(df, seed)
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    sample = F.coalesce(get(sample_id).cast("string").try_cast("int"), F.col("_place").cast("int"))
    tag = first_non_empty(get(model_tag), F.lit("model"))
    joined = [F.array_join(text_list(F.col(context)), "\n\n") if df.schema[context].dataType.typeName() == "array" else F.col(context)] if context in df.columns else []
    out = placed.select(
        "_place", tag.alias("model_tag"), safe_int(get(model_step)).alias("model_step"), first_non_empty(get(model_path), tag).alias("model_path"), sample.alias("sample_id"), first_non_empty(get(source_id), sample.cast("string")).alias("source_id"),
        opt_str(get(question)).alias("question"), first_non_empty(get(knowledge), *joined).alias("knowledge"), opt_str(get(answer)).alias("answer"), label_to_bool(get(label), positive, negative).alias("gold_supported"), get(label).cast("string").alias("raw_label"),
    ).where("question <> '' and knowledge <> '' and answer <> ''")
    return first_n(out if allow_unlabeled else out.where("gold_supported is not null"), most).drop("_place")


def training_set(splits: dict[str, DataFrame], needed: Sequence[str] = ("prompt", "completion")) -> dict[str, DataFrame]:
    """The splits of a training set, checked: there must be a ``train`` split, and every split must have the
    ``needed`` columns."""
    if "train" not in splits:
        raise ValueError("no train split")
    for df in splits.values():
        require(df, *needed)
    return splits

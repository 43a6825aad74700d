"""Training sets: records, deduplication, normalisation, token budgets, capped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrepareSettings
from ..functions import scorers as S
from ..functions.coerce import count_true, first_non_empty, opt_str
from ..functions.text import canonical_json, infer_prompt
from ..session import cut_lineage
from .order import global_rank, seeded
from .protocol import decoded, payload

#: The fields that make two rows the same record.
DEDUP_FIELDS = ("id", "source_id", "variant_id", "answerability_label", "prompt", "completion", "question", "knowledge", "reference_answer")
SPLIT_OFFSET = {"train": 11, "validation": 23, "test": 37}


def label_of(df: DataFrame) -> Column:
    nested = [F.col("metadata.answerability_label")] if "metadata" in df.columns and "answerability_label" in getattr(df.schema["metadata"].dataType, "names", []) else []
    own = [F.col("answerability_label")] if "answerability_label" in df.columns else []
    return first_non_empty(*own, *nested) if own or nested else F.lit("")


def records(df: DataFrame) -> DataFrame:
    """Prompt and completion of validated rows. Answerable outputs need a derived confidence; the others go
    by that of their ``parsed_output``, which validation has derived; without one a row is dropped. Rows whose
    payload is missing or invalid are read from their ``canonical_output``."""
    o = F.col("parsed_output")
    df = df.withColumn("parsed_output", decoded(o))
    if "canonical_output" in df.columns:
        df = payload(df, ("canonical_output",))
    confidence = F.when(o["answerability"] == "answerable", F.col("derived_confidence")).otherwise(o["confidence"])
    kept = df.where(o.isNotNull()).withColumn("_c", confidence).where(F.coalesce(F.col("_c"), F.lit("")) != "")
    shown = [c for c in ("parse_ok", "hard_pass", "hard_fail_reasons", "derived_confidence", "selection_score", "completion_tokens", "completion_over_budget") if c in df.columns]
    report = [F.struct(*shown).alias("validation_report")] if shown else []
    completion = canonical_json(o["answerability"], F.transform(o["evidence"], lambda e: e["quote"]), o["rationale"], o["answer"], F.col("_c"))
    return kept.select(
        opt_str(F.col("id")).alias("id"), opt_str(F.col("source_id")).alias("source_id"), "data_split", F.lit("infer_v1").alias("prompt_style"),
        infer_prompt(opt_str(F.col("knowledge")), opt_str(F.col("question"))).alias("prompt"), completion.alias("completion"), o.withField("confidence", F.col("_c")).alias("target_structured"),
        F.struct(*[opt_str(F.col(c)).alias(c) for c in ("reference_answer", "answerability_label", "difficulty", "answerability_split") if c in df.columns], *report).alias("metadata"),
    )


def deduplicated(df: DataFrame, order: str = "_ord") -> DataFrame:
    """The first row in order of each composite key, null and missing fields counting as empty. Only the key's
    hash and the order, which tells rows apart, go through the aggregate; whole rows meet the winners last."""
    text = F.to_json(F.struct(*[(label_of(df) if f == "answerability_label" else F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("")).alias(f) for f in DEDUP_FIELDS]))
    keyed = df.select(F.unhex(F.sha2(text, 256)).alias("_key"), F.col(order).alias(order))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def split_name(c: Column) -> Column:
    """Old inputs: ``train_sft_raw`` and unknown splits are train."""
    s = F.coalesce(c, F.lit("train"))
    return F.when(s.isin("validation", "test"), s).otherwise("train")


def normalized(df: DataFrame, split: str | None = None, completion_needed: bool = True) -> DataFrame:
    """Rows with label, prompt (built where absent) and completion, and the ``drop_reason`` of those
    that lack one; test rows (by ``split``, or else by ``data_split``) need no completion."""
    have = lambda c: opt_str(F.col(c)) if c in df.columns else F.lit("")
    built = F.when((have("knowledge") != "") & (have("question") != ""), infer_prompt(have("knowledge"), have("question"))).otherwise(F.lit(""))
    prompt = F.when(have("prompt") != "", have("prompt")).otherwise(built)
    needed = F.lit(completion_needed) & (F.lit(split != "test") if split else F.coalesce(F.col("data_split") != "test", F.lit(True)))
    reason = F.when(F.col("prompt") == "", "missing_prompt").when(needed & (F.col("completion") == ""), "missing_completion")
    out = df.withColumns({"data_split": F.lit(split) if split else F.col("data_split"), "answerability_label": label_of(df), "prompt": prompt, "completion": have("completion")})
    return out.withColumn("drop_reason", reason)


def budgeted(df: DataFrame, max_prompt: int, max_completion: int, scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    """Token counts and the first exceeded budget as ``drop_reason`` (a limit of 0 or less is off)."""
    p, c = scorers.tokens(F.col("prompt")), scorers.tokens(F.col("completion"))
    out = df.withColumns({"prompt_tokens": p if max_prompt > 0 else F.lit(None).cast("int"), "completion_tokens": c if max_completion > 0 else F.lit(None).cast("int")})
    over = F.when(F.col("prompt_tokens") > max_prompt, "prompt_over_budget").when(F.col("completion_tokens") > max_completion, "completion_over_budget")
    return out.withColumn("drop_reason", F.coalesce(F.col("drop_reason"), over) if "drop_reason" in df.columns else over)


def capped(df: DataFrame, key: str, total: int, per_label: dict[str, int], label: str = "answerability_label", seed: int = 42, shuffle: bool = True, order: str = "_ord") -> DataFrame:
    """Rows in seeded order up to a cap per label (-1: none; other labels uncapped), then up to a total.
    Positions come from :func:`global_rank`, so neither a label nor the table is ranked in one task; only
    keys, labels and the order (which tells rows apart) are ranked, whole rows are filtered by it last."""
    slim = df.select(F.lit("").alias("_group"), F.col(label).alias("_label"), F.col(order), (seeded(F.col(key), seed) if shuffle else F.lit("")).alias("_draw"))
    return df.join(_within(slim, {"": total}, {"": per_label}, order), order, "left_semi")


def _within(slim: DataFrame, total: dict[str, int], per_label: dict[str, dict[str, int]], order: str) -> DataFrame:
    """The ``order`` of the rows within the caps of their ``_group``: by ``_draw``, first within ``_label``, then
    within the group."""
    by = [F.col("_draw"), F.col(order)]
    over = F.lit(False)
    for group, caps in per_label.items():
        for name, cap in caps.items():
            if cap > -1:
                over = over | ((F.col("_group") == group) & (F.col("_label") == name) & (F.col("_in_label") > cap))
    kept = global_rank(slim, by, ["_group", "_label"], "_in_label").where(~F.coalesce(over, F.lit(False))).drop("_in_label")
    late = F.lit(False)
    for group, cap in total.items():
        if cap >= 0:
            late = late | ((F.col("_group") == group) & (F.col("_at") > cap))
    return global_rank(kept, by, ["_group"], "_at").where(~late).select(order)


def prepared(df: DataFrame, cfg: PrepareSettings | None = None, scorers: S.Scorers = S.DEFAULT, key: str = "id") -> DataFrame:
    """Deduplicated, normalised, budgeted and capped rows of all three splits. The splits are ranked together,
    each under its own seed."""
    cfg = cfg or PrepareSettings()
    rows = deduplicated(df.withColumn("data_split", split_name(F.col("data_split"))))
    rows = budgeted(normalized(rows), cfg.max_prompt_tokens, cfg.max_completion_tokens, scorers).where("drop_reason is null").drop("drop_reason")
    rows = cut_lineage(rows)  # tokens are counted once
    draw = F.lit("")
    if cfg.shuffle:
        draw = F.coalesce(*[F.when(F.col("data_split") == split, seeded(F.col(key), cfg.seed + offset)) for split, offset in SPLIT_OFFSET.items()])
    slim = rows.select(F.col("data_split").alias("_group"), F.col("answerability_label").alias("_label"), F.col("_ord"), draw.alias("_draw"))
    caps = {split: {"answerable": cfg.answerable[split], "unanswerable": cfg.unanswerable[split]} for split in SPLIT_OFFSET}
    return rows.join(_within(slim, {split: cfg.total[split] for split in SPLIT_OFFSET}, caps, "_ord"), "_ord", "left_semi")


def drop_counts(df: DataFrame, *keys: str) -> DataFrame:
    reasons = ("missing_prompt", "missing_completion", "prompt_over_budget", "completion_over_budget")
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count("*").alias("num_input"), count_true(F.col("drop_reason").isNull()).alias("num_kept"), *[count_true(F.col("drop_reason") == r).alias(f"num_{r}") for r in reasons])


def loss_labels(prompt: Column, completion: Column, end: int, limit: int) -> Column:
    """Token ids and labels of a training row: the prompt is cut at its left end to fit, its labels are
    -100, and ``end`` closes the completion."""
    tail = F.concat(completion, F.array(F.lit(end)))
    room = F.greatest(F.lit(0), F.lit(limit) - F.size(tail))
    head = F.when(F.size(prompt) > room, F.when(room > 0, F.slice(prompt, -room, room)).otherwise(F.slice(prompt, 1, 0))).otherwise(prompt)
    return F.struct(F.slice(F.concat(head, tail), 1, limit).alias("ids"), F.slice(F.concat(F.transform(head, lambda _: F.lit(-100)), tail), 1, limit).alias("labels"))


def up_to_nth_kept(df: DataFrame, keys: list[str], kept: Column, by: list[Column], most: int) -> DataFrame:
    """``df`` with ``kept``, up to the ``most``-th kept row of each group in the order ``by`` (0: all).
    The cut is one row per group, found by :func:`global_rank` over the keys and places alone; the rest is a
    filter."""
    marked = df.withColumn("kept", F.coalesce(kept, F.lit(False)))
    if most <= 0:
        return marked
    place = F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)])
    slim = marked.where("kept").select(*keys, *[b.alias(f"_k{i}") for i, b in enumerate(by)])
    ranked = global_rank(slim, [F.col(f"_k{i}") for i in range(len(by))], keys, "_nth").where(F.col("_nth") == most)
    cut = ranked.select(*keys, F.struct(*[F.col(f"_k{i}").alias(f"k{i}") for i in range(len(by))]).alias("_cut"))
    return marked.join(cut, keys, "left").where(F.col("_cut").isNull() | (place <= F.col("_cut"))).drop("_cut")

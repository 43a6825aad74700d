"""Calibration: annotation packs, binary and selective statistics, grid and temperature search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CalibrationSettings
from ..functions.coerce import count_true, label_to_bool, low_if_missing, opt_str, rate, safe_int
from ..functions.text import evidence_text, qa_premise, rationale_answer
from .dataset import up_to_nth_kept
from .evaluate import flat_gate
from .judge import EPS, calibrated
from .order import first_per, seeded

TASKS = ("nli_flat", "nli_structured", "matcher")
REASONS = ("missing_fields", "missing_eval_state", "refusal_or_unanswerable", "matcher_not_applicable")


def values(explicit: str = "", low: float = 0.0, high: float = 0.0, step: float = 0.0) -> list[float]:
    """Grid values: the sorted distinct numbers of a list, or a range in steps, rounded to 10 places."""
    if explicit.strip():
        out = sorted({float(x) for x in explicit.split(",") if x.strip()})
        if not out:
            raise ValueError("no values")
        return out
    if step <= 0 or high < low:
        raise ValueError("a range needs a positive step and a maximum not below its minimum")
    out, at = [], low
    while at <= high + 1e-12:
        out.append(round(at, 10))
        at += step
    return out


def binary_stats(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and kappa from the four counts; all NaN over nothing."""
    n = tp + tn + fp + fn
    nan = F.lit(float("nan"))
    precision, recall = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    safe = F.greatest(F.lit(1), n)
    yes_p, yes_r = (tp + fp) / safe, (tp + fn) / safe
    chance = yes_p * yes_r + (1 - yes_p) * (1 - yes_r)
    accuracy = (tp + tn) / safe
    kappa = F.when(F.abs(1 - chance) < EPS, nan).otherwise((accuracy - chance) / F.when(F.abs(1 - chance) >= EPS, 1 - chance))
    some = lambda c: F.when(n > 0, c).otherwise(nan)
    return {"accuracy": some(accuracy), "precision": some(precision), "recall": some(recall), "f1": some(2.0 * precision * recall / F.greatest(F.lit(EPS), precision + recall)), "cohen_kappa": some(kappa)}


def selective_stats(df: DataFrame, keys: list[str], pred: Column, label: Column, alpha: float = 0.5) -> DataFrame:
    """Coverage, rejection, error among the kept (1 if none is), objective and binary statistics; a null
    prediction rejects its row, a null label leaves it out. One partial aggregate."""
    p, y = pred, label
    both = p.isNotNull() & y.isNotNull()
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("num_rows"), F.count(y).alias("num_labeled"), F.count_if(both).alias("num_kept"), count_true(p & y).alias("tp"), count_true(~p & ~y).alias("tn"), count_true(p & ~y).alias("fp"), count_true(~p & y).alias("fn"),
    )
    kept, labeled = F.col("num_kept"), F.col("num_labeled")
    out = agg.withColumn("num_rejected", labeled - kept).withColumns({"coverage": rate(kept, labeled), "reject_rate": rate(F.col("num_rejected"), labeled), **binary_stats(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))})
    out = out.withColumn("error_kept", F.when(kept > 0, 1.0 - F.col("accuracy")).otherwise(F.lit(1.0)))
    return out.withColumn("lagrangian_objective", F.when(labeled > 0, F.col("error_kept") + alpha * F.col("reject_rate")).otherwise(F.lit(float("nan"))))


def settings_grid(spark: SparkSession, margins: list[float], confidences: list[float] = (), bands: list[float] = ()) -> DataFrame:
    """``ordinal, method, margin_threshold, argmax_conf_threshold, band_half_width`` of every setting."""
    rows = [("argmax", None, None, None), *(("margin", m, None, None) for m in margins), *(("argmax_with_reject", None, c, None) for c in confidences), *(("margin_with_reject_band", m, None, b) for m in margins for b in bands)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ordinal int, method string, margin_threshold double, argmax_conf_threshold double, band_half_width double")


def grid_decision() -> Column:
    """Decision of a scored row under a setting: ``entail_is_top, top_prob, margin`` and the grid's
    columns; null rejects."""
    m, t = F.col("margin"), F.col("margin_threshold")
    return (
        F.when(F.col("method") == "argmax", F.col("entail_is_top")).when(F.col("method") == "margin", m >= t)
        .when(F.col("method") == "argmax_with_reject", F.when(F.col("top_prob") >= F.col("argmax_conf_threshold"), F.col("entail_is_top")))
        .when(F.col("method") == "margin_with_reject_band", F.when(F.abs(m - t) > F.col("band_half_width"), m >= t))
    )


def searched(scored: DataFrame, grid: DataFrame, keys: list[str], cfg: CalibrationSettings = CalibrationSettings()) -> DataFrame:
    """Statistics of every setting in every group. The grid (a few hundred settings, fixed by its
    parameters) is carried as an array literal, so rows times settings exist only inside the partial
    aggregate and no join is needed."""
    names = ["ordinal", "method", "margin_threshold", "argmax_conf_threshold", "band_half_width"]
    rows = grid.orderBy("ordinal").collect()
    setting = F.array(*[F.struct(*[F.lit(r[n]).cast(grid.schema[n].dataType).alias(n) for n in names]) for r in rows])
    crossed = scored.withColumn("_s", F.explode(setting)).select(*scored.columns, "_s.*")
    return selective_stats(crossed, [*keys, *names], grid_decision(), F.col("human_label_bool"), cfg.reject_alpha)


def best_setting(search: DataFrame, keys: list[str], objective: str = "f1") -> DataFrame:
    """The best row per group by objective, accuracy and coverage (NaN lowest), the first on ties."""
    return first_per(search, keys, [-low_if_missing(F.col(objective)), -low_if_missing(F.col("accuracy")), -low_if_missing(F.col("coverage")), F.col("ordinal")])


def fit_temperature(scored: DataFrame, keys: list[str], temperatures: list[float]) -> DataFrame:
    """``temperature, fit_nll`` per group: the smallest mean negative log likelihood of the labelled
    rows, the lowest temperature on ties; 1 and infinity where nothing is labelled."""
    same = ["entail", "neutral", "contradict", "human_label_bool"]  # rows alike in these have one loss
    labelled = scored.where(F.col("human_label_bool").isNotNull()).groupBy(*keys, *same).agg(F.count("*").alias("n")).withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures if t > 0])))
    p = calibrated(F.struct("entail", "neutral", "contradict"), F.col("temperature"))["entail"]
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    loss = F.when(F.col("human_label_bool"), -F.ln(p)).otherwise(-F.ln(1 - p))
    fits = labelled.groupBy(*keys, "temperature").agg(F.round(F.sum(loss * F.col("n")) / F.sum("n"), 12).alias("nll"))
    best = fits.groupBy(*keys).agg(F.min(F.struct("nll", "temperature")).alias("b"))
    return scored.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("b.temperature", F.lit(1.0)).alias("temperature"), F.coalesce("b.nll", F.lit(float("inf"))).alias("fit_nll"))


def apply_temperature(scored: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Scored rows with their group's temperature: ``margin, top_prob, entail_is_top``."""
    c = calibrated(F.struct("entail", "neutral", "contradict"), F.col("temperature"))
    return scored.join(fits.select(*keys, "temperature"), keys).withColumn("_c", c).withColumns({"margin": F.col("_c.margin"), "top_prob": F.col("_c.argmax_prob"), "entail_is_top": F.col("_c.argmax_label") == "entail"}).drop("_c")


def matcher_search(df: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Statistics of every matcher threshold; a null score is 0."""
    crossed = df.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(float(t)).alias("matcher_threshold")) for k, t in enumerate(thresholds)]))).select(*df.columns, "_t.*")
    return selective_stats(crossed, [*keys, "ordinal", "matcher_threshold"], F.coalesce("match_score", F.lit(0.0)) >= F.col("matcher_threshold"), F.col("human_label_bool"), 0.0)


def row_kind(df: DataFrame) -> tuple[Column, Column, Column]:
    """Whether a row is flat, structured, and has evaluation state: non-null values stand for the
    presence of fields, as rows of one table share their columns."""
    have = lambda *cs: F.greatest(*[F.col(c).isNotNull() for c in cs if c in df.columns], F.lit(False), F.lit(False))
    structured = have("parsed_output")
    state = have("extraction_parse_ok", "refusal_detected", "extracted_answer", "pred_answerability")
    text = lambda c: (opt_str(F.col(c)) != "") if c in df.columns else F.lit(False)
    flat = ~structured & (state | text("raw_answer") | (text("question") & text("knowledge") & text("answer")))
    return flat, structured | have("parse_ok", "protocol_ok", "raw_output"), state


def pack_rows(df: DataFrame, pack_id: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Every row for every task it is a candidate of, with its texts and the ``skip_reason`` (null: it
    makes a pack row). Columns of one kind only may be missing."""
    need = {"extraction_parse_ok": "boolean", "refusal_detected": "boolean", "extracted_answer": "string", "pred_answerability": "string", "raw_answer": "string", "answer": "string", "correctness_ok": "boolean", "question": "string", "knowledge": "string", "reference_answer": "string", "input_source_path": "string", "parsed_output": "struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>"}
    for c, kind in need.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    flat, structured, state = row_kind(df)
    o = F.col("parsed_output")
    s_answer, rationale, evidence = opt_str(o["answer"]), opt_str(o["rationale"]), F.coalesce(evidence_text(o["evidence"]), F.lit(""))
    s_gate = F.coalesce((o["answerability"] == "answerable") & (evidence != "") & (rationale != "") & (s_answer != ""), F.lit(False))
    f_gate = flat_gate(F.coalesce("extraction_parse_ok", F.lit(False)), F.col("refusal_detected"), F.col("extracted_answer"), F.col("pred_answerability"))
    q, k, ref = opt_str(F.col("question")), opt_str(F.col("knowledge")), opt_str(F.col("reference_answer"))
    f_answer = F.when(opt_str(F.col("raw_answer")) != "", opt_str(F.col("raw_answer"))).otherwise(opt_str(F.col("extracted_answer")))
    wrong = ~F.coalesce("correctness_ok", F.lit(False)) & (ref != "")
    df = df.withColumns({"_flat": flat, "_struct": structured, "_state": state}).withColumn("task_type", F.explode(F.array(*[F.lit(t) for t in tasks])))
    t = F.col("task_type")
    df = df.where(F.when(t == "nli_flat", F.col("_flat")).when(t == "nli_structured", F.col("_struct")).otherwise(F.col("_flat") | F.col("_struct")))
    applicable = (F.col("_flat") & f_gate | F.col("_struct") & s_gate) & wrong
    m_answer = F.when(F.col("_flat") & f_gate, opt_str(F.col("extracted_answer"))).otherwise(s_answer)
    refused = F.coalesce(F.col("refusal_detected"), F.lit(False)) | (F.coalesce("pred_answerability", F.lit("")) == "unanswerable")
    reason = (
        F.when(t == "nli_flat", F.when(~F.col("_state"), "missing_eval_state").when(~f_gate, F.when(refused, "refusal_or_unanswerable").otherwise("missing_fields")).when((q == "") | (k == "") | (f_answer == ""), "missing_fields"))
        .when(t == "nli_structured", F.when(~s_gate, "refusal_or_unanswerable").when(q == "", "missing_fields"))
        .otherwise(F.when(F.col("_flat") & ~F.col("_state"), "missing_eval_state").when(~applicable, F.when(F.col("correctness_ok").isNotNull(), "matcher_not_applicable").otherwise("refusal_or_unanswerable")).when((q == "") | (k == "") | (m_answer == ""), "missing_fields"))
    )
    answer = F.when(t == "nli_flat", f_answer).when(t == "nli_structured", s_answer).otherwise(m_answer)
    premise = F.when(t == "nli_flat", qa_premise(k, q)).when(t == "nli_structured", qa_premise(evidence, q)).otherwise("")
    hypothesis = F.when(t == "nli_flat", f_answer).when(t == "nli_structured", rationale_answer(rationale, s_answer)).otherwise("")
    return df.withColumns({
        "skip_reason": reason, "pack_id": F.lit(pack_id), "pack_answer": answer, "premise_text": premise, "hypothesis_text": hypothesis, "evidence_text": evidence, "rationale": rationale,
        "input_source_path": F.when(opt_str(F.col("input_source_path")) != "", F.col("input_source_path")).otherwise("<unknown>"),
    }).drop("_flat", "_struct", "_state")


def annotation_pack(df: DataFrame, pack_id: str, key: str, most: int = 200, seed: int = 42, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Pack rows of each task up to the ``most``-th kept one in seeded order, skipped rows included
    (``kept``), as the counts need those seen before the stop."""
    rows = pack_rows(df, pack_id, tasks)
    return up_to_nth_kept(rows, ["task_type"], F.col("skip_reason").isNull(), [seeded(F.col(key), seed), F.col(key)], most)


def pack_counts(pack: DataFrame, *keys: str) -> DataFrame:
    return pack.groupBy(*(keys or ("task_type",))).agg(count_true(F.col("kept")).alias("num_kept"), *[count_true(F.col("skip_reason") == r).alias(f"num_skipped_{r}") for r in REASONS])


def annotations(df: DataFrame, order: str = "_ord") -> DataFrame:
    """Annotated rows with a task: defaults of the ids, and the human label as true, false or null."""
    tag = F.when(opt_str(F.col("model_tag")) != "", opt_str(F.col("model_tag"))).otherwise("model")
    path = opt_str(F.col("model_path"))
    sample = F.coalesce(F.col("sample_id").cast("string").try_cast("int"), F.col(order).cast("int"))
    return df.where(opt_str(F.col("task_type")) != "").withColumns({"task_type": opt_str(F.col("task_type")), "sample_id": sample, "model_tag": tag, "model_step": safe_int(F.col("model_step")), "model_path": F.when(path != "", path).otherwise(tag), "human_label_bool": label_to_bool(F.col("human_label"))})


def label_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("task_type").agg(F.count("*").alias("num_rows"), F.count(label_to_bool(F.col("human_label"))).alias("num_labeled"))

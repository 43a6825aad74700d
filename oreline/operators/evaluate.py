"""Evaluation of generated answers: normalised rows, gates, per-model metrics in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import scorers as S
from ..functions.coerce import count_true, first_non_empty, mean, only_where, opt_str, rate, safe_int, text_list
from ..functions.text import question_of_prompt, rationale_answer, split_prompt, word_count
from ..session import cut_lineage
from .judge import judged, judged_outputs
from .protocol import checked, correctness, extraction, parse
from .selection import buckets, correlations, murphy

MODEL_KEY = ["model_tag", "model_step", "model_path", "eval_track", "eval_variant"]
LEVELS = ["high", "medium", "low"]


def _has(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def eval_track(df: DataFrame) -> Column:
    """Explicit track, else by prompt mode and by which columns there are."""
    mode = first_non_empty(*_has(df, "prompt_mode")) if "prompt_mode" in df.columns else F.lit("")
    fallback = "sft_structured" if "parsed_output" in df.columns else "base_task" if "answer" in df.columns else ""
    own = first_non_empty(*_has(df, "eval_track")) if "eval_track" in df.columns else F.lit("")
    return F.when(own != "", own).when(mode.isin("teacher", "teacher_fewshot"), "base_protocol").when(mode == "infer", "sft_structured").otherwise(fallback)


def eval_variant(df: DataFrame) -> Column:
    mode = first_non_empty(*_has(df, "prompt_mode")) if "prompt_mode" in df.columns else F.lit("")
    own = first_non_empty(*_has(df, "eval_variant")) if "eval_variant" in df.columns else F.lit("")
    out = F.when(own != "", own).when(mode.isin("teacher", "teacher_fewshot"), "fewshot").when((mode == "infer") | F.lit("parsed_output" in df.columns), "checkpoint")
    if "enable_thinking" in df.columns:
        out = out.when(F.col("enable_thinking"), "think").when(~F.col("enable_thinking"), "no_think")
    if "thinking_mode" in df.columns:
        hint = F.lower(opt_str(F.col("thinking_mode")))
        out = out.when(hint.isin("think", "enabled"), "think").when(hint.isin("no_think", "disabled"), "no_think")
    return out.otherwise("")


def reference_of(df: DataFrame) -> Column:
    nested = [F.col("metadata.reference_answer")] if "metadata" in df.columns and "reference_answer" in getattr(df.schema["metadata"].dataType, "names", []) else []
    return first_non_empty(*_has(df, "reference_answer", "answer", "chosen", "reference", "right_answer"), *nested)


def knowledge_of(df: DataFrame) -> Column:
    """Knowledge, else the joined contexts, else the prompt's block."""
    lists = [F.array_join(text_list(F.col(c)), "\n\n") for c in ("eval_contexts", "contexts", "retrieval_context", "context") if c in df.columns]
    prompt = [split_prompt(F.col("prompt"))["knowledge"]] if "prompt" in df.columns else []
    return first_non_empty(*_has(df, "knowledge"), *lists, *prompt)


def question_of(df: DataFrame) -> Column:
    prompt = [split_prompt(F.col("prompt"))["question"], question_of_prompt(F.col("prompt"))] if "prompt" in df.columns else []
    return first_non_empty(*_has(df, "question", "eval_question", "input"), *prompt)


def answer_of(df: DataFrame, source: str = "answer") -> Column:
    """Answer text; ``rationale_plus_answer`` prefers both parts of a parsed output."""
    plain = first_non_empty(*_has(df, "answer", "actual_output", "raw_output"))
    if "parsed_output" not in df.columns:
        return plain
    a, r = opt_str(F.col("parsed_output.answer")), opt_str(F.col("parsed_output.rationale"))
    out = F.when(a != "", a).otherwise(plain)
    return F.when((a != "") & (r != ""), rationale_answer(r, a)).otherwise(out) if source == "rationale_plus_answer" else out


def generation_items(df: DataFrame, order: str = "_ord") -> DataFrame:
    """Items to generate for: rows that have a question and knowledge, with ids and fallbacks."""
    row = F.col(order)
    source = first_non_empty(*_has(df, "source_id", "id"), row.cast("string"))
    out = df.select(
        row.cast("int").alias("sample_id"), first_non_empty(*_has(df, "id"), source).alias("id"), source.alias("source_id"), question_of(df).alias("question"), knowledge_of(df).alias("knowledge"),
        (opt_str(F.col("prompt")) if "prompt" in df.columns else F.lit("")).alias("prompt"), reference_of(df).alias("reference_answer"),
        first_non_empty(*_has(df, "answerability_label")).alias("answerability_label") if "answerability_label" in df.columns else F.lit("").alias("answerability_label"),
        eval_track(df).alias("eval_track"), eval_variant(df).alias("eval_variant"), row.alias(order),
    )
    return out.where("question <> '' and knowledge <> ''")


def generated_rows(df: DataFrame, source: str = "answer", order: str = "_ord") -> DataFrame:
    """Normalised generated rows with an answer, a question and knowledge."""
    tag = first_non_empty(*_has(df, "model_tag", "tag"), F.lit("model"))
    step = safe_int(F.coalesce(*[c.cast("string") for c in _has(df, "model_step", "step")], F.lit("0")))
    sample = F.coalesce(*[c.cast("string").try_cast("int") for c in _has(df, "sample_id")], F.col(order).cast("int"))
    out = df.select(
        tag.alias("model_tag"), step.alias("model_step"), first_non_empty(*_has(df, "model_path", "model_name"), tag).alias("model_path"), eval_track(df).alias("eval_track"), eval_variant(df).alias("eval_variant"),
        sample.alias("sample_id"), first_non_empty(*_has(df, "source_id", "id"), sample.cast("string")).alias("source_id"), question_of(df).alias("question"), knowledge_of(df).alias("knowledge"),
        reference_of(df).alias("reference_answer"), answer_of(df, source).alias("answer"), F.col(order).alias(order),
    )
    return out.where("answer <> '' and question <> '' and knowledge <> ''")


def sampled(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` sample keys, those with the smallest seeded hashes (0: all rows)."""
    if n <= 0:
        return df
    keys = df.select(key.alias("_k")).distinct().orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), "_k")), "_k").limit(n)
    return df.withColumn("_k", key).join(keys, "_k", "left_semi").drop("_k")


def flat_gate(parse_ok: Column, refusal: Column, extracted: Column, predicted: Column) -> Column:
    """Whether a flat row enters the content checks."""
    return F.coalesce(parse_ok & ~refusal & (opt_str(extracted) != "") & ((opt_str(predicted) == "") | (predicted == "answerable")), F.lit(False))


def flat_skip_reason(parse_ok: Column, refusal: Column, extracted: Column, predicted: Column) -> Column:
    return (
        F.when(~F.coalesce(parse_ok, F.lit(False)), "extraction_parse_failed").when(refusal, "predicted_refusal").when(refusal.isNull(), "missing_refusal_signal")
        .when(opt_str(extracted) == "", "empty_extracted_answer").when((opt_str(predicted) != "") & (predicted != "answerable"), "predicted_unanswerable").otherwise("")
    )


def structured_details(df: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT, semantics: bool = True) -> DataFrame:
    """One row per structured generation with every flag the metrics count.

    ``df`` has the model key, ``raw_output``, ``question, knowledge, reference_answer,
    answerability_label`` and optionally ``attempt_count, protocol_passed, generation_failed``."""
    if "supporting_sentences" not in df.columns:
        df = df.withColumn("supporting_sentences", F.array().cast("array<struct<sentence:string>>"))
    d = checked(parse(df), cfg.protocol, cfg.token_f1)
    d = judged_outputs(d, cfg.judge, scorers) if semantics else d.withColumn("semantic", F.struct(F.lit(None).cast("string").alias("decision"), F.lit(None).cast("double").alias("margin")))
    gold, pred = opt_str(F.col("answerability_label")), F.coalesce("parsed_output.answerability", F.lit(""))
    ok = F.coalesce("protocol_ok", F.lit(False))
    passed = F.coalesce("protocol_passed", F.lit(False)) if "protocol_passed" in df.columns else ok
    failed = F.coalesce("generation_failed", F.lit(False)) if "generation_failed" in df.columns else ~passed
    d = d.withColumns({
        "attempts": F.greatest(F.lit(1), F.coalesce("attempt_count", F.lit(1))) if "attempt_count" in df.columns else F.lit(1), "generation_passed": passed, "generation_failed": failed,
        "usable": F.col("parse_ok") & ok, "source_is_answerable": gold == "answerable", "source_is_unanswerable": gold == "unanswerable",
        "pred_answerable": pred == "answerable", "answerability_match": F.when(F.col("parse_ok") & (gold != ""), pred == gold),
    })
    d = d.withColumn("e2e_answerability_success", F.col("usable") & F.coalesce("answerability_match", F.lit(False)))
    d = d.withColumn("gate", F.col("source_is_answerable") & F.col("e2e_answerability_success"))
    strict = F.when(F.col("gate") & F.col("correct").isNotNull(), F.col("correct.ok"))
    d = only_where(d.withColumn("strict_ok", strict), F.col("strict_ok") == F.lit(False), lambda x: x.withColumn("match_score", scorers.match(F.col("question"), F.col("reference_answer"), F.col("parsed_output.answer"))))
    review = F.when(F.col("strict_ok") == F.lit(False), F.col("match_score") >= cfg.matcher)
    run = F.col("gate") & F.col("semantic.decision").isNotNull() & ok & (opt_str(F.col("question")) != "")
    d = d.withColumns({"matcher_ok": review, "reviewed_ok": F.when(F.col("strict_ok"), F.lit(True)).otherwise(review), "decision": F.when(run, F.col("semantic.decision")), "margin": F.when(run, F.col("semantic.margin"))})
    e2e = lambda c: F.when(F.col("source_is_unanswerable"), F.col("e2e_answerability_success")).when(F.col("source_is_answerable"), F.col("gate") & F.coalesce(c, F.lit(False))).otherwise(F.lit(False))
    return d.withColumns({"e2e_correct": e2e(F.col("reviewed_ok")), "e2e_semantic": e2e(F.col("decision") == "yes"), "evidence_ok": F.when(F.col("usable") & F.col("pred_answerable"), F.coalesce("evidence.ok", F.lit(False))), "confidence": F.col("parsed_output.confidence")})


def structured_metrics(d: DataFrame, keys: list[str] = MODEL_KEY) -> DataFrame:
    """Per-model metrics of :func:`structured_details` in one aggregation of conditional counts, with
    the resolution of the confidence levels joined on the key. The flags, without the texts, are
    checkpointed, as three aggregations read them."""
    d = flags(d, keys)
    c = {name: count_true(F.col(name)) for name in ("parse_ok", "usable", "gate", "e2e_answerability_success", "source_is_answerable", "source_is_unanswerable", "strict_ok", "reviewed_ok", "matcher_ok", "e2e_correct", "e2e_semantic", "evidence_ok", "generation_failed")}
    n = F.count("*")
    protocol = count_true(F.col("parse_ok") & F.col("protocol_ok"))
    pred = count_true(F.col("usable") & F.col("pred_answerable"))
    reviewed = F.count("matcher_ok")
    judged_n, yes = F.count("decision"), count_true(F.col("decision") == "yes")
    ans_c, ans_s = count_true(F.col("source_is_answerable") & F.col("e2e_correct")), count_true(F.col("source_is_answerable") & F.col("e2e_semantic"))
    un = count_true(F.col("source_is_unanswerable") & F.col("e2e_answerability_success"))
    out = d.groupBy(*keys).agg(
        n.alias("num_rows"), c["parse_ok"].alias("num_parse_ok"), rate(c["parse_ok"], n).alias("parse_ok_rate"), protocol.alias("num_protocol_ok"), rate(protocol, c["parse_ok"]).alias("protocol_ok_rate_given_parse_ok"),
        c["usable"].alias("num_usable"), rate(c["usable"], n).alias("usable_rate"), c["source_is_answerable"].alias("num_source_answerable"), c["source_is_unanswerable"].alias("num_source_unanswerable"),
        c["e2e_answerability_success"].alias("num_e2e_answerability_success"), rate(c["e2e_answerability_success"], n).alias("e2e_answerability_accuracy"),
        pred.alias("num_usable_pred_answerable"), c["evidence_ok"].alias("evidence_substring_success_count"), rate(c["evidence_ok"], pred).alias("evidence_substring_rate_on_usable_pred_answerable"),
        c["gate"].alias("answerable_gate_total"), c["strict_ok"].alias("correctness_strict_ok"), reviewed.alias("correctness_matcher_review_total"), c["matcher_ok"].alias("correctness_matcher_positive"), rate(c["matcher_ok"], reviewed).alias("correctness_matcher_positive_rate"),
        c["reviewed_ok"].alias("correctness_reviewed_ok"), c["e2e_correct"].alias("num_e2e_reviewed_correctness_success"), rate(c["e2e_correct"], n).alias("e2e_reviewed_correctness_success_rate"),
        judged_n.alias("semantic_total"), yes.alias("semantic_yes"), rate(judged_n, c["gate"]).alias("semantic_evaluated_rate_on_answerable_gate"), c["e2e_semantic"].alias("num_e2e_semantic_success"), rate(c["e2e_semantic"], n).alias("e2e_semantic_success_rate"),
        ans_c.alias("num_answerable_reviewed_correctness_success"), rate(ans_c, c["source_is_answerable"]).alias("answerable_reviewed_correctness_success_rate"),
        ans_s.alias("num_answerable_semantic_success"), rate(ans_s, c["source_is_answerable"]).alias("answerable_semantic_success_rate"), un.alias("num_unanswerable_success"), rate(un, c["source_is_unanswerable"]).alias("unanswerable_success_rate"),
        mean(F.col("margin")).alias("semantic_margin_mean"), c["generation_failed"].alias("generation_failed_count"), rate(c["generation_failed"], n).alias("generation_failed_rate"), mean(F.col("attempts")).alias("avg_attempt_count"),
        rate(count_true(F.col("generation_passed") & (F.col("attempts") == 1)), n).alias("success_on_first_attempt_rate"), F.lit(False).alias("supporting_fact_check_enabled"),
    )
    pairs = confidence_pairs(d, keys)
    for y, name in (("e2e_correct", "reviewed_correctness"), ("e2e_semantic", "semantic")):
        res = murphy(pairs, keys, "confidence", y).withColumnsRenamed({"resolution": f"e2e_confidence_resolution_{name}", "n": f"e2e_confidence_resolution_{name}_num_rows"})
        out = out.join(res, keys, "left").withColumns({f"e2e_confidence_resolution_{name}": F.coalesce(f"e2e_confidence_resolution_{name}", F.lit(float("nan"))), f"e2e_confidence_resolution_{name}_num_rows": F.coalesce(f"e2e_confidence_resolution_{name}_num_rows", F.lit(0))})
    return out


FLAGS = ("parse_ok", "protocol_ok", "usable", "gate", "pred_answerable", "e2e_answerability_success", "source_is_answerable", "source_is_unanswerable", "strict_ok", "reviewed_ok", "matcher_ok", "e2e_correct", "e2e_semantic", "evidence_ok", "generation_failed", "generation_passed", "attempts", "decision", "margin", "confidence")


def flags(d: DataFrame, keys: list[str]) -> DataFrame:
    """The columns the metrics need, computed once."""
    labelled = (opt_str(F.col("answerability_label")) != "").alias("labelled")
    return cut_lineage(d.select(*keys, *FLAGS, F.col("semantic.margin").alias("raw_margin"), labelled))


def confidence_pairs(d: DataFrame, keys: list[str]) -> DataFrame:
    """Usable rows with a gold label: confidence, its rank 1 to 3, and the outcomes as numbers."""
    ok = F.col("usable") & F.col("labelled")
    level = F.when(F.col("confidence") == "low", 1).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "high", 3)
    return d.where(ok).select(*keys, "confidence", level.alias("rank"), F.col("e2e_correct").cast("double").alias("e2e_correct"), F.col("e2e_semantic").cast("double").alias("e2e_semantic"), F.col("raw_margin").alias("margin")).where("rank is not null")


def confidence_analysis(d: DataFrame, keys: list[str] = MODEL_KEY) -> tuple[DataFrame, DataFrame]:
    """Correlations of the confidence rank with each outcome, and the outcome means by level."""
    pairs = confidence_pairs(flags(d, keys), keys)
    corr = None
    for y in ("e2e_correct", "e2e_semantic", "margin"):
        one = correlations(pairs, keys, "rank", y).withColumn("outcome", F.lit(y))
        corr = one if corr is None else corr.unionByName(one)
    return corr, buckets(pairs, keys, "confidence", LEVELS, e2e_correct_rate="e2e_correct", e2e_semantic_rate="e2e_semantic", margin_mean="margin")


def flat_details(df: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    """One row per flat generation. ``df`` has ``extraction_text`` (the extractor's raw output) or its
    parsed columns ``extraction_parse_ok, refusal_detected, extracted_answer``."""
    if "extraction_text" in df.columns:
        e = df.withColumn("_e", extraction(F.col("extraction_text")))
        df = e.withColumns({"extraction_parse_ok": F.col("_e.ok"), "refusal_detected": F.col("_e.refusal_detected"), "extracted_answer": F.col("_e.short_answer")}).drop("_e")
    ok, refusal = F.coalesce("extraction_parse_ok", F.lit(False)), F.col("refusal_detected")
    gold = opt_str(F.col("answerability_label"))
    d = df.withColumns({"usable": ok, "source_is_answerable": gold == "answerable", "source_is_unanswerable": gold == "unanswerable", "pred": F.when(ok & refusal.isNotNull(), F.when(refusal, "unanswerable").otherwise("answerable"))})
    d = d.withColumn("answerability_match", F.when(F.col("pred").isNotNull() & (gold != ""), F.col("pred") == gold)).withColumn("e2e_answerability_success", ok & F.coalesce("answerability_match", F.lit(False)))
    gate_args = (ok, refusal, F.col("extracted_answer"), F.col("pred"))
    d = d.withColumn("gate", F.col("source_is_answerable") & F.col("e2e_answerability_success") & flat_gate(*gate_args))
    d = d.withColumn("skip_reason", F.when(F.col("gate"), "").otherwise(flat_skip_reason(*gate_args)))
    reference = opt_str(F.col("reference_answer"))
    d = d.withColumn("correct", F.when(F.col("gate") & (reference != ""), correctness(F.col("extracted_answer"), reference, cfg.token_f1)))
    d = only_where(d, F.col("correct.ok") == F.lit(False), lambda x: x.withColumn("matcher_ok", scorers.match(F.col("question"), reference, F.col("extracted_answer")) >= cfg.matcher))
    d = only_where(d, F.col("gate"), lambda x: judged(x, cfg.judge, scorers, answer=first_non_empty(F.col("answer"), F.col("extracted_answer"))))
    d = d.withColumns({"reviewed_ok": F.when(F.col("correct.ok"), F.lit(True)).otherwise(F.col("matcher_ok")), "decision": F.when(F.col("gate"), F.col("judge.full")), "margin": F.when(F.col("gate"), F.col("judge.margin"))}).drop("judge")
    e2e = lambda c: F.when(F.col("source_is_unanswerable"), F.col("e2e_answerability_success")).when(F.col("source_is_answerable"), F.col("gate") & F.coalesce(c, F.lit(False))).otherwise(F.lit(False))
    return d.withColumns({"e2e_correct": e2e(F.col("reviewed_ok")), "e2e_semantic": e2e(F.col("decision") == "yes")})


def flat_metrics(d: DataFrame, keys: list[str] = MODEL_KEY) -> DataFrame:
    """Per-model metrics of :func:`flat_details`."""
    n = F.count("*")
    ct = lambda name: count_true(F.col(name))
    total, reviewed = F.count("correct"), F.count("matcher_ok")
    ans = count_true(F.col("source_is_answerable"))
    un_n = count_true(F.col("source_is_unanswerable"))
    ans_c, ans_s = count_true(F.col("source_is_answerable") & F.col("e2e_correct")), count_true(F.col("source_is_answerable") & F.col("e2e_semantic"))
    un = count_true(F.col("source_is_unanswerable") & F.col("e2e_answerability_success"))
    return d.groupBy(*keys).agg(
        n.alias("num_rows"), rate(ct("usable"), n).alias("extraction_parse_ok_rate"), rate(ct("usable"), n).alias("usable_rate"), rate(ct("refusal_detected"), n).alias("refusal_detected_rate"), ans.alias("num_source_answerable"), un_n.alias("num_source_unanswerable"),
        ct("e2e_answerability_success").alias("num_e2e_answerability_success"), rate(ct("e2e_answerability_success"), n).alias("e2e_answerability_accuracy"), ct("gate").alias("content_eval_total"), rate(ct("gate"), n).alias("content_eval_gate_rate"),
        count_true(F.col("skip_reason").isin("predicted_refusal", "predicted_unanswerable")).alias("num_refusal_or_unanswerable_skipped"), total.alias("correctness_total"), count_true(F.col("correct.ok")).alias("correctness_strict_ok"),
        reviewed.alias("correctness_matcher_review_total"), ct("matcher_ok").alias("correctness_matcher_positive"), rate(ct("matcher_ok"), reviewed).alias("correctness_matcher_positive_rate"), ct("reviewed_ok").alias("correctness_reviewed_ok"),
        ct("e2e_correct").alias("num_e2e_reviewed_correctness_success"), rate(ct("e2e_correct"), n).alias("e2e_reviewed_correctness_success_rate"), count_true(F.col("decision").isin("yes", "no")).alias("semantic_total"), count_true(F.col("decision") == "yes").alias("semantic_yes"),
        ct("e2e_semantic").alias("num_e2e_semantic_success"), rate(ct("e2e_semantic"), n).alias("e2e_semantic_success_rate"), ans_c.alias("num_answerable_reviewed_correctness_success"), rate(ans_c, ans).alias("answerable_reviewed_correctness_success_rate"),
        ans_s.alias("num_answerable_semantic_success"), rate(ans_s, ans).alias("answerable_semantic_success_rate"), un.alias("num_unanswerable_success"), rate(un, un_n).alias("unanswerable_success_rate"), mean(F.col("margin")).alias("semantic_margin_mean"),
    )


def hallucination_metrics(d: DataFrame, keys: list[str] = MODEL_KEY) -> DataFrame:
    """Cases, scored, passed, errors and mean score of ``score, success, error`` rows."""
    n, scored = F.count("*"), F.count("success")
    return d.groupBy(*keys).agg(n.alias("num_cases"), scored.alias("num_scored"), rate(scored, n).alias("scored_rate"), count_true(F.col("success")).alias("pass_count"), rate(count_true(F.col("success")), scored).alias("pass_rate"), count_true(opt_str(F.col("error")) != "").alias("num_errors"), mean(F.when(~F.isnan("score"), F.col("score"))).alias("score_mean"))


def loss_metrics(d: DataFrame, keys: list[str] = MODEL_KEY, nll: str = "nll", tokens: str = "num_tokens") -> DataFrame:
    """Mean of row means, token-weighted mean and perplexity of rows with tokens."""
    used = d.where(F.col(tokens) > 0)
    per_token = rate(F.sum(nll), F.sum(tokens))
    return used.groupBy(*keys).agg(F.count("*").alias("num_used_rows"), mean(F.col(nll) / F.col(tokens)).alias("mean_loss"), per_token.alias("mean_nll_per_token"), F.exp(per_token).alias("perplexity"))


def token_usage(df: DataFrame, keys: list[str] = MODEL_KEY, text: str = "text", usage: str = "token_usage", tokens=word_count) -> DataFrame:
    """``n, completion_tokens`` per model and ``source``: the provider's count where there is one, else the
    counter's estimate; a null text has no tokens of its own."""
    own = F.col(f"{usage}.completion_tokens")
    origin = F.when(own.isNotNull(), "provider").otherwise("estimated")
    return df.groupBy(*keys, origin.alias("source")).agg(F.count("*").alias("n"), F.sum(F.coalesce(own, tokens(F.col(text)))).cast("bigint").alias("completion_tokens"))


def stage_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``num_input, num_kept, num_dropped`` of a stage that only drops rows: one row."""
    n, kept = before.agg(F.count("*").alias("num_input")), after.agg(F.count("*").alias("num_kept"))
    return n.withColumn("num_kept", kept.scalar()).withColumn("num_dropped", F.col("num_input") - F.col("num_kept"))

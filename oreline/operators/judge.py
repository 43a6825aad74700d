"""Calibrated entailment decisions over any scorer, and the metrics on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JudgeSettings, VerifierSettings
from ..functions import scorers as S
from ..functions.coerce import count_true, let, once, only_where, opt_str, rate_floor, rate_zero
from ..functions.text import evidence_text, qa_premise, rationale_answer
from .protocol import answer_type

EPS = 1e-12


def log_probs(scores: Column) -> tuple[Column, Column, Column]:
    return tuple(F.ln(F.greatest(scores[k], F.lit(EPS))) for k in ("entail", "neutral", "contradict"))


def calibrated(scores: Column, temperature: Column | float) -> Column:
    """Temperature-scaled softmax of log probabilities: ``entail, neutral, contradict, margin,
    argmax_prob, argmax_label`` (ties: entail, neutral, contradict); the margin is on the scaled logs."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    names = ("entail", "neutral", "contradict")
    logs = F.struct(*[(x / t).alias(k) for k, x in zip(names, log_probs(scores))])

    def weights(x: Column) -> Column:
        top = F.greatest(*[x[k] for k in names])
        return F.struct(*[F.exp(x[k] - top).alias(k) for k in names], (x["entail"] - F.greatest(x["neutral"], x["contradict"])).alias("margin"))

    def shares(w: Column) -> Column:
        total = w["entail"] + w["neutral"] + w["contradict"]
        return F.struct(*[(w[k] / total).alias(k) for k in names], w["margin"].alias("margin"))

    def finish(p: Column) -> Column:
        e, n, c = (p[k] for k in names)
        label = F.when((e >= n) & (e >= c), "entail").when(n >= c, "neutral").otherwise("contradict")
        return F.struct(e.alias("entail"), n.alias("neutral"), c.alias("contradict"), p["margin"].alias("margin"), F.greatest(e, n, c).alias("argmax_prob"), label.alias("argmax_label"))

    return let(let(let(logs, weights), shares), finish)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return F.ln(q / (1 - q))


def full_decision(margin: Column, cfg: JudgeSettings) -> Column:
    return margin >= cfg.full_margin


def reject_decision(margin: Column, cfg: JudgeSettings) -> Column:
    """Null inside the band around the threshold."""
    return F.when(F.abs(margin - cfg.reject_margin) > cfg.reject_band, margin >= cfg.reject_margin)


def judged(df: DataFrame, cfg: JudgeSettings = JudgeSettings(), scorers: S.Scorers = S.DEFAULT, premise: Column | None = None, answer: Column | None = None, scores: Column | None = None) -> DataFrame:
    """``df`` with ``judge``: scores, margin, the pre-gate decision ``supported``, ``full`` (yes, no),
    ``reject`` (yes, no, abstain), the type check and ``forced_negative``. A failed or switched-off type
    check forces a negative where ``fail_as_negative`` is set."""
    a = F.col("answer") if answer is None else answer
    p = qa_premise(F.col("knowledge"), F.col("question")) if premise is None else premise
    raw = scorers.nli(p, a) if scores is None else scores
    df = once(df, _raw=raw)
    df = once(df, _cal=calibrated(F.col("_raw"), cfg.temperature))
    kind = answer_type(F.col("question"), a, scorers.entities(a) if cfg.check_type else None)
    df = df.withColumn("_type", kind).withColumn("_ok", F.coalesce(F.col("_type.answer_type_ok"), F.lit(False)))
    forced = ~F.col("_ok") if cfg.fail_as_negative else F.lit(False)
    full, reject = full_decision(F.col("_cal.margin"), cfg), reject_decision(F.col("_cal.margin"), cfg)
    word = lambda x: F.when(x.isNull(), "abstain").when(x, "yes").otherwise("no")
    return df.withColumn("judge", F.struct(
        F.col("_raw").alias("raw"), F.col("_cal").alias("calibrated"), F.col("_cal.margin").alias("margin"), full.alias("supported"),
        F.when(forced, "no").otherwise(F.when(full, "yes").otherwise("no")).alias("full"), F.when(forced, "no").otherwise(word(reject)).alias("reject"),
        F.col("_type").alias("answer_type"), F.col("_ok").alias("qa_consistent"), forced.alias("forced_negative"),
    )).drop("_raw", "_cal", "_type", "_ok")


def judge_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of decisions, and the abstention rate over max(1, rows)."""
    n = F.count("*")
    counts = [count_true(F.col(f"judge.{c}") == v).alias(f"num_{c}_{v}") for c, v in (("full", "yes"), ("full", "no"), ("reject", "yes"), ("reject", "no"), ("reject", "abstain"))]
    out = df.groupBy(*keys) if keys else df.groupBy()
    return out.agg(n.alias("num_rows"), *counts, rate_floor(count_true(F.col("judge.reject") == "abstain"), n).alias("abstain_rate"))


def judged_outputs(df: DataFrame, cfg: JudgeSettings = JudgeSettings(), scorers: S.Scorers = S.DEFAULT, source: str = "full") -> DataFrame:
    """Parsed outputs judged on their own evidence: premise the quotes, hypothesis the rationale and
    answer. Unanswerable outputs and outputs without quotes are skipped (nulls in ``semantic``): the scorer
    never sees them."""
    if source not in ("full", "reject"):
        raise ValueError(f"unknown decision source {source!r}")
    o = F.col("parsed_output")
    chosen = evidence_text(o["evidence"])
    run = F.coalesce(o.isNotNull() & (o["answerability"] == "answerable") & F.col("_chosen").isNotNull(), F.lit(False))
    score = lambda x: judged(x, cfg, scorers, qa_premise(F.col("_chosen"), F.col("question")), rationale_answer(o["rationale"], o["answer"]))
    out = only_where(df.withColumn("_chosen", chosen), run, score)
    decision = F.when(run, F.col(f"judge.{source}"))
    ok = F.when(decision == "yes", F.lit(True)).when(decision == "no", F.lit(False))
    skipped = o.isNotNull() & (o["answerability"] == "answerable") & F.col("_chosen").isNull()
    # fixed values: what the issues say
    issue = F.when(skipped, "Semantic check skipped because no valid evidence quotes are available.").when(run & (decision != "yes"), "Semantic judge did not mark the rationale-answer chain as supported.").otherwise("")
    return out.withColumn("semantic", F.struct(ok.alias("ok"), F.when(run, F.col("judge.supported")).alias("supported"), decision.alias("decision"), F.when(run, F.col("judge.margin")).alias("margin"), issue.alias("issue"))).drop("_chosen", "judge")


def semantic_fail(decision: Column, reject_aware: bool = False, enabled: bool = True) -> Column:
    """Hard failure: ``no``, and ``abstain`` where rejection counts; null or disabled passes."""
    if not enabled:
        return F.lit(False)
    return F.coalesce(decision.isin("no", "abstain") if reject_aware else decision == "no", F.lit(False))


def flip(answer: Column) -> Column:
    a = F.lower(opt_str(answer))
    return F.when(a == "yes", "no").when(a == "no", "yes")


def statement(answer: Column) -> Column:
    return F.concat(F.lit("The answer is "), opt_str(answer), F.lit("."))


def unsupported(df: DataFrame, cfg: JudgeSettings = JudgeSettings(fail_as_negative=False, check_type=False), scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    """``df`` with ``nli_prefilter``: keep only if the reference answer is no longer supported by the
    knowledge and, for yes or no, neither is its opposite; ``score`` is the mean margin."""
    premise = qa_premise(F.col("knowledge"), F.col("question"))
    margin = lambda a: calibrated(scorers.nli(premise, statement(a)), cfg.temperature)["margin"]
    own, other = margin(F.col("reference_answer")), margin(F.col("_flipped"))
    df = df.withColumn("_flipped", flip(F.col("reference_answer")))
    df = only_where(df, F.col("_flipped").isNotNull(), lambda x: once(x, _m=own, _f=other), lambda x: once(x, _m=own))
    no = ~full_decision(F.col("_m"), cfg)
    flipped_no = F.when(F.col("_f").isNotNull(), ~full_decision(F.col("_f"), cfg))
    score = F.when(F.col("_f").isNotNull(), (F.col("_m") + F.col("_f")) / 2).otherwise(F.col("_m"))
    word = lambda x: F.when(x.isNotNull(), F.when(x, "no").otherwise("yes"))
    # fixed values: what the issues say
    issues = F.array_compact(F.array(F.when(~no, "Original reference answer is still supported by the constructed knowledge."), F.when(~flipped_no, "Flipped yes/no answer is still supported by the constructed knowledge.")))
    return df.withColumn("nli_prefilter", F.struct((no & F.coalesce(flipped_no, F.lit(True))).alias("keep"), word(no).alias("decision"), F.col("_m").alias("margin"), score.alias("score"), F.col("_f").isNotNull().alias("used_flipped"), word(flipped_no).alias("flipped_decision"), F.col("_f").alias("flipped_margin"), issues.alias("issues"))).drop("_m", "_f", "_flipped")


def prefilter(df: DataFrame, max_prompt_tokens: int = 512, cfg: JudgeSettings = JudgeSettings(fail_as_negative=False, check_type=False), scorers: S.Scorers = S.DEFAULT, nli: bool = True) -> DataFrame:
    """Rows with ``prompt_tokens, within_budget, source_prefilter`` (tokens, budget, issues), ``nli_prefilter``
    and ``kept``: the prompt budget for all, the support check for unanswerable rows within it; no other row
    is scored."""
    from ..functions.text import infer_prompt

    out = once(df, prompt_tokens=scorers.tokens(infer_prompt(opt_str(F.col("knowledge")), opt_str(F.col("question"))))).withColumn("within_budget", F.col("prompt_tokens") <= max_prompt_tokens)
    issues = F.when(F.col("within_budget"), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"Infer prompt exceeds max_prompt_tokens={max_prompt_tokens}.")))
    out = out.withColumn("source_prefilter", F.struct(F.col("prompt_tokens").alias("infer_prompt_tokens"), F.col("within_budget").alias("prompt_within_budget"), issues.alias("issues")))
    if not nli:
        return out.withColumn("kept", F.col("within_budget"))
    checked = only_where(out.drop("nli_prefilter"), (F.col("answerability_label") == "unanswerable") & F.col("within_budget"), lambda x: unsupported(x, cfg, scorers))
    return checked.withColumn("kept", F.col("within_budget") & F.coalesce(F.col("nli_prefilter.keep"), F.lit(True)))


def prefilter_metrics(df: DataFrame, *keys: str) -> DataFrame:
    """The counters of :func:`prefilter`: rows in, kept and dropped, dropped for their prompt, and checked,
    kept, dropped and checked twice (yes or no) as unanswerable."""
    checked, kept = F.col("nli_prefilter").isNotNull(), F.col("kept")
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(
        F.count("*").alias("num_input"), count_true(kept).alias("num_kept"), count_true(~kept).alias("num_dropped"), count_true(~F.col("within_budget")).alias("num_drop_prompt_budget"),
        count_true(checked).alias("num_unanswerable_checked"), count_true(checked & kept).alias("num_unanswerable_kept"), count_true(checked & ~kept).alias("num_unanswerable_nli_drop"), count_true(F.col("nli_prefilter.used_flipped")).alias("num_unanswerable_yes_no_checked"),
    )


def supported(scores: Column, cfg: VerifierSettings = VerifierSettings()) -> Column:
    return (scores["entail"] >= cfg.entail) & (scores["contradict"] <= cfg.contradict)


def verified(df: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected", skip_empty: bool = True, cfg: VerifierSettings = VerifierSettings(), scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    """One row per answer field: ``key, field, supported, deviation``. A chosen answer should be
    supported, a rejected one not. An empty rejected answer is skipped, or fails the job."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), opt_str(F.col(f)).alias("answer")) for f in (chosen, rejected) if f in df.columns])).alias("x")
    rows = df.select(key, "knowledge", "question", pairs).select(key, "knowledge", "question", "x.*")
    if not skip_empty:
        rows = rows.withColumn("answer", F.when(F.col("answer") != "", F.col("answer")).otherwise(F.raise_error(F.lit("empty answer")).cast("string")))
    rows = rows.where("answer <> ''").withColumn("_s", scorers.nli(qa_premise(F.col("knowledge"), F.col("question")), F.col("answer")))
    ok = supported(F.col("_s"), cfg)
    return rows.select(key, "field", F.col("_s").alias("scores"), ok.alias("supported"), F.when(F.col("field") == chosen, ~ok).otherwise(ok).alias("deviation"))


def deviation_report(rows: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Deviations by field and per row of origin; a rate over nothing is 0."""
    by_row = rows.groupBy(key).agg(F.bool_or("deviation").alias("any"), F.count_if(F.col("field") == chosen).alias("nc"), F.count_if(F.col("field") == rejected).alias("nr"), F.count_if((F.col("field") == chosen) & F.col("deviation")).alias("dc"), F.count_if((F.col("field") == rejected) & F.col("deviation")).alias("dr"))
    n, nc, nr, dc, dr, any_ = F.count("*"), F.sum("nc"), F.sum("nr"), F.sum("dc"), F.sum("dr"), F.count_if("any")
    z = lambda c: F.coalesce(c, F.lit(0))
    return by_row.agg(n.alias("num_rows"), z(nc).alias("num_chosen"), z(nr).alias("num_rejected"), z(dc).alias("chosen_deviation"), z(dr).alias("rejected_deviation"), any_.alias("rows_with_deviation"), rate_zero(dc, nc).alias("chosen_rate"), rate_zero(dr, nr).alias("rejected_rate"), rate_zero(any_, n).alias("row_rate"))

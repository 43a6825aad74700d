"""Validation of structured candidates: checks, hard and soft results, selection, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import scorers as S
from ..functions.coerce import count_true, once, only_where, opt_str
from ..functions.text import canonical_json
from ..session import cut_lineage
from .judge import judged_outputs, semantic_fail
from .protocol import checked, parse
from .selection import best_candidates, first_valid, selection_score, with_terciles


def candidates(df: DataFrame, per_label: dict[str, int] | None = None) -> DataFrame:
    """Each example as many times as its label asks for (3 answerable, 1 unanswerable), numbered by
    ``candidate_id`` from 0; other labels none."""
    n = F.lit(0)
    for label, k in (per_label or {"answerable": 3, "unanswerable": 1}).items():
        n = F.when(F.col("answerability_label") == label, F.lit(k)).otherwise(n)
    return df.withColumn("_n", n).where("_n > 0").withColumn("candidate_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def canonical_output(o: Column, confidence: Column | None = None) -> Column:
    """Canonical JSON of a parsed output, with another confidence where one is given."""
    return canonical_json(o["answerability"], F.transform(o["evidence"], lambda e: e["quote"]), o["rationale"], o["answer"], o["confidence"] if confidence is None else confidence)


def validated(rows: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT, semantics: bool = True, reject_aware: bool = False, drop_negative: bool = True) -> DataFrame:
    """Candidates with their reports, ``hard_fail_reasons, hard_pass, selection_score``, whether
    ``selected``, and the ``derived_confidence`` of the selected, which also replaces the model's own in
    their ``parsed_output`` and ``canonical_output``.

    Rows with a generation error are dropped; another label than the two fails the job. Answerable rows
    pass if the output parses as answerable and protocol, budget, evidence and, where there is a reference,
    correctness hold and semantics don't fail; the best is selected and labelled by its margin's tercile.
    Unanswerable rows pass on parsing, protocol, budget and label; the first valid is selected, labelled by
    reversed terciles of the prefilter score. Budgets are of the canonical output, also after labelling.
    Every row keeps its reports. ``rows`` need ``_ord``, a total order; sorted by it they are in input order."""
    ok = rows.where("not coalesce(generation_error, false)") if "generation_error" in rows.columns else rows
    kind = F.col("answerability_label")
    known = F.when(kind.isin("answerable", "unanswerable"), kind).otherwise(F.raise_error(F.concat(F.lit("Unsupported answerability label: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    done = checked(parse(ok.withColumn("answerability_label", known)), cfg.protocol, cfg.token_f1)
    done = once(done, canonical_output=F.when(F.col("parse_ok"), canonical_output(F.col("parsed_output"))))
    done = _measured(done, cfg, scorers)
    if semantics:
        done = only_where(done, (kind == "answerable") & F.col("protocol_ok"), lambda x: judged_outputs(x, cfg.judge, scorers, "reject" if reject_aware else "full"))
    else:
        done = done.withColumn("semantic", F.lit(None).cast("struct<decision:string,margin:double,issue:string>"))
    fail = (kind == "answerable") & semantic_fail(F.col("semantic.decision"), reject_aware, semantics and drop_negative)
    missed = lambda c, text: F.when(F.col(f"{c}.ok") == F.lit(False), text)
    # fixed values: what the reasons say
    reasons = F.concat(
        F.when(F.col("parse_ok"), F.array().cast("array<string>")).otherwise(F.array("parse_error")),
        F.coalesce("protocol_issues", F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(F.col("completion_over_budget"), f"Canonical completion exceeds max_completion_tokens={cfg.protocol.max_completion_tokens}."),
            F.when(F.col("parsed_output.answerability") != kind, "Predicted answerability does not match the target label."),
            F.when(kind == "answerable", missed("evidence", "Evidence quotes are not substrings of the knowledge.")),
            F.when(kind == "answerable", missed("correct", "Answer does not match the reference answer strongly enough.")),
            F.when(fail, F.when(opt_str(F.col("semantic.issue")) != "", F.col("semantic.issue")).otherwise("Semantic verifier rejected the sample.")),
        )),
    )
    done = done.withColumns({
        "hard_fail_reasons": reasons, "margin": F.when(kind == "answerable", F.col("semantic.margin")), "support_rate": F.col("support.match_rate"), "token_f1": F.col("correct.token_f1"), "evidence_count": F.size("parsed_output.evidence"),
    }).withColumn("hard_pass", F.size("hard_fail_reasons") == 0)
    done = done.withColumn("selection_score", F.when(kind == "answerable", selection_score(F.col("margin"), F.col("support_rate"), F.col("token_f1"), F.col("evidence_count"))))
    done = cut_lineage(done)  # scored once: the ranking and the result read it
    score = F.col("nli_prefilter.score") if "nli_prefilter" in done.columns else F.col("prefilter_score") if "prefilter_score" in done.columns else F.lit(None).cast("double")
    slim = done.select("id", "_ord", "answerability_label", "candidate_id", "margin", "support_rate", "token_f1", "evidence_count", "hard_pass", score.alias("score"))
    best = with_terciles(best_candidates(slim.where(kind == "answerable")), "margin")
    first = with_terciles(first_valid(slim.where(kind == "unanswerable")), "score", reverse=True)
    picked = best.select("_ord", F.lit(True).alias("selected"), "derived_confidence").unionByName(first.select("_ord", F.lit(True).alias("selected"), "derived_confidence"))
    out = done.join(picked, "_ord", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    o, own = F.col("parsed_output"), F.col("derived_confidence")
    relabelled = lambda x: _measured(once(x, canonical_output=canonical_output(o, own)).withColumn("parsed_output", o.withField("confidence", own)), cfg, scorers)
    return only_where(out, F.col("selected") & own.isNotNull(), relabelled)


def _measured(df: DataFrame, cfg: Settings, scorers: S.Scorers) -> DataFrame:
    tokens = F.when(F.col("canonical_output").isNotNull(), scorers.tokens(F.col("canonical_output")))
    return df.withColumn("completion_tokens", tokens).withColumn("completion_over_budget", F.coalesce(F.col("completion_tokens") > cfg.protocol.max_completion_tokens, F.lit(False)))


def validation_metrics(df: DataFrame, *keys: str) -> DataFrame:
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(
        F.count("*").alias("num_rows"), count_true(F.col("parse_ok")).alias("num_parse_ok"), count_true(F.col("protocol_ok")).alias("num_protocol_ok"), count_true(F.col("evidence.ok")).alias("num_evidence_ok"),
        count_true(F.col("correct.ok")).alias("num_correct"), count_true(F.col("semantic.decision") == "yes").alias("num_semantic_yes"), count_true(F.col("hard_pass")).alias("num_hard_pass"), count_true(F.col("selected")).alias("num_selected"),
    )


def error_log(df: DataFrame, prompt: str = "prompt", limit: int = 500) -> DataFrame:
    """The failed calls, with the head of their prompt."""
    return df.where("not ok").select(*[c for c in ("call_index", "model_tag", "error_type", "error_message") if c in df.columns], F.substring(F.col(prompt), 1, limit).alias("prompt_preview"))


def usable(parse_ok: Column, protocol_ok: Column) -> Column:
    return F.coalesce(parse_ok & protocol_ok, F.lit(False))

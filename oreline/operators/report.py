"""Report joins: curves with losses, checkpoint choice, test summaries, merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SelectionSettings
from ..functions.coerce import count_true, high_if_missing, low_if_missing, mean, opt_str, rate, safe_int
from .evaluate import MODEL_KEY
from .order import first_per


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in order: what a lookup table built row by row would hold."""
    return first_per(df, keys, [-F.col(order)])


def with_losses(curve: DataFrame, losses: DataFrame, keys: list[str] = MODEL_KEY, order: str = "_ord") -> DataFrame:
    """Curve rows with ``mean_loss, num_used_rows`` of the last loss row of their key."""
    last = last_per_key(losses, keys, order).select(*keys, "mean_loss", "num_used_rows")
    return curve.join(last, keys, "left")


def constraint_pass(cfg: SelectionSettings = SelectionSettings()) -> Column:
    def good(c: str, least: float) -> Column:
        v = F.col(c).cast("double")
        return F.coalesce(~F.isnan(v) & (v >= least), F.lit(False))

    return good("parse_ok_rate", cfg.parse_ok) & good("protocol_ok_rate_given_parse_ok", cfg.protocol_ok) & good("evidence_substring_rate_on_usable_pred_answerable", cfg.evidence_ok)


def select_checkpoint(curve: DataFrame, cfg: SelectionSettings = SelectionSettings(), order: str = "_ord") -> DataFrame:
    """One row: the best checkpoint among those that meet the constraints, else among all but ``base``;
    by correctness, answerability, semantics, loss (lowest) and step (lowest), then first in order.

    ``curve`` comes from :func:`with_losses`. A curve without checkpoints gives no row."""
    rows = curve.where(opt_str(F.col("model_tag")) != "base").withColumn("constraint_satisfied", constraint_pass(cfg))
    by = [
        (~F.col("constraint_satisfied")).cast("int"), -low_if_missing(F.col("e2e_reviewed_correctness_success_rate")), -low_if_missing(F.col("e2e_answerability_accuracy")),
        -low_if_missing(F.col("e2e_semantic_success_rate")), high_if_missing(F.col("mean_loss")), F.coalesce("model_step", F.lit(0)), F.col(order),
    ]
    best = first_per(rows.withColumn("_one", F.lit(1)), ["_one"], by).drop("_one")
    return best.withColumns({"num_candidates": rows.agg(F.count("*")).scalar(), "num_constraint_pass": rows.agg(F.count_if("constraint_satisfied")).scalar()})


def validation_summary(curve: DataFrame, selected: DataFrame, cfg: SelectionSettings = SelectionSettings()) -> DataFrame:
    """Checkpoint rows with the constraint and whether their path is the selected one's."""
    mark = selected.select(F.col("model_path"), F.lit(True).alias("selected_best"))
    return curve.where(opt_str(F.col("model_tag")) != "base").withColumn("constraint_satisfied", constraint_pass(cfg)).join(F.broadcast(mark), "model_path", "left").withColumn("selected_best", F.coalesce("selected_best", F.lit(False)))


def sample_key(df: DataFrame) -> Column:
    """Source and sample: the sample id, or the id where that is 0, null or empty."""
    sample = opt_str(F.col("sample_id"), zero=True)
    own = opt_str(F.col("id")) if "id" in df.columns else F.lit("")
    return F.struct(opt_str(F.col("source_id")).alias("source"), F.when(sample != "", sample).otherwise(own).alias("sample"))


def test_summary(curve: DataFrame, details: DataFrame, deep: DataFrame, keys: list[str] = MODEL_KEY, order: str = "_ord") -> DataFrame:
    """Curve rows with the hallucination results: counts over the model's own cases, and end-to-end
    passes over its detail rows (unanswerable rows pass when their answerability does)."""
    last = first_per(deep.withColumn("_s", sample_key(deep)), [*keys, "_s"], [-F.col(order)]).select(*keys, "_s", F.col("success").alias("deep_success"))
    d = details.withColumn("_s", sample_key(details)).join(last, [*keys, "_s"], "left")
    gate = F.col("source_is_answerable") & F.col("e2e_answerability_success")
    passed = F.when(F.col("source_is_unanswerable"), F.col("e2e_answerability_success")).when(gate, F.coalesce("deep_success", F.lit(False))).otherwise(F.lit(False))
    per = d.groupBy(*keys).agg(
        F.count("*").alias("_n"), count_true(gate).alias("_gate"), count_true(gate & F.col("deep_success").isNotNull()).alias("_scored"), count_true(passed).alias("num_e2e_deepeval_success"),
        count_true(gate & ~F.col("source_is_unanswerable") & F.col("deep_success")).alias("num_answerable_deepeval_success"),
    )
    cases = deep.groupBy(*keys).agg(F.count("*").alias("deepeval_num_cases"), F.count("success").alias("deepeval_num_scored"), count_true(F.col("success")).alias("deepeval_pass_count"), count_true(opt_str(F.col("error")) != "").alias("deepeval_num_errors"), mean(F.when(~F.isnan("score"), F.col("score"))).alias("deepeval_hallucination_score_mean"))
    out = curve.join(per, keys, "left").join(cases, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    ans = F.when(F.isnan(F.col("num_source_answerable").cast("double")), 0).otherwise(F.coalesce(F.col("num_source_answerable").cast("int"), F.lit(0)))
    return out.withColumns({
        "deepeval_num_cases": z("deepeval_num_cases"), "deepeval_num_scored": z("deepeval_num_scored"), "deepeval_pass_count": z("deepeval_pass_count"), "deepeval_num_errors": z("deepeval_num_errors"),
        "deepeval_hallucination_score_mean": F.coalesce("deepeval_hallucination_score_mean", F.lit(float("nan"))), "num_e2e_deepeval_success": z("num_e2e_deepeval_success"), "num_answerable_deepeval_success": z("num_answerable_deepeval_success"),
    }).withColumns({
        "deepeval_scored_rate": rate(F.col("deepeval_num_scored"), F.col("deepeval_num_cases")), "deepeval_pass_rate_on_scored": rate(F.col("deepeval_pass_count"), F.col("deepeval_num_scored")),
        "deepeval_scored_rate_on_answerable_gate": rate(z("_scored"), z("_gate")), "e2e_deepeval_pass_rate": rate(F.col("num_e2e_deepeval_success"), z("_n")), "answerable_deepeval_pass_rate": rate(F.col("num_answerable_deepeval_success"), ans),
    }).drop("_n", "_gate", "_scored")


def merged_curves(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All tables on the first one's columns as text, missing and empty values ``nan``, sorted by track,
    numeric step, variant and path."""
    columns = first.columns
    out = None
    for df in (first, *others):
        one = df.select(*[(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("nan")) if c in df.columns else F.lit("nan")).alias(c) for c in columns])
        out = one if out is None else out.unionByName(one)
    sort = [c for c in ("eval_track", "model_step", "eval_variant", "model_path") if c in columns]
    return out.orderBy(*[safe_int(F.col(c)) if c == "model_step" else F.col(c) for c in sort])


def stacked(*tables: DataFrame) -> DataFrame:
    """Union of tables with different columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def enriched(details: DataFrame, siblings: DataFrame, order: str = "_ord") -> DataFrame:
    """Detail rows with the columns only their generation has, and question, knowledge and reference
    answer filled from it where empty. The row's own columns win otherwise, even when null."""
    keys = ["source_id", *MODEL_KEY]
    ident = lambda df: [(F.coalesce(F.col(k), F.lit(0)).cast("string") if k == "model_step" else F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_{k}") for k in keys if k in df.columns]
    use = [k for k in keys if k in details.columns and k in siblings.columns]
    side = siblings.select(*[c for c in ident(siblings)], *[F.col(c).alias(f"s_{c}") for c in siblings.columns])
    side = first_per(side, [f"_{k}" for k in use], [-F.col(f"s_{order}")])
    main = details.select(*ident(details), *[F.col(c) for c in details.columns])
    out = main.join(side.drop(*[f"_{k}" for k in keys if k not in use]), [f"_{k}" for k in use], "left")
    filled = [c for c in ("question", "knowledge", "reference_answer") if c in details.columns and c in siblings.columns]
    cols = [(F.when(opt_str(F.col(c)) != "", F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) if c in filled else F.col(c)) for c in details.columns]
    return out.select(*cols, *[F.col(f"s_{c}").alias(c) for c in siblings.columns if c not in details.columns])

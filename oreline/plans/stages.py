"""The stages as functions from DataFrames to DataFrames; :mod:`oreline.cli` reads and writes around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, resolve
from ..functions import prompts
from ..functions import scorers as S
from ..functions.coerce import first_non_empty, opt_str
from ..functions.text import sanitized
from ..operators import calibrate, dataset, evaluate, judge, report, source, validate
from ..operators.protocol import checked, extraction, parse
from ..sources.files import with_position


def tag(train: DataFrame, validation: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Both sources, tagged with their splits."""
    both = train.withColumn("hotpot_source_split", F.lit("train")).unionByName(validation.withColumn("hotpot_source_split", F.lit("validation")))
    return source.tagged(both, cfg.splits)


def build(tagged: DataFrame, cfg: Settings = DEFAULTS, parity: bool = False) -> DataFrame:
    return source.examples(tagged, cfg.construct, cfg.negatives, parity)


def prefilter(examples: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    return judge.prefilter(examples, cfg.protocol.max_prompt_tokens, scorers=scorers).where("kept")


def generate(examples: DataFrame, call: Callable, per_label: dict[str, int] | None = None, model: str = "model", prompt: Callable | None = None, retry: S.Retry = S.Retry(), seed: int = 42) -> DataFrame:
    """Candidates of every example with the outcome of their calls to the teacher, under the teacher's prompt
    (``prompt``: a function of knowledge, question and reference answer); failures stay as rows. Every call
    has a seed of its own, numbered over all candidates."""
    jobs = with_position(validate.candidates(examples, per_label), "_call")
    text = (prompt or prompts.teacher_prompt)(opt_str(F.col("knowledge")), opt_str(F.col("question")), opt_str(F.col("reference_answer")))
    out = S.generate(jobs.withColumns({"prompt": text, "prompt_style": F.lit("teacher_v1"), "teacher_model": F.lit(model)}), call, retry=retry, seed=seed, index="_call").drop("_call")
    return out.withColumnRenamed("text", "raw_output").withColumn("generation_error", ~F.col("ok"))


def generate_structured(items: DataFrame, specs: list[dict], load: Callable, mode: str = "infer", k: int = 0, batch: int = 32, track: str | None = None, variant: str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Every item through every local model, parsed and checked once: ``raw_output, attempt_count,
    protocol_passed, generation_failed`` beside the item's columns and the model key."""
    track, variant = prompts.new_labels(mode, track, variant)
    text = prompts.prompt_of(mode, F.col("knowledge"), F.col("question"), F.col("reference_answer"), F.col("prompt") if "prompt" in items.columns else None, k)
    jobs = S.jobs(items.withColumn("prompt", text), specs).withColumns({"eval_track": F.lit(track), "eval_variant": F.lit(variant), "prompt_mode": F.lit(mode)})
    out = S.generate_batches(jobs, load, batch=batch).withColumn("raw_output", sanitized(F.col("text")))
    done = checked(parse(out.withColumn("supporting_sentences", F.array().cast("array<struct<sentence:string>>")) if "supporting_sentences" not in out.columns else out), cfg.protocol)
    passed = F.coalesce(F.col("parse_ok") & F.col("protocol_ok"), F.lit(False))
    return done.withColumns({"protocol_passed": passed, "generation_failed": ~passed}).drop("text", "parsed_output", "parse_ok", "parse_error", "protocol_issues", "protocol_ok", "evidence", "support", "correct")


def generate_answers(items: DataFrame, specs: list[dict], load: Callable, thinking: bool = False, batch: int = 32, encourage_refusal: bool = True) -> DataFrame:
    """Every item through every local model under the flat prompt: ``answer`` beside the item's columns."""
    text = prompts.answer_prompt(opt_str(F.col("knowledge")), F.col("question"), encourage_refusal)
    jobs = S.jobs(items.withColumn("prompt", text), specs).withColumns({"eval_track": F.lit("base_task"), "eval_variant": F.lit("think" if thinking else "no_think"), "enable_thinking": F.lit(thinking)})
    return S.generate_batches(jobs, load, batch=batch).withColumn("answer", sanitized(F.col("text"))).drop("text")


def extract_answers(rows: DataFrame, call: Callable, attempts: int = 2, retry: S.Retry = S.Retry(retries=4, concurrency=8)) -> DataFrame:
    """Flat rows with the extractor's verdict on their answers; answers it can't be parsed for are asked again."""

    def once(part: DataFrame) -> DataFrame:
        asked = part.withColumn("_asked", prompts.extraction_prompt(opt_str(F.col("question")), opt_str(F.col("answer"))))
        out = S.generate(asked, call, "_asked", retry).withColumn("_e", extraction(F.col("text")))
        return out.select(*part.columns, F.col("text").alias("extraction_text"), F.col("_e.ok").alias("extraction_parse_ok"))

    keep = [c for c in rows.columns if c not in ("extraction_text", "extraction_parse_ok")]
    return S.retry_failed(rows.select(*keep), once, "extraction_parse_ok", attempts).drop("extraction_parse_ok")


def validate_candidates(candidates: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT, semantics: bool = True) -> DataFrame:
    rows = candidates if "_ord" in candidates.columns else with_position(candidates)
    return validate.validated(rows, cfg, scorers, semantics)


def records(validated: DataFrame) -> DataFrame:
    """Training records of the selected rows, which have all passed."""
    return dataset.records(validated.where("selected and hard_pass"))


def prepare(rows: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT) -> DataFrame:
    return dataset.prepared(rows if "_ord" in rows.columns else with_position(rows), cfg.prepare, scorers)


def evaluate_structured(rows: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT, samples: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Details and metrics per model."""
    key = F.coalesce(F.nullif(opt_str(F.col("source_id")), F.lit("")), opt_str(F.col("id")))
    details = evaluate.structured_details(evaluate.sampled(rows, key, samples, seed), cfg, scorers)
    return details, evaluate.structured_metrics(details)


def evaluate_flat(rows: DataFrame, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT) -> tuple[DataFrame, DataFrame]:
    details = evaluate.flat_details(rows, cfg, scorers)
    return details, evaluate.flat_metrics(details)


def choose(curve: DataFrame, losses: DataFrame, cfg: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The validation table and the selected checkpoint."""
    joined = report.with_losses(curve, losses)
    best = report.select_checkpoint(joined, cfg.selection)
    return report.validation_summary(joined, best, cfg.selection), best


def calibrated(rows: DataFrame, keys: list[str], temperatures: list[float] | None = None, margins: list[float] | None = None, cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fitted temperatures, the statistics of every setting and the best setting per group; flat and
    structured rows are one family, matcher rows are searched over their thresholds. Grids not given are the settings'."""
    c = cfg.calibration
    temperatures, margins = resolve(temperatures, calibrate.values("", *c.temperatures)), resolve(margins, calibrate.values("", *c.margins))
    nli = rows.where(F.col("task_type").isin("nli_flat", "nli_structured")).withColumn("task_type", F.lit("nli"))
    scored = nli.withColumn("_s", scorers.nli(F.col("premise_text"), F.col("hypothesis_text"))).select("*", "_s.*").drop("_s")
    fits = calibrate.fit_temperature(scored, keys, temperatures)
    reject = [calibrate.values("", *c.confidences), calibrate.values("", *c.bands)] if c.reject_search else []
    grid = calibrate.settings_grid(rows.sparkSession, margins, *reject)
    search = calibrate.searched(calibrate.apply_temperature(scored, fits, keys), grid, keys, c)
    text = lambda *cs: first_non_empty(*[F.col(x) for x in cs if x in rows.columns])
    match = scorers.match(text("question"), text("reference_answer"), text("pack_answer", "answer"))
    matched = calibrate.matcher_search(rows.where("task_type = 'matcher'").withColumn("match_score", match), keys, calibrate.values("", *c.matcher_thresholds)).withColumn("method", F.lit("matcher_threshold"))
    best = [calibrate.best_setting(x, keys, c.objective) for x in (search, matched)]
    return fits, search.unionByName(matched, allowMissingColumns=True), best[0].unionByName(best[1], allowMissingColumns=True)

"""The whole evaluation of a trained model as tables: losses, validation curve, checkpoint choice, the four test
tracks with their hallucination results, and the two summaries. Models are functions made on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULTS, Settings
from ..functions import scorers as S
from ..functions.coerce import opt_str
from ..operators import evaluate, report
from ..operators.evaluate import MODEL_KEY
from ..session import cut_lineage
from ..sources import fs, sinks
from ..sources.files import with_position
from . import stages

THRESHOLD = 0.5


def loss_details(rows: DataFrame, specs: list[dict], load: Callable, batch: int = 16) -> DataFrame:
    """``rows(prompt, completion)`` with both texts under every model: ``nll, num_tokens``. ``load(path)`` gives a
    function from lists of prompts and completions to (nll, tokens) pairs; a model is loaded once a task."""
    jobs = S.jobs(rows.where((opt_str(F.col("prompt")) != "") & (opt_str(F.col("completion")) != "")), specs)
    schema = StructType(jobs.schema.fields + StructType.fromDDL("nll double, num_tokens int").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, score = None, None
        for pdf in batches:
            for name, group in pdf.groupby("model_path", sort=False):
                if score is None or name != path:
                    path, score = name, load(name)
                pairs = [x for at in range(0, len(group), batch) for x in score(list(group["prompt"][at : at + batch]), list(group["completion"][at : at + batch]))]
                yield pd.concat([group.reset_index(drop=True), pd.DataFrame(pairs, columns=["nll", "num_tokens"])], axis=1)

    spread = jobs.repartition("model_path", F.pmod(F.xxhash64("prompt"), F.lit(64))).sortWithinPartitions("model_path")
    return spread.mapInPandas(run, schema)


def hallucination_cases(rows: DataFrame, source: str = "answer", order: str = "_ord") -> DataFrame:
    """The cases of a hallucination judge: generated rows that have an answer, a question and knowledge."""
    return evaluate.generated_rows(rows, source, order)


def lexical_hallucination(cases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``cases`` with ``score, success, error``: the share of the answer's words that the knowledge lacks, by the
    default entailment scorer; a case passes at or below the threshold."""
    score = 1 - S.lexical_nli(F.col("knowledge"), F.col("answer"))["entail"]
    return cases.withColumns({"score": score, "success": score <= threshold, "error": F.lit(None).cast("string")})


def test_tables(tracks: list[tuple[DataFrame, DataFrame, DataFrame]], keys: list[str] = MODEL_KEY) -> DataFrame:
    """The test summary of several tracks, each its curve, its details and its hallucination details."""
    curve = report.stacked(*[t[0] for t in tracks])
    flags = ["source_id", "sample_id", "source_is_answerable", "source_is_unanswerable", "e2e_answerability_success"]
    details = report.stacked(*[t[1].select(*keys, *[c for c in ("id",) if c in t[1].columns], *flags) for t in tracks])
    deep = report.stacked(*[t[2].select(*keys, *[c for c in ("id",) if c in t[2].columns], "source_id", "sample_id", "score", "success", "error", "_ord") for t in tracks])
    return report.test_summary(curve, details, deep, keys)


def run(
    validation: DataFrame, test: DataFrame, losses: DataFrame, checkpoints: list[dict], base: dict, load: Callable, extract: Callable, judge: Callable[[DataFrame], DataFrame] = lexical_hallucination,
    cfg: Settings = DEFAULTS, scorers: S.Scorers = S.DEFAULT, batch: int = 32, k: int = 2,
) -> dict[str, DataFrame]:
    """All tables of the report by name.

    ``validation`` and ``test`` are generation items, ``losses`` the rows of :func:`loss_details` for the
    checkpoints. Checkpoints answer the validation items; the chosen one, and the base model with worked
    examples and as a flat model with and without thinking, answer the test items. No items, or no
    checkpoint, raise."""
    if validation.isEmpty() or test.isEmpty():
        raise ValueError("no items to generate for")
    out: dict[str, DataFrame] = {}
    tracks = []

    def structured(name: str, items: DataFrame, specs: list[dict], mode: str, shots: int = 0) -> DataFrame:
        made = with_position(cut_lineage(stages.generate_structured(items, specs, load, mode, shots, batch, cfg=cfg)))  # generated once
        details = cut_lineage(evaluate.structured_details(made, cfg, scorers))  # scored once
        out[f"{name}_generations"], out[f"{name}_details"] = made, details
        out[f"{name}_curve"] = cut_lineage(evaluate.structured_metrics(details))
        out[f"{name}_confidence"] = evaluate.confidence_analysis(details)[0]
        return made

    curve_of = lambda name: with_position(out[f"{name}_curve"])
    structured("validation", validation, checkpoints, "infer")
    out["loss_curve"] = with_position(cut_lineage(evaluate.loss_metrics(losses.withColumns({"eval_track": F.lit("sft_structured"), "eval_variant": F.lit("checkpoint")}))))
    joined = report.with_losses(curve_of("validation"), out["loss_curve"])
    out["selection"] = cut_lineage(report.select_checkpoint(joined, cfg.selection))
    best = out["selection"].first()
    if best is None:
        raise ValueError("no checkpoint to select")
    out["validation_summary"] = report.validation_summary(joined, out["selection"], cfg.selection)
    chosen = {"model_tag": best.model_tag, "model_step": best.model_step, "model_path": best.model_path}
    for name, spec, mode, shots in (("best_checkpoint", chosen, "infer", 0), ("base_protocol", base, "teacher_fewshot", k)):
        made = structured(name, test, [spec], mode, shots)
        parsed = stages.parse(made).where("parse_ok")
        deep = out[f"{name}_hallucination"] = cut_lineage(judge(hallucination_cases(parsed, "rationale_plus_answer")))
        tracks.append((out[f"{name}_curve"], out[f"{name}_details"], deep))
    for thinking in (False, True):
        name = f"base_task_{'think' if thinking else 'no_think'}"
        made = out[f"{name}_generations"] = with_position(cut_lineage(stages.extract_answers(cut_lineage(stages.generate_answers(test, [base], load, thinking, batch)), extract)))
        details = out[f"{name}_details"] = cut_lineage(evaluate.flat_details(made, cfg, scorers))
        out[f"{name}_curve"] = cut_lineage(evaluate.flat_metrics(details))
        deep = out[f"{name}_hallucination"] = cut_lineage(judge(hallucination_cases(made)))
        tracks.append((out[f"{name}_curve"], details, deep))
    out["test_summary"] = test_tables(tracks)
    return out


def write(tables: dict[str, DataFrame], folder: str) -> dict:
    """Curves and summaries as CSV, all else as JSON lines, and a manifest with their places."""
    places = {}
    for name, df in tables.items():
        small = name.endswith(("_curve", "_summary")) or name == "selection"
        places[name] = fs.join(folder, name + (".csv" if small else ""))
        if small:
            sinks.write_csv(places[name], df, one_file=True)
        else:
            sinks.write_jsonl(df, places[name])
    chosen = tables["selection"].first() if "selection" in tables else None
    manifest = {"tables": places, "selection": chosen.asDict() if chosen else None}
    sinks.manifest(fs.join(folder, "manifest.json"), **manifest)
    return manifest

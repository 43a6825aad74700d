"""``python -m oreline.cli STAGE --in PATH... --out PATH``: one stage, JSON lines in and out."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from . import schemas
from .config import resolved
from .operators import calibrate, evaluate, judge, report, source, validate
from .plans import full_report, stages
from .session import build_session, cut_lineage
from .sources import files, scans, sinks

VERSION = "0.1.0"
STAGES = (
    "version", "tag", "build", "prefilter", "partition", "generate", "validate", "records", "prepare", "structured", "flat", "hallucination", "losses",
    "validation-summary", "test-summary", "report", "merge", "pack", "calibrate", "verify",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="oreline", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--in", dest="inputs", nargs="+", default=[])
    p.add_argument("--out")
    p.add_argument("--metrics-out")
    p.add_argument("--samples", type=int, default=0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--no-semantics", action="store_true")
    p.add_argument("--details", nargs="*", default=[], help="details of the curves (test-summary), loss curves (validation-summary), test and loss rows (report)")
    p.add_argument("--deep", nargs="*", default=[], help="hallucination details of the curves (test-summary)")
    p.add_argument("--call", help="module:function for the teacher's (generate) or the extractor's calls (report)")
    p.add_argument("--load", help="module:function that loads a local model (report)")
    p.add_argument("--base", default="base", help="path of the base model (report)")
    p.add_argument("--adapters", help="folder or list of checkpoints (report)")
    p.add_argument("--checkpoint-dir", help="folder shared by all executors, where lineage is cut")
    p.add_argument("--master", default="local[*]")
    return p


def named(spec: str | None):
    """The function behind ``module:function``."""
    module, _, name = (spec or "").partition(":")
    if not module or not name:
        raise SystemExit("a function is given as module:function")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.stage == "version":
        print(VERSION)
        return 0
    if not a.inputs or not a.out:
        parser().error("--in and --out are needed")
    spark = build_session(a.master, **({"spark__checkpoint__dir": a.checkpoint_dir} if a.checkpoint_dir else {}))
    read = lambda schema: files.read_jsonl(spark, a.inputs, schema)
    metrics = None
    if a.stage == "tag":
        out = stages.tag(files.read_jsonl(spark, a.inputs[0], schemas.RAW), files.read_jsonl(spark, a.inputs[1], schemas.RAW))
        metrics = source.split_counts(out, "data_split", "answerability_split", "hotpot_source_split")
    elif a.stage == "build":
        out = stages.build(read(schemas.TAGGED))
        metrics = source.split_counts(out, "answerability_label", "data_split", "answerability_split")
    elif a.stage == "prefilter":
        checked = judge.prefilter(read(schemas.EXAMPLE))
        out, metrics = checked.where("kept"), judge.prefilter_metrics(checked)
    elif a.stage == "generate":
        d = resolved({}, "teacher")
        out = stages.generate(read(schemas.PREFILTERED), named(a.call), {"answerable": d["answerable_candidates"], "unanswerable": d["unanswerable_candidates"]}, seed=a.seed)
    elif a.stage == "partition":
        metrics = sinks.write_partitioned(read(schemas.EXAMPLE), a.out)
        out = None
    elif a.stage == "validate":
        out = cut_lineage(stages.validate_candidates(files.with_position(read(schemas.CANDIDATE)), semantics=not a.no_semantics)).orderBy("_ord")
        metrics = validate.validation_metrics(out, "answerability_label")
    elif a.stage == "records":
        rows = read(schemas.VALIDATED)
        out = stages.records(rows)
        metrics = evaluate.stage_counts(rows, out)
    elif a.stage == "prepare":
        sinks.write_splits(stages.prepare(files.with_position(read(schemas.RECORD))).withColumnRenamed("data_split", "split"), a.out)
        out = None
    elif a.stage == "structured":
        out, metrics = stages.evaluate_structured(read(schemas.STRUCTURED), samples=a.samples, seed=a.seed)
    elif a.stage == "flat":
        out, metrics = stages.evaluate_flat(read(schemas.FLAT))
    elif a.stage == "hallucination":
        out = evaluate.hallucination_metrics(read(schemas.HALLUCINATION))
    elif a.stage == "losses":
        out = evaluate.loss_metrics(read(schemas.LOSS))
    elif a.stage == "validation-summary":
        curve, losses = (report.stacked(*[files.read_csv(spark, x) for x in paths]) for paths in (a.inputs, a.details))
        numbers = lambda df: files.with_position(df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in df.columns if c not in evaluate.MODEL_KEY}).withColumn("model_step", F.expr("try_cast(model_step as int)")))
        table, best = stages.choose(numbers(curve), numbers(losses))
        sinks.write_csv(a.out, table.drop("_ord"), one_file=True)
        out, metrics = None, best.drop("_ord")
    elif a.stage == "test-summary":
        curve = report.stacked(*[files.read_csv(spark, x) for x in a.inputs]).withColumn("model_step", F.expr("try_cast(model_step as int)"))
        details, deep = files.read_jsonl(spark, a.details, schemas.DETAILS), files.with_position(files.read_jsonl(spark, a.deep, schemas.HALLUCINATION))
        sinks.write_csv(a.out, report.test_summary(curve, details, deep), one_file=True)
        out = None
    elif a.stage == "report":
        if len(a.details) != 2:
            parser().error("report needs --details TEST LOSS_ROWS")
        items = [scans.generation_items(files.read_jsonl(spark, x, schemas.ITEM), a.seed, a.samples) for x in (a.inputs, a.details[0])]
        base, load = {"model_tag": "base", "model_step": 0, "model_path": a.base}, named(a.load)
        specs = [r.asDict() for r in files.model_specs(spark, adapters=a.adapters).collect()]
        rows = files.read_jsonl(spark, a.details[1], schemas.LOSS)
        metrics = None
        full_report.write(full_report.run(*items, rows, specs, base, load, named(a.call)), a.out)
        out = None
    elif a.stage == "merge":
        tables = [files.read_csv(spark, x) for x in a.inputs]
        sinks.write_csv(a.out, report.merged_curves(*tables), one_file=True)
        out = None
    elif a.stage == "pack":
        rows = files.read_jsonl(spark, a.inputs, schemas.MIXED, provenance=True)
        out = calibrate.annotation_pack(rows.withColumn("_key", F.sha1(F.to_json(F.struct(*rows.columns)))), "pack", "_key", a.samples or resolved({}, "annotation")["samples_per_task"], a.seed)
        metrics = calibrate.pack_counts(out)
    elif a.stage == "calibrate":
        rows = scans.annotation_rows(read(schemas.ANNOTATED), a.seed, a.samples)
        _, metrics, out = stages.calibrated(rows, ["task_type"])
    else:
        out = judge.verified(read(schemas.VERIFY), "id")
        metrics = judge.deviation_report(out, "id")
    if out is not None:
        sinks.write_jsonl(out, a.out)
    if metrics is not None and a.metrics_out:
        sinks.write_json(metrics, a.metrics_out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import report_models  # noqa: E402

from oreline import cli  # noqa: E402
from oreline.config import PRESETS, preset_of_mode, resolved  # noqa: E402
from oreline.plans import full_report  # noqa: E402
from oreline.sources import files  # noqa: E402

ITEM = {"id": "i", "source_id": "s", "question": "Who built it?", "knowledge": "Ann Berg built it", "reference_answer": "Ann Berg", "answerability_label": "answerable"}


def rows(n):
    return [{**ITEM, "id": f"i{k}", "source_id": f"s{k}", "answerability_label": "unanswerable" if k == 0 else "answerable"} for k in range(n)]


def put(path, items):
    path.write_text("".join(json.dumps(r) + "\n" for r in items), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("report")
    spark.sparkContext.addPyFile(report_models.__file__)
    for k in (4, 9):
        (folder / f"checkpoint-{k}").mkdir()
    specs = [{"model_tag": f"checkpoint-{k}", "model_step": k, "model_path": p} for k, p in ((4, "bad-4"), (9, "good-9"))]
    loss = full_report.loss_details(spark.createDataFrame([("p", "a b"), ("p", " "), ("q", "c")], "prompt string, completion string"), specs, report_models.nll)
    from oreline.sources import scans

    items = [scans.generation_items(spark.createDataFrame(rows(n)), 1) for n in (4, 3)]
    made = full_report.run(*items, loss, specs, {"model_tag": "base", "model_step": 0, "model_path": "base"}, report_models.load, report_models.extract)
    return full_report.write(made, str(folder / "out")), folder


def test_report_tables(spark, tables):
    manifest, folder = tables
    read = lambda name: files.read_csv(spark, manifest["tables"][name]).collect()
    assert {r.num_used_rows for r in read("loss_curve")} == {"2"} and len(read("loss_curve")) == 2
    assert read("selection")[0].model_path == "good-9" and {r.model_path: r.selected_best for r in read("validation_summary")} == {"bad-4": "false", "good-9": "true"}
    s = {(r.eval_track, r.eval_variant): r for r in read("test_summary")}
    assert set(s) == {("sft_structured", "checkpoint"), ("base_protocol", "fewshot"), ("base_task", "no_think"), ("base_task", "think")}
    best, flat = s["sft_structured", "checkpoint"], s["base_task", "think"]
    assert (best.num_rows, best.num_source_answerable, best.deepeval_num_cases) == ("3", "2", "3") and int(best.num_answerable_deepeval_success) <= 2
    assert (flat.deepeval_pass_count, flat.num_e2e_deepeval_success) == ("3", "2")
    assert json.loads((folder / "out" / "manifest.json").read_text())["selection"]["model_step"] == 9
    with pytest.raises(ValueError):
        full_report.run(spark.range(0), spark.range(1), spark.range(1), [], {}, report_models.load, report_models.extract)


def test_report_stages_of_the_command_line(spark, tables, tmp_path, monkeypatch):
    manifest, folder = tables
    t, at = manifest["tables"], lambda name: str(tmp_path / name)
    assert cli.main(["validation-summary", "--in", t["validation_curve"], "--details", t["loss_curve"], "--out", at("vs"), "--metrics-out", at("best.json"), "--master", "local[4]"]) == 0
    assert json.loads((tmp_path / "best.json").read_text())["model_path"] == "good-9" and files.read_csv(spark, at("vs")).count() == 2
    assert cli.main(["test-summary", "--in", t["best_checkpoint_curve"], "--details", t["best_checkpoint_details"], "--deep", t["best_checkpoint_hallucination"], "--out", at("ts"), "--master", "local[4]"]) == 0
    got, want = files.read_csv(spark, at("ts")).first(), next(r for r in files.read_csv(spark, t["test_summary"]).collect() if r.eval_track == "sft_structured")
    assert (got.deepeval_num_cases, got.num_e2e_deepeval_success) == (want.deepeval_num_cases, want.num_e2e_deepeval_success)
    seen = {}

    def run(validation, test, losses, specs, base, load, extract):
        seen.update(n=(validation.count(), test.count(), losses.count()), specs=[x["model_step"] for x in specs], load=load, base=base["model_path"])
        return {"test_summary": spark.range(1)}

    monkeypatch.setattr(full_report, "run", run)
    val, test, loss = put(tmp_path / "v.jsonl", rows(3)), put(tmp_path / "t.jsonl", rows(2)), put(tmp_path / "l.jsonl", [{"model_tag": "checkpoint-9", "model_step": 9, "model_path": "x", "nll": 2.0, "num_tokens": 1}])
    assert cli.main(["report", "--in", val, "--details", test, loss, "--load", "report_models:load", "--call", "report_models:extract", "--adapters", str(folder), "--base", "b", "--out", at("r"), "--master", "local[4]"]) == 0
    assert seen == {"n": (3, 2, 1), "specs": [4, 9], "load": report_models.load, "base": "b"} and files.read_csv(spark, at("r/test_summary.csv")).count() == 1
    with pytest.raises(SystemExit):
        cli.named("nothing")


def test_presets():
    assert resolved({"seed": 0, "split": None, "mine": 1}, "structured_eval")["seed"] == 0 and resolved({"split": None}, "structured_eval")["split"] == "validation"
    assert resolved({"include_base": False}, "base_protocol")["include_base"] is False and preset_of_mode("teacher_fewshot") == "base_protocol" and preset_of_mode(None) == "structured_eval"
    assert all(resolved({}, p) for p in PRESETS)
    with pytest.raises(ValueError):
        resolved({}, "none")


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from oreline import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Cluster)
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_average_ranks_in_ranges(spark):
    from oreline.operators import selection

    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 1.0, 2.0, 5.0, 5.0, 5.0)] + [("b", 9.0)], "g string, v double").repartition(3)
    got = sorted((r.g, r.v, r.k) for r in selection.average_rank(df, "v", ["g"], "k").collect())
    assert got == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("a", 3.0, 4.0), ("a", 5.0, 6.0), ("a", 5.0, 6.0), ("a", 5.0, 6.0), ("b", 9.0, 1.0)]
    assert selection.average_rank(df.limit(0), "v", ["g"], "k").count() == 0

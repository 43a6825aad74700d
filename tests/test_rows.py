import json
import math
import random
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oreline.config import DEFAULTS, JudgeSettings, resolve
from oreline.functions import coerce, scorers
from oreline.functions import prompts as P
from oreline.functions import text as X
from oreline.operators import calibrate, dataset, evaluate, judge, order, protocol, report, validate
from oreline.plans import stages
from oreline.sources import files, sinks


def test_generation_items_and_rows(spark):
    cols = "_ord bigint, id string, source_id string, question string, prompt string, knowledge string, contexts array<string>, answer string, model_tag string, model_step string, enable_thinking boolean"
    prompt = "x\nKnowledge:\nfrom prompt\n\nQuestion: Asked?\n"
    df = spark.createDataFrame([(0, None, None, "", prompt, None, None, "a", None, "7", True), (1, "i", "s", "Q", None, " ", ["k1", " ", "k2"], " ", "t", "x", False), (2, None, None, None, None, None, None, "a", None, None, None)], cols)
    items = evaluate.generation_items(df).orderBy("sample_id").collect()
    assert [(r.id, r.source_id, r.question, r.knowledge) for r in items] == [("0", "0", "Asked?", "from prompt"), ("i", "s", "Q", "k1\n\nk2")]
    rows = evaluate.generated_rows(df).collect()
    assert len(rows) == 1 and (rows[0].model_tag, rows[0].model_step, rows[0].eval_track, rows[0].eval_variant) == ("model", 7, "base_task", "think")
    both = df.withColumn("parsed_output", F.struct(F.lit("r").alias("rationale"), F.lit("w").alias("answer")))
    assert both.select(evaluate.answer_of(both, "rationale_plus_answer").alias("a")).first().a == "r\nTherefore the answer is w"
    assert {r.eval_variant for r in evaluate.generated_rows(both).collect()} == {"checkpoint"}


def test_permutation_and_seeded_order(spark):
    want = list(range(20))
    random.Random(9).shuffle(want)
    got = order.permuted(spark.range(20).toDF("_ord"), "_ord", 9).orderBy("shuffled").collect()
    assert [r["_ord"] for r in got] == want
    with pytest.raises(ValueError):
        order.permuted(spark.range(20).toDF("_ord"), "_ord", 9, most=5)


def test_small_functions(spark):
    df = spark.createDataFrame([('"plain "',), ('[{"type": "text", "text": "a"}, "b", {"text": ""}]',), ("junk",), (None,)], "m string")
    assert [r[0] for r in df.select(X.chat_content(F.col("m"))).collect()] == ["plain", "a\nb", "", ""]
    one = spark.range(1)
    assert one.select(X.prompt_with("Use {k}, then {q}.", k=F.lit("x"), q=F.lit(None))).first()[0] == "Use x, then ."
    assert abs(one.select(judge.logit(F.lit(0.5))).first()[0]) < 1e-12 and one.select(judge.logit(F.lit(1.0))).first()[0] > 20
    assert resolve(None, 3) == 3 and resolve(0, 3) == 0
    with pytest.raises(ValueError):
        JudgeSettings(temperature=0)
    with pytest.raises(ValueError):
        coerce.require(one, "gone")
    assert [r[0] for r in spark.createDataFrame([("yes",), (" No ",), ("x",)], "a string").select(judge.flip(F.col("a"))).collect()] == ["no", "yes", None]


def test_judge_gate_and_skips(spark):
    df = spark.createDataFrame([("Ann built it in 1900", "When was it built?", "Ann")], "knowledge string, question string, answer string")
    gated = judge.judged(df, JudgeSettings(), scorers.Scorers(entities=lambda c: F.array().cast("array<string>"))).first().judge
    assert gated.supported and gated.full == "no" and gated.reject == "no" and gated.forced_negative
    off = judge.judged(df, JudgeSettings(check_type=False)).first().judge
    assert off.full == "no" and off.answer_type.answer_type_ok is None  # an unchecked type is not consistent
    free = judge.judged(df, JudgeSettings(check_type=False, fail_as_negative=False)).first().judge
    assert free.full == "yes"
    assert judge.judge_metrics(judge.judged(df.limit(0))).first().abstain_rate == 0.0
    o = "parsed_output struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>, question string"
    rows = spark.createDataFrame([(("answerable", [(" ",)], "r", "a", "low"), "q"), (("unanswerable", [], "r", "a", "low"), "q"), (None, "q")], o)
    assert [(r.semantic.decision, r.semantic.issue) for r in judge.judged_outputs(rows).collect()] == [(None, "Semantic check skipped because no valid evidence quotes are available."), (None, ""), (None, "")]
    got = spark.createDataFrame([("no",), ("abstain",), (None,)], "d string").select(judge.semantic_fail(F.col("d")), judge.semantic_fail(F.col("d"), True), judge.semantic_fail(F.col("d"), enabled=False)).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, True, False), (False, False, False)]


def test_pack_stops_at_the_nth_kept(spark):
    p = "struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>"
    rows = [(k, "q", "k", "ref", None if k % 2 else ("answerable", [("e",)], "r", "a", "low"), "t" if k % 2 else None, k % 4 != 1 if k % 2 else None, False if k % 2 else None, "x" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(rows, f"id int, question string, knowledge string, reference_answer string, parsed_output {p}, raw_answer string, extraction_parse_ok boolean, refusal_detected boolean, extracted_answer string")
    full = calibrate.annotation_pack(df, "p", "id", most=0)
    assert {r.task_type: (r.num_kept, r.num_skipped_missing_fields) for r in calibrate.pack_counts(full).collect()} == {"nli_flat": (10, 10), "nli_structured": (20, 0), "matcher": (30, 0)}
    some = {r.task_type: r for r in calibrate.pack_counts(calibrate.annotation_pack(df, "p", "id", most=5)).collect()}
    assert all(r.num_kept == 5 for r in some.values())
    order_ = [r.id for r in df.orderBy(order.seeded(F.col("id"), 42), "id").collect()]
    flat = [k for k in order_ if k % 2]
    cut = [k for k in flat if k % 4 == 3][4]
    assert some["nli_flat"].num_skipped_missing_fields == sum(k % 4 == 1 for k in flat[: flat.index(cut)])


def test_drop_counts_and_retry(spark):
    df = spark.createDataFrame([(None,), ("missing_prompt",), ("prompt_over_budget",)], "drop_reason string")
    r = dataset.drop_counts(df).first()
    assert (r.num_input, r.num_kept, r.num_missing_prompt, r.num_prompt_over_budget) == (3, 1, 1, 1)
    seen = spark.createDataFrame([(1,), (2,)], "k int")
    done = scorers.retry_failed(seen, lambda d: d.withColumn("ok", F.col("k") == 1), "ok", 3).orderBy("k").collect()
    assert [(x.k, x.extraction_attempt_count) for x in done] == [(1, 1), (2, 3)]


def test_choose_enrich_and_calibrate(spark, tmp_path):
    key = "model_tag string, model_step int, model_path string, eval_track string, eval_variant string"
    rates = "parse_ok_rate double, protocol_ok_rate_given_parse_ok double, evidence_substring_rate_on_usable_pred_answerable double, e2e_reviewed_correctness_success_rate double, e2e_answerability_accuracy double, e2e_semantic_success_rate double, _ord bigint"
    curve = spark.createDataFrame([("c", k, f"p{k}", "t", "v", 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, k) for k in (200, 100)], f"{key}, {rates}")
    losses = spark.createDataFrame([], f"{key}, mean_loss double, num_used_rows int, _ord bigint")
    table, best = stages.choose(curve, losses)
    assert best.first().model_step == 100 and {r.model_step: r.selected_best for r in table.collect()} == {100: True, 200: False}
    assert report.select_checkpoint(report.with_losses(curve.where("model_step = 0"), losses)).count() == 0
    d = spark.createDataFrame([("s", "c", 1, "", None, 0)], "source_id string, model_tag string, model_step int, question string, knowledge string, _ord bigint")
    g = spark.createDataFrame([("s", "c", 1, "old", "K0", "x", 0), ("s", "c", 1, "Q", "K", "y", 1)], "source_id string, model_tag string, model_step int, question string, knowledge string, extra string, _ord bigint")
    e = report.enriched(d, g).first()
    assert (e.question, e.knowledge, e.extra) == ("Q", "K", "y")
    a = spark.createDataFrame([("nli_flat", "Ann built it", "Ann", True), ("nli_structured", "Ann built it", "Bob", False), ("nli_flat", "x", "y", None)], "task_type string, premise_text string, hypothesis_text string, human_label_bool boolean")
    fits, search, best = stages.calibrated(a, ["task_type"], [0.5, 1.0], [0.0, 0.5])
    assert fits.count() == 1 and search.count() == 3 and best.first().f1 == 1.0
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "d.json"), "a int").count() == 2
    sinks.write_both(spark.range(2), str(tmp_path / "c"), str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "id bigint").count() == 2
    assert DEFAULTS.token_f1 == 0.85


def test_calibrate_matcher_rows_and_rejection(spark):
    cols = "task_type string, premise_text string, hypothesis_text string, question string, reference_answer string, answer string, pack_answer string, human_label_bool boolean"
    rows = [("nli_flat", "Ann built it", "Ann", "Q", "Ann", None, None, True), ("nli_structured", "Ann built it", "Bob", "Q", "Ann", None, None, False)]
    rows += [("matcher", "", "", "Q", "the old stone mill", None, "old stone mill", True), ("matcher", "", "", "Q", "the old stone mill", "the new mill house", None, False), ("matcher", "", "", "Q", "a", "b", None, None)]
    a = spark.createDataFrame(rows, cols)
    _, search, best = stages.calibrated(a, ["task_type"], [0.5, 1.0], [0.0, 0.5])
    m = search.where("task_type = 'matcher'").collect()
    assert search.count() == 3 + 18 and sorted(r.matcher_threshold for r in m)[::17] == [0.1, 0.95] and {r.num_labeled for r in m} == {2}
    top = {r.task_type: r for r in best.collect()}
    assert set(top) == {"nli", "matcher"} and top["matcher"].f1 == 1.0 and top["matcher"].method == "matcher_threshold" and 0.3 < top["matcher"].matcher_threshold < 0.9
    reject = replace(DEFAULTS, calibration=replace(DEFAULTS.calibration, reject_search=True))
    _, search, _ = stages.calibrated(a, ["task_type"], [0.5, 1.0], [0.0, 0.5], reject)
    assert {r.method: r["count"] for r in search.groupBy("method").count().collect()} == {"argmax": 1, "margin": 2, "argmax_with_reject": 13, "margin_with_reject_band": 14, "matcher_threshold": 18}


def test_calibrate_default_grids(spark):
    c = DEFAULTS.calibration
    temperatures = calibrate.values("", *c.temperatures)
    assert len(temperatures) == 496 and (temperatures[0], temperatures[1], temperatures[-1]) == (0.05, 0.06, 5.0)
    rows = [("nli_flat", "a b c d", h, y) for h, y in (("a", True), ("a x", True), ("a b x", False), ("x", False), ("x", False))]
    fits, search, _ = stages.calibrated(spark.createDataFrame(rows, "task_type string, premise_text string, hypothesis_text string, human_label_bool boolean"), ["task_type"])
    loss = lambda t, e, y: (lambda w: -math.log(min(max(w[0] / sum(w) if y else 1 - w[0] / sum(w), 1e-12), 1 - 1e-12)))([max(p, 1e-12) ** (1 / t) for p in (e, (1 - e) * 0.75, (1 - e) * 0.25)])
    want = min(temperatures, key=lambda t: sum(loss(t, e, y) for e, y in ((1.0, True), (0.5, True), (2 / 3, False), (0.0, False), (0.0, False))))
    assert fits.first().temperature == want and search.count() == 22


def test_batches_with_failures_and_jobs(spark):
    def score(rows):
        if any(r["a"] == "bad" for r in rows):
            raise ValueError("no")
        return [(len(r["a"]) / 10, True) for r in rows]

    df = spark.createDataFrame([("x",), ("bad",), ("yy",)], "a string").coalesce(1)
    got = {r.a: (r.score, r.success, r.error) for r in scorers.score_batches(df, score, ["a"], 2).collect()}
    assert got == {"x": (0.1, True, None), "bad": (None, None, "ValueError: no"), "yy": (0.2, True, None)}
    assert scorers.score_batches(df.limit(0), score, ["a"], 0).count() == 0
    specs = [{"model_tag": "base", "model_step": 0, "model_path": "b"}, {"model_tag": "c", "model_step": 5, "model_path": "p"}]
    assert scorers.jobs(df, specs).count() == 6
    deep = scorers.score_batches(df, score, ["a"]).withColumn("m", F.lit(1))
    m = evaluate.hallucination_metrics(deep, ["m"]).first()
    assert (m.num_cases, m.num_scored, m.num_errors) == (3, 2, 1)


def counting(spark):
    """A scorer and the number of rows it has seen."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("struct<entail:double,neutral:double,contradict:double>")
    def nli(premise: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        seen.add(len(premise))
        return pd.DataFrame({"entail": [0.1] * len(premise), "neutral": 0.2, "contradict": 0.7})

    return scorers.Scorers(nli=nli), seen


def test_only_rows_that_need_it_are_scored(spark):
    cols = "id string, question string, knowledge string, reference_answer string, answerability_label string"
    rows = [(f"a{k}", "Q1", "K", "ref", "answerable") for k in range(19)] + [("u", "Q2", "K", "ref", "unanswerable"), ("long", "Q3", "w " * 600, "ref", "unanswerable")]
    s, seen = counting(spark)
    got = judge.prefilter(spark.createDataFrame(rows, cols), scorers=s).collect()
    assert seen.value == 1 and [r.id for r in got if r.nli_prefilter] == ["u"] and sum(r.kept for r in got) == 20
    s, seen = counting(spark)
    yes = judge.prefilter(spark.createDataFrame([("u", "Q", "K", "Yes", "unanswerable"), ("v", "Q", "K", "ref", "unanswerable")], cols), scorers=s)
    m = judge.prefilter_metrics(yes).first()
    assert (m.num_input, m.num_unanswerable_checked, m.num_unanswerable_kept, m.num_unanswerable_yes_no_checked) == (2, 2, 2, 1)
    s, seen = counting(spark)
    o = "parsed_output struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>, question string"
    out = spark.createDataFrame([(("answerable", [("k",)], "r", "a", "low"), "q")] + [(("unanswerable", [], "r", "a", "low"), "q")] * 9 + [(None, "q")], o)
    assert judge.judged_outputs(out, scorers=s).where("semantic.decision is not null").count() == 1 and seen.value == 1
    flat = spark.createDataFrame([("Ann", True, False, "Ann", "answerable"), ("x", True, True, "", "answerable"), ("y", False, None, "", "unanswerable")], "answer string, extraction_parse_ok boolean, refusal_detected boolean, extracted_answer string, answerability_label string")
    s, seen = counting(spark)
    evaluate.flat_details(flat.withColumns({"question": F.lit("Who?"), "knowledge": F.lit("k"), "reference_answer": F.lit("Ann")}), scorers=s).collect()
    assert seen.value == 1


def test_payload_resolution(spark):
    good = '{"answerability": "unanswerable", "evidence": [], "rationale": "r", "answer": "A", "confidence": "low"}'
    p = "struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>"
    df = spark.createDataFrame([(1, ("answerable", [], "own", "a", "high"), good, None), (2, None, good, None), (3, None, " ", f"so: {good}"), (4, None, "junk", None), (5, None, None, None)], f"k int, parsed_output {p}, raw_output string, answer string")
    got = {r.k: r.parsed_output and r.parsed_output.rationale for r in protocol.payload(df).collect()}
    assert got == {1: "own", 2: "r", 3: "r", 4: None, 5: None}
    assert protocol.payload(df.drop("parsed_output")).where("parsed_output is not null").count() == 3


def test_records_fall_back_on_the_canonical_output(spark):
    good = '{"answerability": "unanswerable", "evidence": [], "rationale": "r", "answer": "A", "confidence": "low"}'
    p = "struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>"
    cols = f"id string, source_id string, data_split string, knowledge string, question string, derived_confidence string, hard_pass boolean, parsed_output {p}, canonical_output string"
    own, broken = ("answerable", [("k",)], "r", "own", "low"), ("answerable", [("",)], "r", "", "sure")
    rows = [("a", own, good, "high"), ("b", None, good, None), ("c", broken, good, None), ("d", None, "junk", None), ("e", broken, None, None), ("f", own, None, None)]
    r = {x.id: x for x in dataset.records(spark.createDataFrame([(i, "s", "test", "k", "q", c, True, o, t) for i, o, t, c in rows], cols)).collect()}
    assert {k: json.loads(x.completion)["answer"] for k, x in r.items()} == {"a": "own", "b": "A", "c": "A"} and json.loads(r["a"].completion)["confidence"] == "high"
    assert r["a"].metadata.validation_report.derived_confidence == "high" and dataset.records(spark.createDataFrame([], cols)).count() == 0


VALIDATED = "_ord bigint, id string, candidate_id int, answerability_label string, raw_output string, knowledge string, question string, reference_answer string, supporting_sentences array<struct<sentence:string>>, prefilter_score double"


def test_selected_rows_carry_the_derived_confidence(spark):
    out = lambda label, answer, quote: json.dumps({"answerability": label, "evidence": [{"quote": quote}] if quote else [], "rationale": "It is said.", "answer": answer, "confidence": "low"})
    refusal = out("unanswerable", "I cannot answer from the provided knowledge.", None)
    rows = [(k, f"u{k}", 0, "unanswerable", refusal, "k", "Q", "", [], k / 10) for k in range(3)] + [(10, "u0", 1, "unanswerable", refusal, "k", "Q", "", [], 0.0)]
    rows += [(20, "a", 0, "answerable", out("answerable", "Ann Berg", "Ann Berg built it"), "Ann Berg built it", "What was it?", "Ann Berg", [], None), (21, "b", 0, "answerable", out("answerable", "Ann Berg", "Ann Berg built it"), "Ann Berg built it", "What was it?", "", [], None)]
    rows += [(22, "c", 0, "answerable", "```json\n" + out("answerable", "Ann Berg", "gone") + "\n``` " + "chatter " * 600, "Ann Berg built it", "What was it?", "Ann Berg", [], None)]
    v = {r._ord: r for r in validate.validated(spark.createDataFrame(rows, VALIDATED), semantics=False).collect()}
    assert [v[k].derived_confidence for k in range(3)] == ["high", "medium", "low"] and not v[10].selected
    assert [v[k].parsed_output.confidence for k in range(3)] == ["high", "medium", "low"] and '"confidence": "high"' in v[0].canonical_output
    assert v[20].hard_pass and v[21].hard_pass and v[21].selected  # without a reference there is nothing to match
    assert v[22].hard_fail_reasons == ["Evidence quotes are not substrings of the knowledge."]  # chatter around the object costs nothing
    tagged = spark.createDataFrame(rows, VALIDATED).withColumns({"source_id": F.lit("s"), "data_split": F.lit("test")})
    r = stages.records(validate.validated(tagged, semantics=False))
    assert sorted((x.id, json.loads(x.completion)["confidence"]) for x in r.collect()) == [("u0", "high"), ("u1", "medium"), ("u2", "low")]
    with pytest.raises(Exception, match="Unsupported answerability label"):
        validate.validated(spark.createDataFrame([(1, "x", 0, "maybe", "", "", "", "", [], None)], VALIDATED), semantics=False).collect()


def test_prompts(spark):
    one = spark.range(1)
    text = lambda c: one.select(c).first()[0]
    t = text(P.teacher_prompt(F.lit("K"), F.lit("Q"), F.lit("R")))
    assert t.startswith("You are preparing") and "10) Preserve the natural answer form when possible.\n\nReference answer:\nR\n\n" in t and t.endswith("Knowledge:\nK\n\nQuestion: Q\n") and '"title": "StructuredQaOutput"' in t
    assert "Reference answer" not in text(P.teacher_prompt(F.lit("K"), F.lit("Q"))) and "10) Return a short sentence." in text(P.teacher_prompt(F.lit("K"), F.lit("Q"), style=F.lit("short_sentence")))
    few = text(P.prompt_of("teacher_fewshot", F.lit("K"), F.lit("Q"), k=2))
    assert few.count("Output:") == 2 and "Example 2" in few and "Example 3" not in few and few.endswith(text(P.teacher_prompt(F.lit("K"), F.lit("Q"))))
    assert P.worked_examples(0) == "" and P.worked_examples(9).count("Output:") == 3 and all(json.loads(P.example_output(e)) for e in P.EXAMPLES)
    assert text(P.prompt_of("infer", F.lit("K"), F.lit("Q"), prompt=F.lit(" own "))) == "own" and text(P.prompt_of("infer", F.lit("K"), F.lit("Q"))) == text(X.infer_prompt(F.lit("K"), F.lit("Q")))
    assert text(P.extraction_prompt(F.lit("Q"), F.lit(None))).endswith("Question: Q\nModel answer:\n\n") and text(P.repair_prompt(F.lit("K"), F.lit("Q"), F.lit("A"))).endswith("Candidate answer:\nA\n\nRevised answer:\n")
    assert text(P.answer_prompt(F.lit("K"), F.lit("Q"))) == "K\nQuestion: Q\nAnswer: " and text(P.answer_prompt(F.lit(""), F.lit("Q"), True)).startswith("Use only")
    assert text(P.question_answer(F.lit(" Q "), F.lit(None))) == "Question: Q\nAnswer: " and P.new_labels("infer") == ("sft_structured", "checkpoint") and P.new_labels("teacher", "t", " ") == ("t", "fewshot")
    with pytest.raises(Exception):
        text(P.answer_prompt(F.lit("K"), F.lit(" ")))
    with pytest.raises(ValueError):
        P.prompt_of("other", F.lit("K"), F.lit("Q"))

    class Plain:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt):
            return f"<user>{messages[0]['content']}</user>"

    assert text(P.chat_prompt(Plain)(F.lit("hi"))) == "<user>hi</user>" and text(P.chat_prompt(object)(F.lit("hi"))) == "hi"

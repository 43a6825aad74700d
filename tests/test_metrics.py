import math

from pyspark.sql import functions as F

from oreline.config import SelectionSettings
from oreline.functions.coerce import label_to_bool
from oreline.operators import calibrate, dataset, evaluate, judge, order, report, selection


def test_terciles_and_order(spark):
    for n, want in {1: "m", 2: "lh", 3: "lmh", 4: "lmmh", 5: "lmmmh", 7: "llmmmhh"}.items():
        df = spark.createDataFrame([(k, float(k // 2)) for k in range(n)], "_ord bigint, v double")
        got = "".join(r[0][0] for r in selection.with_terciles(df, "v").orderBy("_ord").select("derived_confidence").collect())
        assert got == want, n
    df = spark.createDataFrame([(0, None), (1, 5.0)], "_ord bigint, v double")
    assert [r[0] for r in selection.with_terciles(df, "v", reverse=True).orderBy("_ord").select("derived_confidence").collect()] == [None, "medium"]


def test_global_rank_equals_window(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"))
    got = {r.id: (r.rank, r.n) for r in order.global_rank(df, [F.col("v"), F.col("id")], ["g"], total="n").collect()}
    groups = {}
    for k in range(1000):
        groups.setdefault(k % 2 if k % 3 else None, []).append((k * 37 % 101, k))
    want = {k: (i + 1, len(v)) for v in groups.values() for i, (_, k) in enumerate(sorted(v))}
    assert got == want
    assert order.global_rank(df.where("id < 0"), [F.col("id")]).count() == 0


def test_best_candidate_ties(spark):
    cols = "id int, candidate_id int, _ord bigint, margin double, support_rate double, token_f1 double, evidence_count int, hard_pass boolean"
    rows = [(1, 0, 0, 0.5, 1.0, 1.0, 0, True), (1, 1, 1, 0.5, 1.0, 1.0, 3, True), (1, 2, 2, 0.9, 1.0, 1.0, 1, False), (2, 1, 3, None, 0.0, 0.0, 1, True), (2, 0, 4, None, 0.0, 0.0, 1, True), (3, 0, 5, 1.0, 0.0, 0.0, 1, False)]
    df = spark.createDataFrame(rows, cols)
    assert {r.id: r.candidate_id for r in selection.best_candidates(df).collect()} == {1: 1, 2: 0}  # no quotes rank last
    assert {r.id: r.candidate_id for r in selection.first_valid(df).collect()} == {1: 0, 2: 0}


def test_murphy_and_correlations(spark):
    df = spark.createDataFrame([("m", b, float(y), r) for b, r, ys in (("low", 1, (0, 0)), ("medium", 2, (0, 1)), ("high", 3, (1, 1))) for y in ys], "g string, b string, y double, rank int")
    m = selection.murphy(df, ["g"], "b", "y").first()
    assert round(m.resolution, 4) == 0.6667 and m.n == 6
    c = selection.correlations(df, ["g"], "rank", "y").first()
    assert round(c.pearson, 4) == 0.8165 and round(c.spearman, 4) == 0.8165
    flat = selection.correlations(df.withColumn("y", F.lit(1.0)), ["g"], "rank", "y").first()
    assert flat.pearson is None and math.isnan(selection.murphy(df.withColumn("y", F.lit(1.0)), ["g"], "b", "y").first().resolution)


def test_judge_math(spark):
    df = spark.createDataFrame([(0.7, 0.2, 0.1), (1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0)], "entail double, neutral double, contradict double").select(judge.calibrated(F.struct("entail", "neutral", "contradict"), 2.17).alias("c"))
    a, b, c = [r.c for r in df.collect()]
    assert round(a.margin, 9) == round((math.log(0.7) - math.log(0.2)) / 2.17, 9) and round(a.entail + a.neutral + a.contradict, 9) == 1
    assert b.argmax_label == "entail" and b.margin == 0 and c.margin > 12
    rows = spark.createDataFrame([("the sky is blue", "Who?", "yes"), ("yes it is", "q", "yes")], "knowledge string, question string, reference_answer string")
    got = judge.unsupported(rows).collect()
    assert all(r.nli_prefilter.used_flipped for r in got)


def test_binary_and_selective(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True), (True, None)], "p boolean, y boolean").withColumn("g", F.lit(1))
    s = calibrate.selective_stats(df, ["g"], F.col("p"), F.col("y")).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.num_labeled, s.num_kept) == (1, 1, 1, 1, 5, 4) and s.accuracy == 0.5 and s.cohen_kappa == 0.0 and s.coverage == 0.8
    none = calibrate.selective_stats(df.where("y is null"), ["g"], F.col("p"), F.col("y")).first()
    assert math.isnan(none.accuracy) and none.error_kept == 1.0 and math.isnan(none.lagrangian_objective)


def test_grid(spark):
    assert len(calibrate.values("", 0.1, 0.94, 0.07)) == 13 and calibrate.values("2, 1,2") == [1.0, 2.0]
    s = spark.createDataFrame([("t", True, 0.9, 0.9, True), ("t", False, -0.5, 0.8, False), ("t", True, 0.1, 0.5, True)], "g string, human_label_bool boolean, margin double, top_prob double, entail_is_top boolean")
    out = calibrate.searched(s, calibrate.settings_grid(spark, [0.0, 0.5], [0.6], [0.2]), ["g"])
    best = calibrate.best_setting(out, ["g"]).first()
    assert out.count() == 6 and best.method == "argmax" and best.f1 == 1.0  # first on ties
    none = calibrate.fit_temperature(s.select("g", F.lit(None).cast("boolean").alias("human_label_bool"), F.lit(0.5).alias("entail"), F.lit(0.3).alias("neutral"), F.lit(0.2).alias("contradict")), ["g"], [0.5, 1.0]).first()
    assert none.temperature == 1.0 and math.isinf(none.fit_nll)


def test_labels(spark):
    df = spark.createDataFrame([(" YES ",), ("not_equivalent",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(label_to_bool(F.col("t"))).collect()] == [True, False, None, None]


def test_dataset_caps_and_dedup(spark):
    cols = "_ord bigint, id string, data_split string, answerability_label string, prompt string, completion string"
    rows = [(0, "a", "train", "answerable", "p one", "c"), (1, "a", "train", "answerable", "p one", "c"), (2, "b", "train", "answerable", "p two", "c"), (3, "c", "train", "unanswerable", "p", " "), (4, "d", "train", "unanswerable", "w " * 20, "c"), (5, "e", "train", None, "p", "c"), (6, "f", "train", "unanswerable", "p", "c d e")]
    df = spark.createDataFrame(rows, cols)
    u = dataset.deduplicated(df)
    assert sorted(r._ord for r in u.collect()) == [0, 2, 3, 4, 5, 6]
    b = dataset.budgeted(dataset.normalized(u, "train"), 16, 2)
    assert {r._ord: r.drop_reason for r in b.collect()} == {0: None, 2: None, 3: "missing_completion", 4: "prompt_over_budget", 5: None, 6: "completion_over_budget"}
    kept = dataset.capped(b.where("drop_reason is null"), "id", 2, {"answerable": 1, "unanswerable": 1}, shuffle=False)
    assert sorted(r._ord for r in kept.collect()) == [0, 5]
    ids = spark.createDataFrame([([1, 2, 3, 4], [7, 8])], "p array<int>, c array<int>").select(dataset.loss_labels(F.col("p"), F.col("c"), 0, 5).alias("x")).first().x
    assert ids.ids == [3, 4, 7, 8, 0] and ids.labels == [-100, -100, 7, 8, 0]


def test_checkpoint_and_summary(spark):
    c = "model_tag string, model_step int, model_path string, eval_track string, eval_variant string, parse_ok_rate double, protocol_ok_rate_given_parse_ok double, evidence_substring_rate_on_usable_pred_answerable double, e2e_reviewed_correctness_success_rate double, e2e_answerability_accuracy double, e2e_semantic_success_rate double, num_source_answerable int, _ord bigint"
    curve = spark.createDataFrame([("ck", 100, "a", "t", "v", 0.94, 1.0, 1.0, 0.9, 0.9, 0.9, 1, 0), ("ck", 200, "b", "t", "v", 0.96, 0.99, 0.97, 0.5, 0.5, float("nan"), 1, 1), ("base", 0, "c", "t", "v", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 2)], c)
    losses = spark.createDataFrame([("ck", 200, "b", "t", "v", 0.3, 9, 0), ("ck", 200, "b", "t", "v", 0.2, 8, 1)], "model_tag string, model_step int, model_path string, eval_track string, eval_variant string, mean_loss double, num_used_rows int, _ord bigint")
    j = report.with_losses(curve, losses)
    best = report.select_checkpoint(j, SelectionSettings()).first()
    assert best.model_step == 200 and best.mean_loss == 0.2 and best.constraint_satisfied and best.num_candidates == 2 and best.num_constraint_pass == 1
    key = "model_tag string, model_step int, model_path string, eval_track string, eval_variant string, sample_id int, id string, source_id string, _ord bigint"
    details = spark.createDataFrame([("ck", 200, "b", "t", "v", 0, "x", "s", 0, True, False, True), ("ck", 200, "b", "t", "v", 2, "y", "s", 1, False, True, True)], key + ", source_is_answerable boolean, source_is_unanswerable boolean, e2e_answerability_success boolean")
    deep = spark.createDataFrame([("ck", 200, "b", "t", "v", 0, "x", "s", 0, False, 0.4, None)], key + ", success boolean, score double, error string")
    t = report.test_summary(curve.where("model_step = 200"), details, deep).first()
    assert t.e2e_deepeval_pass_rate == 0.5 and t.answerable_deepeval_pass_rate == 0.0 and t.deepeval_scored_rate_on_answerable_gate == 1.0
    m = report.merged_curves(spark.createDataFrame([("t", "10", "")], "eval_track string, model_step string, v string"), spark.createDataFrame([("t", 9)], "eval_track string, model_step int")).collect()
    assert [(r.model_step, r.v) for r in m] == [("9", "nan"), ("10", "nan")]


def test_flat_rates(spark):
    cols = "model_tag string, question string, knowledge string, reference_answer string, answerability_label string, answer string, extraction_parse_ok boolean, refusal_detected boolean, extracted_answer string"
    df = spark.createDataFrame([("m", "Who?", "Alice was there", "Alice", "answerable", "x", False, None, None), ("m", "Who?", "Alice was there", "Alice", "answerable", "Alice", True, False, "Alice")], cols)
    m = evaluate.flat_metrics(evaluate.flat_details(df), ["model_tag"]).first()
    assert m.extraction_parse_ok_rate == 0.5 and m.e2e_answerability_accuracy == 0.5 and m.content_eval_gate_rate == 0.5 and m.e2e_reviewed_correctness_success_rate == 0.5


def test_structured_rates(spark):
    import json

    good = json.dumps({"answerability": "answerable", "evidence": [{"quote": "Alice was there"}], "rationale": "It says so.", "answer": "Alice", "confidence": "high"})
    df = spark.createDataFrame([("m", good, "Who?", "Alice was there", "Alice", "answerable"), ("m", "junk", "Who?", "Alice was there", "Alice", "answerable")], "model_tag string, raw_output string, question string, knowledge string, reference_answer string, answerability_label string")
    m = evaluate.structured_metrics(evaluate.structured_details(df), ["model_tag"]).first()
    assert m.parse_ok_rate == 0.5 and m.protocol_ok_rate_given_parse_ok == 1.0 and m.usable_rate == 0.5 and m.evidence_substring_rate_on_usable_pred_answerable == 1.0 and m.e2e_reviewed_correctness_success_rate == 0.5


def test_groups_in_order_of_their_first_candidate(spark):
    cols = "_ord bigint, id string, candidate_id int, hard_pass boolean, margin double, support_rate double, token_f1 double, evidence_count int"
    rows = [(0, "z", 0, False, 1.0, 1.0, 1.0, 1), (1, "b", 0, True, 0.1, 1.0, 1.0, 1), (2, "z", 1, True, 0.5, 1.0, 1.0, 1), (3, "a", 0, True, 0.2, 1.0, 1.0, 1), (4, "b", 1, True, 0.9, 1.0, 1.0, 1)]
    best = selection.best_candidates(spark.createDataFrame(rows, cols)).orderBy("group_order").collect()
    assert [(r.id, r._ord) for r in best] == [("b", 4), ("z", 2), ("a", 3)]
    assert [r.id for r in selection.first_valid(spark.createDataFrame(rows, cols)).orderBy("group_order").collect()] == ["b", "z", "a"]

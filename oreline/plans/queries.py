"""Queries of the core operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, SelectionSettings
from ..functions import prompts as P
from ..functions import scorers
from ..functions import text as X
from ..functions.coerce import label_to_bool, opt_str, rate, strip
from ..operators import calibrate, dataset, dewey, evaluate, judge, order, protocol, report, selection, source, validate
from ..session import cut_lineage
from ..sources import sinks
from ..sources.tables import table
from . import full_report as report_run
from . import oracle, oracle_rows, stages


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return dewey.dead_links(table(spark, sf, "qa_examples"))


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference with the labels of the context document and the sentence it leads to, or null."""
    return dewey.sentence_links(table(spark, sf, "qa_examples"))


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Number of nodes and of distinct parents in each flat table."""
    tables = dewey.shred(table(spark, sf, "qa_examples"), "rec_id", ["supporting_sentences", "context_documents", "metadata"])
    out = None
    for path, t in tables.items():
        one = t.groupBy("rec_id").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("parents")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("parents"), F.lit(0)).alias("n_parents"), F.count("*").alias("n_records")).select(F.lit(path).alias("path"), "n_nodes", "n_parents", "n_records")
        out = one if out is None else out.unionByName(one)
    return out




def _six(c):
    """Rounded for comparison with another engine."""
    return F.round(c, 6)


def _plain(df: DataFrame) -> DataFrame:
    """Numbers rounded and NaN as null, for comparison with another engine."""
    return df.select(*[_six(F.nanvl(f"`{f.name}`", F.lit(None).cast("double"))).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """qa_examples as raw source rows: parallel arrays of context and supporting facts (null where they are)."""
    q = table(spark, sf, "qa_examples")
    return q.select(
        F.col("rec_id").cast("string").alias("_id"), "question", F.col("reference_answer").alias("answer"), F.col("metadata.question_type").alias("type"), F.col("difficulty").alias("level"),
        F.struct(F.transform("context_documents", lambda d: d["title"]).alias("title"), F.transform("context_documents", lambda d: d["sentences"]).alias("sentences")).alias("context"),
        F.struct(F.transform("supporting_sentences", lambda d: d["title"]).alias("title"), F.transform("supporting_sentences", lambda d: d["sent_id"]).alias("sent_id")).alias("supporting_facts"),
        F.when(F.col("rec_id") % 5 == 0, "validation").otherwise("train").alias("hotpot_source_split"),
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed answers (one row per generation) beside their record."""
    s = table(spark, sf, "structured_outputs").dropDuplicates(["gen_id"])
    q = table(spark, sf, "qa_examples").select("rec_id", "source_id", "question", "knowledge", "reference_answer", F.lower(F.trim("answerability_label")).alias("gold"))
    g = table(spark, sf, "api_generations").select("gen_id", "model_tag", "candidate_id").dropDuplicates(["gen_id"])
    return s.join(q, "rec_id").join(g, "gen_id").withColumn("pred", F.lower(F.trim("answerability")))


def split_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Salted-hash splits of every raw row."""
    return source.tagged(_raw_rows(spark, sf)).select(F.col("_id").alias("id"), "hotpot_source_split", "data_split", "answerability_split")


def restored_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every record coerced to its types."""
    e = source.restored(table(spark, sf, "qa_examples").withColumn("variant_id", F.col("rec_id").cast("string")))
    n = lambda c, f: F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x[f]))
    return e.select(F.col("variant_id").alias("rec_id"), "source_id", "data_split", "answerability_label", "difficulty", F.md5("knowledge").alias("knowledge_md5"), F.size("supporting_sentences").alias("n_supports"), n(F.col("supporting_sentences"), "window_sentences").alias("n_window"), F.size("context_documents").alias("n_documents"), n(F.col("context_documents"), "sentences").alias("n_sentences"))


def split_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return source.split_counts(source.tagged(_raw_rows(spark, sf)), "data_split", "answerability_split", "hotpot_source_split")


def answerable_examples(spark: SparkSession, sf: str) -> DataFrame:
    return source.answerable(_raw_rows(spark, sf)).select(F.col("source_id").alias("id"), "question", "reference_answer", F.size("supports").alias("n_supports"), F.md5("knowledge").alias("knowledge_md5"), F.size("docs").alias("n_docs"))


def prepared_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Answerable examples and derived negatives by variant."""
    e = source.examples(source.tagged(_raw_rows(spark, sf)))
    return e.groupBy("variant_id", "answerability_label", "data_split").agg(F.count("*").alias("n"), F.countDistinct("knowledge").alias("n_knowledge"))


def negative_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Derived negatives with what was replaced."""
    e = source.negatives(source.answerable(source.tagged(_raw_rows(spark, sf))))
    return e.select(F.col("source_id").alias("id"), "origin_track", F.md5("knowledge").alias("knowledge_md5"), F.get("replaced_supports", F.lit(0))["sent_id"].alias("replaced"), F.get("replacement_sentences", F.lit(0))["sent_id"].alias("replacement"), F.get("replacement_sentences", F.lit(0))["title"].alias("title"))


def sentence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The window around every sentence of every context document, as a formatted block."""
    d = table(spark, sf, "qa_examples").select("rec_id", F.posexplode("context_documents").alias("doc", "d"))
    each = d.select("rec_id", "doc", F.col("d.title").alias("title"), F.col("d.sentences").alias("sentences"), F.posexplode("d.sentences").alias("sent", "s"))
    return each.select("rec_id", "doc", "sent", F.md5(source.block(F.coalesce("title", F.lit("")), F.array_join(source.window(F.transform("sentences", lambda x: strip(x)), F.col("sent"), 1), " "))).alias("block_md5"))


def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt tokens of every record, and whether they are within the budget."""
    q = table(spark, sf, "qa_examples")
    tokens = X.word_count(X.infer_prompt(opt_str(F.col("knowledge")), opt_str(F.col("question"))))
    return q.select("rec_id", tokens.alias("prompt_tokens"), (tokens <= DEFAULTS.protocol.max_prompt_tokens).alias("within_budget"))


def prompt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge and question taken out of the prompts built from them."""
    q = table(spark, sf, "qa_examples").select("rec_id", X.infer_prompt(F.col("knowledge"), F.col("question")).alias("prompt"))
    return q.select("rec_id", X.split_prompt(F.col("prompt")).alias("p")).select("rec_id", F.md5("p.knowledge").alias("knowledge_md5"), F.col("p.question").alias("question"))


def partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.partition_counts(table(spark, sf, "qa_examples"))


def candidate_fanout(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "qa_examples").withColumn("answerability_label", F.lower(F.trim("answerability_label")))
    return validate.candidates(q).select("rec_id", "answerability_label", "candidate_id")


def error_log(spark: SparkSession, sf: str) -> DataFrame:
    """Failed calls with the head of their question as the prompt."""
    g = table(spark, sf, "api_generations").join(table(spark, sf, "qa_examples").select("rec_id", F.col("question").alias("prompt")), "rec_id")
    return validate.error_log(g)


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Token sums per model, counted by the provider or else estimated by words."""
    return evaluate.token_usage(table(spark, sf, "api_generations"), ["model_tag"])


def question_types(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "qa_examples")
    return q.select("rec_id", X.question_type(F.col("question")).alias("question_type"), X.has_year(F.coalesce("reference_answer", F.lit(""))).alias("has_year"))


def extracted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of every document, by lookarounds SQL engines without them can't express."""
    return table(spark, sf, "documents").select("doc_id", X.numbers(F.coalesce("text", F.lit(""))).alias("numbers"))


def normalized_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "qa_examples").select("rec_id", X.normalized_answer(F.col("question")).alias("normalized"))


def canonical_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.canonical(F.col("text")).alias("canonical"))


def sanitized_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Local generations wrapped as chat transcripts with a think block, and cleaned again."""
    g = table(spark, sf, "local_generations").where("text is not null").select("gen_id", "text").distinct()
    wrapped = F.concat(F.lit("user\nWhat is it?\nassistant\n<think>\nwell,\n</think>\n"), "text")
    return g.select("gen_id", X.sanitized(wrapped).alias("sanitized"))


def answer_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Exact match and token F1 of every structured answer with its reference."""
    c = protocol.correctness(F.col("answer"), F.col("reference_answer"))
    return _answers(spark, sf).where("answer is not null and reference_answer is not null").select("gen_id", c.alias("c")).select("gen_id", F.col("c.ok").alias("ok"), F.col("c.exact_match").alias("exact_match"), _six(F.col("c.token_f1")).alias("token_f1"))


def evidence_match(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes found in the knowledge with white space collapsed."""
    a = _answers(spark, sf).where("evidence is not null and knowledge is not null").withColumns({"q": protocol.normalized_quotes(F.filter("evidence", lambda e: e.isNotNull())), "k": X.collapse(F.col("knowledge"))})
    r = protocol.evidence_report(F.col("q"), F.col("k"))
    return a.select("gen_id", r.alias("r")).select("gen_id", F.col("r.ok").alias("ok"), _six(F.col("r.match_rate")).alias("match_rate"), F.col("r.unique_quotes").alias("unique_quotes"), F.col("r.outside").alias("outside"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "api_generations").where("ok and prompt_style = 'structured'").dropDuplicates(["gen_id"])
    return protocol.parse(g, "text")


def parsed_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Structured API texts parsed strictly: every generation with its outcome and fields."""
    o = F.col("parsed_output")
    return _parsed(spark, sf).select("gen_id", "parse_ok", o["answerability"].alias("answerability"), o["confidence"].alias("confidence"), F.size(o["evidence"]).alias("n_quotes"), F.md5(o["rationale"]).alias("rationale_md5"), F.md5(o["answer"]).alias("answer_md5"))


def protocol_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Protocol issues of the parsed API texts, one row each."""
    p = _parsed(spark, sf).where("parse_ok")
    o = F.col("parsed_output")
    issues = protocol.protocol_issues(o, X.collapse(o["rationale"]), X.collapse(o["answer"]))
    return p.select("gen_id", F.explode(issues).alias("issue"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Structured answers with entailment scores against the knowledge and a label."""
    a = _answers(spark, sf).where("answer is not null and knowledge is not null and pred is not null")
    s = scorers.lexical_nli(F.col("knowledge"), F.col("answer"))
    return a.withColumn("s", s).select("gen_id", "model_tag", F.col("s.entail").alias("entail"), F.col("s.neutral").alias("neutral"), F.col("s.contradict").alias("contradict"), (F.col("pred") == "answerable").alias("human_label_bool"))


def judge_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated margins and decisions of every structured answer."""
    c = judge.calibrated(F.struct("entail", "neutral", "contradict"), DEFAULTS.judge.temperature)
    d = _scored(spark, sf).withColumn("c", c)
    full, reject = judge.full_decision(F.col("c.margin"), DEFAULTS.judge), judge.reject_decision(F.col("c.margin"), DEFAULTS.judge)
    return d.select("gen_id", _six(F.col("c.margin")).alias("margin"), _six(F.col("c.entail")).alias("p_entail"), F.col("c.argmax_label").alias("argmax_label"), full.alias("full"), F.when(reject.isNull(), "abstain").when(reject, "yes").otherwise("no").alias("reject"))


def judge_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision counts per model with the answer-type check."""
    a = _answers(spark, sf).where("answer is not null and knowledge is not null")
    return judge.judge_metrics(judge.judged(a), "model_tag")


def answer_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """Reference answers that the knowledge should support, and parsed refusals that it shouldn't."""
    a = _answers(spark, sf).where("knowledge is not null").select("gen_id", "knowledge", "question", F.col("reference_answer").alias("chosen"), F.when(F.col("pred") == "unanswerable", F.col("answer")).alias("rejected"))
    return judge.deviation_report(judge.verified(a, "gen_id"), "gen_id")


def source_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt budget and support check of every record: its counters by label."""
    q = table(spark, sf, "qa_examples").withColumn("answerability_label", F.lower(F.trim("answerability_label")))
    return judge.prefilter_metrics(judge.prefilter(q), "answerability_label")


def prefiltered_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its prompt tokens, the support check's result and score, and whether it is kept."""
    p = judge.prefilter(table(spark, sf, "qa_examples").withColumn("answerability_label", F.lower(F.trim("answerability_label"))))
    return p.select("rec_id", "prompt_tokens", "kept", F.col("nli_prefilter.decision").alias("decision"), _six(F.col("nli_prefilter.score")).alias("score"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """API generations as ranked candidates of their record, with stand-ins for the soft results."""
    g = table(spark, sf, "api_generations").where("ok and text is not null").dropDuplicates(["gen_id"])
    return g.select(
        F.col("rec_id").alias("id"), "candidate_id", F.col("gen_id").alias("_ord"), (F.length("text") > 3).alias("hard_pass"),
        F.when(F.col("token_usage").isNotNull(), F.round((F.col("token_usage.completion_tokens") % 17) / 10.0, 6)).alias("margin"), F.round((F.length("text") % 4) / 4.0, 6).alias("support_rate"),
        F.round((F.length("text") % 7) / 7.0, 6).alias("token_f1"), (F.length("text") % 5).alias("evidence_count"),
    )


def best_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return selection.best_candidates(_candidates(spark, sf)).select("id", "candidate_id", F.col("_ord").alias("gen_id"), "margin", "group_order")


def first_valid(spark: SparkSession, sf: str) -> DataFrame:
    return selection.first_valid(_candidates(spark, sf)).select("id", "candidate_id", F.col("_ord").alias("gen_id"), "group_order")


def confidence_terciles(spark: SparkSession, sf: str) -> DataFrame:
    """Terciles of the margin over all candidates, from a distributed rank."""
    return selection.with_terciles(_candidates(spark, sf), "margin").select(F.col("_ord").alias("gen_id"), "margin", "derived_confidence")


def reverse_terciles(spark: SparkSession, sf: str) -> DataFrame:
    return selection.with_terciles(_candidates(spark, sf), "margin", reverse=True).select(F.col("_ord").alias("gen_id"), "derived_confidence")


def token_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman of prompt and completion tokens per model."""
    g = table(spark, sf, "api_generations").select("model_tag", F.col("token_usage.prompt_tokens").alias("x"), F.col("token_usage.completion_tokens").alias("y"))
    c = selection.correlations(g, ["model_tag"], "x", "y")
    return c.select("model_tag", _six(F.col("pearson")).alias("pearson"), _six(F.col("spearman")).alias("spearman"), "n")


def confidence_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Murphy resolution of matching answerability over confidence levels per model."""
    a = _answers(spark, sf).where("gold is not null").select("model_tag", F.lower("confidence").alias("confidence"), (F.col("pred") == F.col("gold")).cast("double").alias("y")).where("confidence is not null and y is not null")
    m = selection.murphy(a, ["model_tag"], "confidence", "y")
    return m.select("model_tag", _six(F.nanvl("resolution", F.lit(None).cast("double"))).alias("resolution"), "n")


def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).where("gold is not null").select("model_tag", F.lower("confidence").alias("confidence"), (F.col("pred") == F.col("gold")).cast("double").alias("y"))
    b = selection.buckets(a, ["model_tag"], "confidence", evaluate.LEVELS, accuracy="y")
    return b.select("model_tag", "confidence", "n", _six(F.nanvl("accuracy", F.lit(None).cast("double"))).alias("accuracy"))


def deduplicated_records(spark: SparkSession, sf: str) -> DataFrame:
    """The first delivery of every record by its composite key."""
    q = table(spark, sf, "qa_examples").select("rec_id", "id", "source_id", "variant_id", "answerability_label", "question", "knowledge", "reference_answer")
    return dataset.deduplicated(q, "rec_id").select("rec_id")


def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At most 60 answerable and 40 unanswerable records, then at most 90 in all, in seeded order."""
    q = table(spark, sf, "qa_examples").withColumn("answerability_label", F.lower(F.trim("answerability_label")))
    return dataset.capped(q, "rec_id", 90, {"answerable": 60, "unanswerable": 40}, seed=42, order="rec_id").select("rec_id", "answerability_label")


def prepared_training_set(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated, normalised, budgeted and capped records by split and label."""
    q = table(spark, sf, "qa_examples").withColumn("_ord", F.col("rec_id")).withColumns({"data_split": F.lower(F.trim("data_split")), "completion": F.col("reference_answer"), "answerability_label": F.lower(F.trim("answerability_label"))})
    p = dataset.prepared(q.select("_ord", "id", "source_id", "variant_id", "data_split", "answerability_label", "question", "knowledge", "reference_answer", "completion"))
    return p.groupBy("data_split", "answerability_label").agg(F.count("*").alias("n"), F.max("prompt_tokens").alias("max_prompt_tokens"))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """Structured candidates of the records with a label, validated, selected and labelled."""
    g = table(spark, sf, "api_generations").where("prompt_style = 'structured'").dropDuplicates(["gen_id"]).select(F.col("gen_id").alias("_ord"), "rec_id", "candidate_id", "model_tag", (~F.col("ok")).alias("generation_error"), F.col("text").alias("raw_output"))
    label = F.lower(F.trim("answerability_label"))
    q = table(spark, sf, "qa_examples").withColumn("answerability_label", label).where(label.isin("answerable", "unanswerable"))
    q = q.select("rec_id", F.col("rec_id").alias("id"), "source_id", "data_split", "question", "knowledge", "reference_answer", "answerability_label", "difficulty", "answerability_split", "supporting_sentences", F.col("metadata.nli_prefilter.score").alias("prefilter_score"))
    return validate.validated(g.join(q, "rec_id"))


def validated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every validated candidate with its checks, whether it is selected, and its confidence."""
    v = _validated(spark, sf)
    return v.select(
        F.col("_ord").alias("gen_id"), "model_tag", "parse_ok", "hard_pass", F.size("hard_fail_reasons").alias("n_reasons"), "completion_tokens", _six(F.col("margin")).alias("margin"), _six(F.col("support_rate")).alias("support_rate"),
        _six(F.col("token_f1")).alias("token_f1"), "selected", "derived_confidence", F.col("parsed_output.confidence").alias("confidence"), F.md5("canonical_output").alias("canonical_md5"),
    )


def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validation_metrics(_validated(spark, sf), "model_tag", "answerability_label")


def training_records(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt and canonical completion of the selected candidates."""
    v = _validated(spark, sf)
    r = stages.records(v)
    return r.select("id", "data_split", F.md5("prompt").alias("prompt_md5"), F.md5("completion").alias("completion_md5"), F.col("target_structured.confidence").alias("confidence"), F.col("metadata.answerability_label").alias("answerability_label"))


def selective_answerability(spark: SparkSession, sf: str) -> DataFrame:
    """Binary and selective statistics of predicted against gold answerability per model; low
    confidence rejects."""
    a = _answers(spark, sf)
    pred = F.when(F.lower("confidence") != "low", F.col("pred") == "answerable")
    s = calibrate.selective_stats(a, ["model_tag"], pred, F.col("gold") == "answerable")
    cols = ["coverage", "reject_rate", "accuracy", "precision", "recall", "f1", "cohen_kappa", "lagrangian_objective"]
    return s.select("model_tag", "num_rows", "num_labeled", "num_kept", "tp", "tn", "fp", "fn", *[_six(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in cols])


def temperature_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Best temperature per model on a grid of 40."""
    f = calibrate.fit_temperature(_scored(spark, sf), ["model_tag"], calibrate.values("", 0.25, 10.0, 0.25))
    return f.select("model_tag", F.round("temperature", 2).alias("temperature"), _six(F.col("fit_nll")).alias("fit_nll"))


def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of every margin, confidence and band setting per model."""
    s = _scored(spark, sf).withColumn("temperature", F.lit(DEFAULTS.judge.temperature))
    c = judge.calibrated(F.struct("entail", "neutral", "contradict"), F.col("temperature"))
    s = s.withColumn("c", c).select("model_tag", "human_label_bool", F.round("c.margin", 9).alias("margin"), F.round("c.argmax_prob", 9).alias("top_prob"), (F.col("c.argmax_label") == "entail").alias("entail_is_top"))
    grid = calibrate.settings_grid(spark, calibrate.values("", -0.95, 1.05, 0.2), calibrate.values("", 0.45, 0.95, 0.1), calibrate.values("0.07,0.23"))
    out = calibrate.searched(s, grid, ["model_tag"])
    return out.select("model_tag", "ordinal", "method", "num_kept", "tp", "tn", "fp", "fn", _six(F.nanvl("f1", F.lit(None).cast("double"))).alias("f1"))


def best_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Best setting per model over the default temperatures and margins."""
    s, c = _scored(spark, sf), DEFAULTS.calibration
    fits = calibrate.fit_temperature(s, ["model_tag"], calibrate.values("", *c.temperatures))
    scored = calibrate.apply_temperature(s, fits, ["model_tag"])
    grid = calibrate.settings_grid(spark, calibrate.values("", *c.margins))
    b = calibrate.best_setting(calibrate.searched(scored, grid, ["model_tag"]), ["model_tag"])
    return b.select("model_tag", "ordinal", "method", "margin_threshold", _six(F.col("f1")).alias("f1"))


def matcher_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of matcher thresholds on token F1."""
    a = _answers(spark, sf).where("answer is not null and reference_answer is not null and gold is not null").select("model_tag", F.round(X.token_f1(F.col("answer"), F.col("reference_answer")), 9).alias("match_score"), (F.col("gold") == "answerable").alias("human_label_bool"))
    m = calibrate.matcher_search(a, ["model_tag"], calibrate.values("", 0.11, 0.91, 0.2))
    return m.select("model_tag", "ordinal", "num_labeled", "tp", "tn", "fp", "fn", _six(F.nanvl("f1", F.lit(None).cast("double"))).alias("f1"))


def human_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by vocabulary: confidence words stand for annotations."""
    s = table(spark, sf, "structured_outputs").select(F.coalesce("answerability", F.lit("")).alias("task_type"), F.when(F.lower("confidence") == "high", " Yes ").when(F.lower("confidence") == "low", "mismatch").otherwise("maybe").alias("human_label"))
    return calibrate.label_summary(s)


def annotation_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of an annotation pack from structured and flat rows, by task."""
    a = _answers(spark, sf)
    parsed = F.struct("pred", "evidence", "rationale", "answer", "confidence").cast("struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>")
    s = a.select("gen_id", "question", "knowledge", "reference_answer", parsed.alias("parsed_output"), F.lit("structured").alias("input_source_path"))
    q = table(spark, sf, "qa_examples").select("rec_id", "question", "knowledge", "reference_answer")
    f = table(spark, sf, "local_generations").dropDuplicates(["gen_id"]).join(q, "rec_id").select("gen_id", "question", "knowledge", "reference_answer", F.col("text").alias("raw_answer"), F.col("text").alias("extracted_answer"), F.col("text").isNotNull().alias("extraction_parse_ok"), F.lit(False).alias("refusal_detected"), F.lit("flat").alias("input_source_path"))
    return calibrate.pack_counts(calibrate.annotation_pack(report.stacked(s, f), "pack", "gen_id"), "task_type", "input_source_path")


def structured_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All structured metrics per model over the API's raw outputs."""
    return _plain(evaluate.structured_metrics(_structured(spark, sf), ["model_tag"]))


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "api_generations").where("ok and prompt_style = 'structured'").dropDuplicates(["gen_id"]).select("gen_id", "rec_id", "model_tag", F.col("text").alias("raw_output"))
    q = table(spark, sf, "qa_examples").select("rec_id", "source_id", "question", "knowledge", "reference_answer", F.lower(F.trim("answerability_label")).alias("answerability_label"), "supporting_sentences")
    return evaluate.structured_details(g.join(q, "rec_id"))


def structured_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of confidence with the outcomes per model."""
    return _plain(evaluate.confidence_analysis(_structured(spark, sf), ["model_tag"])[0])


def flat_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All flat metrics per model."""
    return _plain(evaluate.flat_metrics(_flat(spark, sf), ["model_tag"]))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """Flat details; the extractor's output is made of the text itself."""
    g = table(spark, sf, "local_generations").dropDuplicates(["gen_id"])
    q = table(spark, sf, "qa_examples").select("rec_id", "question", "knowledge", "reference_answer", F.lower(F.trim("answerability_label")).alias("answerability_label"))
    text = F.coalesce(g["text"], F.lit(""))
    refused = F.lower(text).rlike("cannot|unable|impossible|not enough|does not say|no answer")
    payload = F.when(strip(text) != "", F.to_json(F.struct(F.substring_index(text, ". ", 1).alias("short_answer"), refused.alias("refusal_detected"))))
    return evaluate.flat_details(g.withColumns({"extraction_text": payload, "answer": text}).drop("id").join(q, "rec_id"))


def teacher_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The teacher's prompt of every record, with its reference answer where it has one."""
    text = P.teacher_prompt(opt_str(F.col("knowledge")), opt_str(F.col("question")), opt_str(F.col("reference_answer")))
    return table(spark, sf, "qa_examples").select("rec_id", F.md5(text).alias("prompt_md5"), X.word_count(text).alias("prompt_tokens"))


def extraction_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The extractor's prompt of every flat answer."""
    g = table(spark, sf, "local_generations").dropDuplicates(["gen_id"]).select("gen_id", "rec_id", "text")
    q = table(spark, sf, "qa_examples").select("rec_id", "question")
    return g.join(q, "rec_id").select("gen_id", F.md5(P.extraction_prompt(opt_str(F.col("question")), opt_str(F.col("text")))).alias("prompt_md5"))


def full_report(spark: SparkSession, sf: str) -> DataFrame:
    """The test summary of two recorded tracks, structured and flat, with the default hallucination scorer."""
    key = ["model_tag", "eval_track"]
    s = cut_lineage(_structured(spark, sf).withColumns({"eval_track": F.lit("sft_structured"), "sample_id": F.col("gen_id")}))  # read by metrics, details and cases
    f = cut_lineage(_flat(spark, sf).withColumns({"eval_track": F.lit("base_task"), "sample_id": F.col("gen_id")}))
    cases = lambda d, text: report_run.lexical_hallucination(d.select(*key, "source_id", "sample_id", F.col("gen_id").alias("_ord"), "knowledge", text.alias("answer")).where((opt_str(F.col("answer")) != "") & (opt_str(F.col("knowledge")) != "")))
    tracks = [
        (evaluate.structured_metrics(s, key), s, cases(s, F.when(F.col("parse_ok"), X.rationale_answer(F.col("parsed_output.rationale"), F.col("parsed_output.answer"))))),
        (evaluate.flat_metrics(f, key), f, cases(f, F.col("answer"))),
    ]
    t = report_run.test_tables(tracks, key)
    counts = ["num_rows", "num_source_answerable", "num_e2e_answerability_success", "deepeval_num_cases", "deepeval_num_scored", "deepeval_pass_count", "deepeval_num_errors", "num_e2e_deepeval_success", "num_answerable_deepeval_success"]
    return _plain(t.select(*key, *counts, "deepeval_hallucination_score_mean", "deepeval_pass_rate_on_scored", "deepeval_scored_rate_on_answerable_gate", "e2e_deepeval_pass_rate", "answerable_deepeval_pass_rate"))


def sampled_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All generations of 50 sources drawn by hash."""
    g = table(spark, sf, "api_generations").select("gen_id", "source_id")
    return evaluate.sampled(g, opt_str(F.col("source_id")), 50, 7).distinct()


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """A curve per model and step of the local generations, with rates of their texts."""
    g = table(spark, sf, "local_generations").dropDuplicates(["gen_id"])
    n = F.count("*")
    text = F.coalesce("text", F.lit(""))
    return g.groupBy("model_tag", F.coalesce("model_step", F.lit(0)).alias("model_step")).agg(
        n.alias("num_rows"), rate(F.count_if(F.length(F.trim(text)) > 0), n).alias("parse_ok_rate"), rate(F.count_if(F.length(text) > 3), n).alias("protocol_ok_rate_given_parse_ok"), rate(F.count_if(text.contains("e")), n).alias("evidence_substring_rate_on_usable_pred_answerable"),
        rate(F.count_if(text.endswith(".")), n).alias("e2e_reviewed_correctness_success_rate"), rate(F.count_if(F.length(text) > 30), n).alias("e2e_answerability_accuracy"), rate(F.count_if(F.length(text) > 90), n).alias("e2e_semantic_success_rate"),
        F.count_if(F.length(text) > 40).alias("num_source_answerable"),
    ).withColumns({"model_path": F.concat_ws("/", "model_tag", "model_step"), "eval_track": F.lit("sft_structured"), "eval_variant": F.lit("checkpoint"), "_ord": F.xxhash64("model_tag", "model_step")})


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "local_generations").dropDuplicates(["gen_id"]).select("model_tag", F.coalesce("model_step", F.lit(0)).alias("model_step"), F.col("token_usage.completion_tokens").alias("num_tokens"), (F.length("text") / 7.0).alias("nll")).where("nll is not null")
    return evaluate.loss_metrics(g, ["model_tag", "model_step"])


def loss_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _losses(spark, sf).select("model_tag", "model_step", "num_used_rows", *[_six(F.col(c)).alias(c) for c in ("mean_loss", "mean_nll_per_token")], _six(F.ln("perplexity")).alias("log_perplexity"))


def curve_with_losses(spark: SparkSession, sf: str) -> DataFrame:
    c = report.with_losses(_curve(spark, sf), _losses(spark, sf).withColumn("_ord", F.lit(0)), ["model_tag", "model_step"])
    return c.select("model_tag", "model_step", "num_rows", _six(F.col("parse_ok_rate")).alias("parse_ok_rate"), _six(F.col("mean_loss")).alias("mean_loss"), report.constraint_pass(SelectionSettings(0.9, 0.9, 0.9)).alias("constraint_pass"))


def checkpoint_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The best checkpoint under its constraints."""
    c = report.with_losses(_curve(spark, sf), _losses(spark, sf).withColumn("_ord", F.lit(0)), ["model_tag", "model_step"]).withColumn("_ord", F.col("num_rows"))
    s = report.select_checkpoint(c, SelectionSettings(0.9, 0.9, 0.9))
    return s.select("model_tag", "model_step", "model_path", "constraint_satisfied", "num_candidates", "num_constraint_pass")


def checkpoint_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = report.with_losses(_curve(spark, sf), _losses(spark, sf).withColumn("_ord", F.lit(0)), ["model_tag", "model_step"])
    s = report.validation_summary(c, report.select_checkpoint(c.withColumn("_ord", F.col("num_rows")), SelectionSettings(0.9, 0.9, 0.9)), SelectionSettings(0.9, 0.9, 0.9))
    return s.select("model_tag", "model_step", "constraint_satisfied", "selected_best")


def hallucination_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Curve rows with hallucination results; text length stands for the score."""
    g = table(spark, sf, "local_generations").dropDuplicates(["gen_id"])
    key = ["model_tag", "model_step"]
    base = g.select("model_tag", F.coalesce("model_step", F.lit(0)).alias("model_step"), F.col("gen_id").cast("string").alias("id"), "source_id", F.lit(0).alias("sample_id"), F.col("gen_id").alias("_ord"), F.coalesce("text", F.lit("")).alias("t"))
    details = base.withColumns({"source_is_answerable": F.length("t") % 3 != 0, "source_is_unanswerable": F.length("t") % 3 == 0, "e2e_answerability_success": F.length("t") % 2 == 0})
    deep = base.where("length(t) % 5 <> 0").select(*key, "id", "source_id", "sample_id", "_ord", F.when(F.length("t") % 7 != 0, F.length("t") % 4 < 2).alias("success"), (F.length("t") % 10 / 10.0).alias("score"), F.when(F.length("t") % 7 == 0, "timeout").alias("error"))
    out = report.test_summary(_curve(spark, sf), details, deep, key)
    return out.select(*key, "deepeval_num_cases", "deepeval_num_scored", "deepeval_pass_count", "deepeval_num_errors", _six(F.col("deepeval_hallucination_score_mean")).alias("score_mean"), "num_e2e_deepeval_success", _six(F.col("e2e_deepeval_pass_rate")).alias("e2e_pass_rate"))


def merged_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Curves of two tracks on the first one's columns."""
    c = _curve(spark, sf).select("model_tag", "model_step", "model_path", "eval_track", "eval_variant", "num_rows")
    api = table(spark, sf, "api_generations").groupBy("model_tag").agg(F.count("*").alias("n")).select("model_tag", F.lit(0).alias("model_step"), F.lit("").alias("model_path"), F.lit("base_task").alias("eval_track"), "n")
    return report.merged_curves(c, api)


def enriched_details(spark: SparkSession, sf: str) -> DataFrame:
    """Generations filled with the question of a sibling table by source and model."""
    d = table(spark, sf, "local_generations").select("gen_id", "source_id", "model_tag", F.lit("").alias("question"))
    s = table(spark, sf, "local_generations").join(table(spark, sf, "qa_examples").select("rec_id", "question"), "rec_id").select("source_id", "model_tag", "question", F.col("model_step").alias("step"), F.col("gen_id").alias("_ord"))
    e = report.enriched(d.withColumn("_ord", F.col("gen_id")), s)
    return e.select("gen_id", "question").distinct()


def label_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that read as a label."""
    q = table(spark, sf, "structured_outputs").select(label_to_bool(F.col("answerability"), ("answerable",), ("unanswerable",)).alias("label"))
    return q.groupBy("label").agg(F.count("*").alias("n"))


def seeded_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every record in a seeded shuffle, ranked in ranges."""
    q = table(spark, sf, "qa_examples").select("rec_id")
    return order.global_rank(q, [order.seeded(F.col("rec_id"), 42), F.col("rec_id")], None, "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    p2_found, p2_links, p2_nodes, split_tags, split_tag_counts, restored_examples, answerable_examples,
    prepared_examples, negative_examples, sentence_windows, prompt_budget, prompt_round_trip, partition_counts,
    candidate_fanout, error_log, token_usage, question_types, extracted_numbers, normalized_answers,
    canonical_texts, sanitized_generations, answer_token_f1, evidence_match, parsed_outputs, protocol_checks,
    judge_margins, judge_decisions, answer_deviation, source_prefilter, prefiltered_examples, best_candidates, first_valid,
    confidence_terciles, reverse_terciles, token_correlations, confidence_resolution, confidence_levels, deduplicated_records,
    capped_sample, prepared_training_set, training_records, selective_answerability, temperature_fit, grid_search,
    best_settings, matcher_grid, human_labels, annotation_pack, structured_metrics, structured_confidence,
    flat_metrics, validated_candidates, validation_counts, teacher_prompts, extraction_prompts, full_report, sampled_sources, loss_curve, curve_with_losses, checkpoint_choice,
    checkpoint_summary, hallucination_summary, merged_curves, enriched_details, label_vocabulary, seeded_order,
)}

_REFS = """
    refs AS (
        SELECT rec_id, 'supporting' AS link, pos - 1 AS pos, supporting_sentences[pos].title AS title, supporting_sentences[pos].sent_id AS sent_id, context_documents AS c, '11.' || (pos - 1) AS node
        FROM (SELECT *, unnest(generate_series(1, len(supporting_sentences))) AS pos FROM qa_examples WHERE len(supporting_sentences) > 0)
        UNION ALL
        SELECT rec_id, 'replaced', pos - 1, metadata.negative_strategy.replaced_supports[pos].title, metadata.negative_strategy.replaced_supports[pos].sent_id, context_documents, '13/5/1.' || (pos - 1)
        FROM (SELECT *, unnest(generate_series(1, len(metadata.negative_strategy.replaced_supports))) AS pos FROM qa_examples WHERE len(metadata.negative_strategy.replaced_supports) > 0)
        UNION ALL
        SELECT rec_id, 'replacement', pos - 1, metadata.negative_strategy.replacement_sentences[pos].title, metadata.negative_strategy.replacement_sentences[pos].sent_id, context_documents, '13/5/2.' || (pos - 1)
        FROM (SELECT *, unnest(generate_series(1, len(metadata.negative_strategy.replacement_sentences))) AS pos FROM qa_examples WHERE len(metadata.negative_strategy.replacement_sentences) > 0)),
    hits AS (
        SELECT rec_id, link, pos::INT AS pos, title, sent_id, node,
               CASE WHEN title IS NULL OR sent_id IS NULL OR sent_id < 0 THEN NULL
                    ELSE list_min(list_filter(generate_series(1, coalesce(len(c), 0)), lambda k: coalesce(c[k].title = title AND len(c[k].sentences) > sent_id, false))) END AS spot
        FROM refs)"""

SQL: dict[str, str] = {
    **oracle.SQL,
    **oracle_rows.SQL,
    "p2_found": f"WITH {_REFS} SELECT DISTINCT rec_id, link, pos FROM hits WHERE spot IS NULL",
    "p2_links": f"WITH {_REFS} SELECT rec_id, link, pos, node, title, sent_id, '12.' || (spot - 1) AS context_node, '12.' || (spot - 1) || '/1.' || sent_id AS sentence_node FROM hits",
}

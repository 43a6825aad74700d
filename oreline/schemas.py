"""Schemas of the tables between the stages, as DDL. Readers take them as supersets: a field that a row
lacks is null."""

from __future__ import annotations

EVIDENCE = "array<struct<quote:string>>"
PARSED = f"struct<answerability:string,evidence:{EVIDENCE},rationale:string,answer:string,confidence:string>"
SUPPORTS = "array<struct<title:string,sent_id:int,sentence:string,window_sentences:array<string>,window_text:string>>"
DOCUMENTS = "array<struct<title:string,sentences:array<string>>>"
METADATA = (
    "struct<question_type:string,origin_track:string,raw_source_id:string,hotpot_source_split:string,answerability_label:string,reference_answer:string,knowledge_strategy:struct<window_size:int,include_title_prefix:boolean>,"
    "negative_strategy:struct<mode:string,replaced_supports:array<struct<title:string,sent_id:int>>,replacement_sentences:array<struct<title:string,sent_id:int,sentence:string>>,same_doc_candidate_radius:int,adjacent_doc_sentence_limit:int>>"
)
MODEL = "model_tag string, model_step int, model_path string, eval_track string, eval_variant string"

RAW = "_id string, id string, _source_index int, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
TAGGED = RAW + ", hotpot_source_split string, data_split string, answerability_split string"
EXAMPLE = f"id string, source_id string, variant_id string, data_split string, answerability_split string, question string, knowledge string, reference_answer string, answerability_label string, difficulty string, supporting_sentences {SUPPORTS}, context_documents {DOCUMENTS}, metadata {METADATA}"
PREFILTERED = EXAMPLE + ", prompt_tokens int, within_budget boolean, source_prefilter struct<infer_prompt_tokens:int,prompt_within_budget:boolean,issues:array<string>>, nli_prefilter struct<keep:boolean,decision:string,margin:double,score:double,used_flipped:boolean,flipped_decision:string,flipped_margin:double,issues:array<string>>, kept boolean"
CANDIDATE = PREFILTERED + ", candidate_id int, teacher_model string, prompt_style string, prompt string, raw_output string, generation_error boolean"
VALIDATED = CANDIDATE + f", _ord bigint, parse_ok boolean, parsed_output {PARSED}, hard_pass boolean, hard_fail_reasons array<string>, canonical_output string, completion_tokens int, completion_over_budget boolean, selected boolean, derived_confidence string, selection_score double"
RECORD = "id string, source_id string, variant_id string, data_split string, answerability_label string, prompt_style string, prompt string, completion string, question string, knowledge string, reference_answer string"
STRUCTURED = MODEL + f", sample_id int, id string, source_id string, question string, knowledge string, reference_answer string, answerability_label string, raw_output string, supporting_sentences {SUPPORTS}"
FLAT = MODEL + ", sample_id int, id string, source_id string, question string, knowledge string, reference_answer string, answerability_label string, answer string, extraction_text string"
HALLUCINATION = MODEL + ", sample_id int, id string, source_id string, score double, success boolean, error string"
DETAILS = MODEL + ", sample_id bigint, id string, source_id string, source_is_answerable boolean, source_is_unanswerable boolean, e2e_answerability_success boolean"
ITEM = "id string, source_id string, question string, prompt string, knowledge string, contexts array<string>, reference_answer string, answerability_label string, answer string"
LOSS = MODEL + ", id string, nll double, num_tokens int"
VERIFY = "id string, knowledge string, question string, chosen string, rejected string"
ANNOTATED = "task_type string, pack_id string, sample_id int, source_id string, model_tag string, model_step int, model_path string, premise_text string, hypothesis_text string, question string, reference_answer string, answer string, pack_answer string, human_label string"
MIXED = FLAT + f", parsed_output {PARSED}, extraction_parse_ok boolean, refusal_detected boolean, extracted_answer string, pred_answerability string, raw_answer string, correctness_ok boolean"

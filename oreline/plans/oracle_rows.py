"""SQL for the queries on structured and flat generations, row by row: what the parser, the checks, the
judge and the selection make of every generation. Constants are written out, not imported."""

from __future__ import annotations

from .oracle import _LABEL, _TERCILE, _collapse, _f1, _margin, _nli, _opt, _six, _strip, _tokens, _words

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _canonical(x: str) -> str:
    """Compatibility form of the characters the tables have, without zero-width ones, stripped."""
    x = f"replace(replace({x}, '&amp;', '&'), chr(13) || chr(10), chr(10))"
    x = f"translate({x}, '{_WIDE}', '{_NARROW}')"
    for one, two in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "..."), ("‑", "‐")):
        x = f"replace({x}, '{one}', '{two}')"
    x = rf"regexp_replace(nfc_normalize({x}), '[\x{{feff}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}]', '', 'g')"
    x = rf"regexp_replace({x}, '[\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')"
    return _strip(x)


_REFUSALS = "('I don''t know based on the provided knowledge.', 'The provided knowledge does not contain enough information to answer the question.', 'I cannot answer from the provided knowledge.')"

# Each pattern as one that needs no lookaround.
_PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dame|Lord|Lady|King|Queen|Herr|Frau)\.? \p{Lu}|\b\p{Lu}\p{Ll}+ (?:\p{Lu}\. ?)?\p{Lu}\p{Ll}+"
_ORG = r"\p{Lu}\p{L}+ (?:Guild|Company|Council|Society|Union|League|Trust|Bank|Press|Institute|Foundation|Brothers|Railway|Works|University|College|Academy|Corporation|Party|Club|Inc|Ltd|Group|Association|Agency|Ministry)\b"
_PLACE = r"\b(?:in|at|near|from|to|of|through|bei|von|aus|en|de|cerca de|près de) \p{Lu}\p{L}+|\b(?:Lake|Mount|Port|River|Cape|Upper|Lower|Saint|San|New|North|South|East|West) ?-?\p{Lu}\p{L}+"
_TIME = r"\b\d{4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b"


def _type_ok(question: str, answer: str) -> str:
    q = f"lower({_opt(question)})"
    has = lambda p: f"regexp_matches({answer}, '{p}')"
    return f"""(CASE WHEN starts_with({q}, 'who') THEN {has(_PERSON)} OR {has(_ORG)} WHEN starts_with({q}, 'where') THEN {has(_PLACE)} WHEN starts_with({q}, 'when') THEN {has(_TIME)}
        WHEN starts_with({q}, 'how many') OR starts_with({q}, 'how much') THEN {has('(?:^|[^0-9A-Za-z_])[0-9]')} ELSE true END)"""


def _judge(premise: str, answer: str, question: str) -> str:
    """Struct of the margin and both decisions, a failed type check forcing a no."""
    return f"""(SELECT {{'margin': m, 'full': CASE WHEN ok AND m >= 0.4 THEN 'yes' ELSE 'no' END, 'reject': CASE WHEN NOT ok THEN 'no' WHEN abs(m - 0.6) <= 0.05 THEN 'abstain' WHEN m >= 0.6 THEN 'yes' ELSE 'no' END}}
        FROM (SELECT {_margin('e')} AS m, ok FROM (SELECT {_nli(premise, answer)} AS e, {_type_ok(question, answer)} AS ok)))"""


_STRUCT = rf"""
    gen AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, model_tag, candidate_id, text FROM api_generations WHERE ok AND prompt_style = 'structured'),
    spans AS (SELECT *, regexp_extract({_canonical('text')}, '(?s)(\{{.*\}})', 1) AS span FROM gen),
    docs AS (SELECT *, CASE WHEN json_valid(span) AND json_type(span) = 'OBJECT' THEN span::JSON END AS j FROM spans),
    strict AS (
        SELECT * EXCLUDE (j), CASE WHEN coalesce(
            list_sort(json_keys(j)) = ['answer', 'answerability', 'confidence', 'evidence', 'rationale'] AND json_extract_string(j, '$.answerability') IN ('answerable', 'unanswerable') AND json_extract_string(j, '$.confidence') IN ('high', 'medium', 'low')
            AND json_type(j, '$.rationale') = 'VARCHAR' AND length(json_extract_string(j, '$.rationale')) > 0 AND json_type(j, '$.answer') = 'VARCHAR' AND length(json_extract_string(j, '$.answer')) > 0 AND json_type(j, '$.evidence') = 'ARRAY'
            AND len(list_filter(json_extract(j, '$.evidence[*]'), lambda e: NOT coalesce(json_type(e) = 'OBJECT' AND json_keys(e) = ['quote'] AND json_type(e, '$.quote') = 'VARCHAR' AND length(json_extract_string(e, '$.quote')) > 0, false))) = 0, false) THEN j END AS j
        FROM docs),
    parsed AS (
        SELECT * EXCLUDE (j, span), j IS NOT NULL AS parse_ok, json_extract_string(j, '$.answerability') AS pred, json_extract_string(j, '$.confidence') AS confidence, {_canonical("json_extract_string(j, '$.rationale')")} AS rationale, {_canonical("json_extract_string(j, '$.answer')")} AS answer,
               CASE WHEN j IS NOT NULL THEN list_transform(json_extract(j, '$.evidence[*]'), lambda e: {_canonical("json_extract_string(e, '$.quote')")}) END AS quotes
        FROM strict),
    issues AS (
        SELECT *, CASE WHEN parse_ok THEN list_filter([
                CASE WHEN {_collapse('rationale')} = {_collapse('answer')} THEN 'Rationale must not be identical to the final answer.' END,
                CASE WHEN pred = 'unanswerable' AND len(quotes) <> 0 THEN 'Unanswerable output must use an empty evidence list.' END,
                CASE WHEN pred = 'unanswerable' AND {_collapse('answer')} NOT IN {_REFUSALS} THEN 'Unanswerable output must use an allowed refusal template.' END,
                CASE WHEN pred = 'answerable' AND len(quotes) < 1 THEN 'Answerable output must include at least one evidence quote.' END,
                CASE WHEN pred = 'answerable' AND len(quotes) > 4 THEN 'Evidence count exceeds max_evidence_count=4.' END], lambda x: x IS NOT NULL) END AS issue
        FROM parsed)"""

_CHECKED = rf"""{_STRUCT},
    joined AS (
        SELECT i.*, coalesce(len(issue) = 0, false) AS protocol_ok, q.question, q.knowledge AS know, {_collapse(_canonical("coalesce(q.knowledge, '')"))} AS k, {_opt('q.reference_answer')} AS ra, {_LABEL} AS gold, q.data_split, q.metadata.nli_prefilter.score AS score,
               list_filter(list_transform(q.supporting_sentences, lambda s: {_collapse(_opt('s.sentence'))}), lambda s: s <> '') AS golds, list_transform(quotes, lambda x: {_collapse('x')}) AS qs, {_tokens('answer')} AS ta, {_tokens('q.reference_answer')} AS tr
        FROM issues i JOIN qa_examples q USING (rec_id)),
    hits AS (
        SELECT *, len(list_filter(qs, lambda x: x <> '' AND contains(k, x))) AS hit, len(list_filter(qs, lambda x: len(list_filter(coalesce(golds, []), lambda s: x <> '' AND contains(s, x))) > 0)) AS supported,
               ta = tr AS same, {_f1('ta', 'tr')} AS f1, list_filter(list_transform(quotes, lambda x: {_opt('x')}), lambda x: x <> '') AS chosen
        FROM joined),
    checked AS (
        SELECT *, CASE WHEN pred = 'answerable' THEN hit = len(qs) END AS evidence_ok, CASE WHEN pred = 'unanswerable' THEN 1.0 WHEN pred = 'answerable' THEN supported / greatest(1, len(qs)) END AS support_rate,
               CASE WHEN pred = 'answerable' AND ra <> '' THEN same OR f1 >= 0.85 END AS correct, CASE WHEN pred = 'answerable' AND ra <> '' THEN f1 END AS token_f1,
               CASE WHEN pred = 'answerable' AND len(chosen) > 0 THEN array_to_string(chosen, chr(10)) || chr(10) || 'Question: ' || {_opt('question')} END AS premise,
               {_opt('rationale')} || chr(10) || 'Therefore the answer is ' || {_opt('answer')} AS hypothesis
        FROM hits),
    judged AS (SELECT *, CASE WHEN premise IS NOT NULL THEN {_judge('premise', 'hypothesis', 'question')} END AS s FROM checked)"""


def _json_text(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _completion(confidence: str) -> str:
    nl = "chr(10)"
    items = f"array_to_string(list_transform(quotes, lambda x: '    {{' || {nl} || '      \"quote\": ' || {_json_text('x')} || {nl} || '    }}'), ',' || {nl})"
    evidence = f"CASE WHEN len(quotes) = 0 THEN '[]' ELSE '[' || {nl} || {items} || {nl} || '  ]' END"
    return f"""('{{' || {nl} || '  "answerability": "' || pred || '",' || {nl} || '  "evidence": ' || {evidence} || ',' || {nl} || '  "rationale": ' || {_json_text('rationale')} || ',' || {nl} || '  "answer": ' || {_json_text('answer')} || ',' || {nl} || '  "confidence": "' || {confidence} || '"' || {nl} || '}}')"""


_VALIDATED = rf"""{_CHECKED},
    labelled AS (SELECT *, {_completion('confidence')} AS canonical FROM judged WHERE gold IN ('answerable', 'unanswerable')),
    counted AS (
        SELECT *, {_words('canonical')} AS tokens, CASE WHEN gold = 'answerable' AND protocol_ok THEN s.full END AS decision, CASE WHEN gold = 'answerable' AND protocol_ok THEN s.margin END AS margin FROM labelled),
    reasoned AS (
        SELECT *, CASE WHEN NOT parse_ok THEN 1 ELSE len(issue) + (tokens > 512)::INT + (pred <> gold)::INT + (gold = 'answerable' AND coalesce(NOT evidence_ok, false))::INT + (gold = 'answerable' AND coalesce(NOT correct, false))::INT + coalesce(decision = 'no', false)::INT END AS n_reasons
        FROM counted),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY rec_id, gold, n_reasons = 0 ORDER BY CASE WHEN gold = 'answerable' THEN coalesce(margin, '-inf'::DOUBLE) END DESC, CASE WHEN gold = 'answerable' THEN coalesce(support_rate, 0) END DESC,
               CASE WHEN gold = 'answerable' THEN coalesce(token_f1, 0) END DESC, CASE WHEN gold = 'answerable' THEN CASE WHEN coalesce(len(quotes), 0) = 0 THEN 'inf'::DOUBLE ELSE len(quotes) END END, coalesce(candidate_id, 0), gen_id) = 1 AND n_reasons = 0 AS selected
        FROM reasoned),
    valued AS (SELECT *, CASE WHEN selected THEN CASE WHEN gold = 'answerable' THEN margin ELSE score END END AS value FROM ranked),
    placed AS (SELECT gen_id, gold AS g, row_number() OVER (PARTITION BY gold ORDER BY value, gen_id) AS r, count(*) OVER (PARTITION BY gold) AS n FROM valued WHERE value IS NOT NULL),
    validated AS (
        SELECT v.*, CASE WHEN p.g = 'answerable' THEN {_TERCILE.format('low', 'high')} WHEN p.g = 'unanswerable' THEN {_TERCILE.format('high', 'low')} END AS derived FROM valued v LEFT JOIN placed p USING (gen_id)),
    final AS (SELECT *, coalesce(derived, confidence) AS said, {_completion('coalesce(derived, confidence)')} AS completion FROM validated)"""

_HEAD = """Return exactly one JSON object with fields in this order:
['answerability', 'evidence', 'rationale', 'answer', 'confidence']

Rules:
- If answerable, cite 1 to 4 quotes copied from the knowledge.
- Provide a short rationale showing how the evidence supports the answer.
- The rationale must not be identical to the answer.
- If unanswerable, set evidence to [] and use an allowed refusal template.
- In unanswerable cases, the rationale should briefly state what key information is missing, ambiguous, or contradictory.
- Keep the answer concise and directly responsive.
- Do not add explanations outside the JSON.

Refusal templates: I don't know based on the provided knowledge.

Knowledge:
""".replace("'", "''")

def _share(n: str, d: str) -> str:
    return f"round(CASE WHEN {d} > 0 THEN {n} / {d} END, 6)"


_E2E = "CASE WHEN gold = 'unanswerable' THEN e2e WHEN gold = 'answerable' THEN gate AND coalesce({0}, false) ELSE false END"
_DETAILS = rf"""{_CHECKED},
    flagged AS (
        SELECT *, parse_ok AND protocol_ok AS usable, parse_ok AND protocol_ok AND coalesce(CASE WHEN coalesce(gold, '') <> '' THEN pred = gold END, false) AS e2e FROM judged),
    gated AS (SELECT *, coalesce(gold = 'answerable', false) AND e2e AS gate FROM flagged),
    strict_rows AS (SELECT *, CASE WHEN gate THEN correct END AS strict_ok, CASE WHEN gate AND NOT correct THEN token_f1 >= 0.27 END AS matcher_ok, CASE WHEN gate AND s IS NOT NULL AND protocol_ok AND {_opt('question')} <> '' THEN s.full END AS decision FROM gated),
    details AS (
        SELECT *, CASE WHEN strict_ok THEN true ELSE matcher_ok END AS reviewed_ok, CASE WHEN decision IS NOT NULL THEN s.margin END AS shown FROM strict_rows),
    rows_ AS (SELECT *, {_E2E.format('reviewed_ok')} AS e2e_correct, {_E2E.format("decision = 'yes'")} AS e2e_semantic, gold = 'answerable' AS is_a, gold = 'unanswerable' AS is_u FROM details),
    pairs AS (
        SELECT model_tag, confidence, CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END AS level, e2e_correct::INT::DOUBLE AS c, e2e_semantic::INT::DOUBLE AS m, s.margin AS margin FROM rows_ WHERE usable AND coalesce(gold, '') <> '' AND confidence IS NOT NULL)"""


def _resolution(y: str, name: str) -> str:
    return f"""{name}_mean AS (SELECT model_tag, avg({y}) AS mu, count(*) AS n FROM pairs GROUP BY 1),
        {name}_level AS (SELECT model_tag, confidence, avg({y}) AS v, count(*) AS k FROM pairs GROUP BY 1, 2),
        {name} AS (SELECT model_tag, CASE WHEN max(mu) * (1 - max(mu)) > 0 THEN round(sum(k / n * (v - mu) ^ 2) / (max(mu) * (1 - max(mu))), 6) END AS resolution, max(n) AS n FROM {name}_mean JOIN {name}_level USING (model_tag) GROUP BY 1)"""


def _correlation(y: str, name: str) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY model_tag ORDER BY {v}) + (count(*) OVER (PARTITION BY model_tag, {v}) - 1) / 2.0"
    good = lambda a, b: f"CASE WHEN count(*) >= 2 AND stddev_pop({a}) * stddev_pop({b}) > 0 THEN round(corr({a}, {b}), 6) END"
    return f"""SELECT model_tag, {good('x', 'y')} AS pearson, {good('rx', 'ry')} AS spearman, count(*) AS n, '{name}' AS outcome
        FROM (SELECT model_tag, level::DOUBLE AS x, {y} AS y, {rank('level')} AS rx, {rank(y)} AS ry FROM pairs WHERE {y} IS NOT NULL) GROUP BY 1"""


_FLAT = rf"""
        g AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, source_id, model_tag, coalesce(text, '') AS t FROM local_generations),
        e AS (SELECT g.*, {_strip('t')} <> '' AS parse_ok, {_strip("split_part(t, '. ', 1)")} AS first_, regexp_matches(lower(t), 'cannot|unable|impossible|not enough|does not say|no answer') AS refused, question, {_opt('reference_answer')} AS ra, {_LABEL} AS gold, knowledge AS know,
                     CASE WHEN {_opt('knowledge')} <> '' THEN {_opt('knowledge')} || chr(10) ELSE '' END || 'Question: ' || {_opt('question')} AS premise FROM g JOIN qa_examples USING (rec_id)),
        p AS (SELECT *, CASE WHEN parse_ok THEN CASE WHEN refused THEN 'unanswerable' ELSE 'answerable' END END AS pred, CASE WHEN parse_ok AND NOT refused THEN first_ ELSE '' END AS short FROM e),
        a AS (SELECT *, coalesce(pred = gold, false) AS e2e, coalesce(gold = 'answerable' AND pred = gold, false) AND short <> '' AS gate FROM p)"""

_SCHEMA = """{
  "$defs": {
    "Answerability": {
      "description": "Answerability labels in the structured QA protocol.",
      "enum": [
        "answerable",
        "unanswerable"
      ],
      "title": "Answerability",
      "type": "string"
    },
    "ConfidenceLevel": {
      "description": "Confidence labels in the structured QA protocol.",
      "enum": [
        "high",
        "medium",
        "low"
      ],
      "title": "ConfidenceLevel",
      "type": "string"
    },
    "EvidenceQuote": {
      "additionalProperties": false,
      "description": "One evidence quote selected from the provided knowledge.",
      "properties": {
        "quote": {
          "minLength": 1,
          "title": "Quote",
          "type": "string"
        }
      },
      "required": [
        "quote"
      ],
      "title": "EvidenceQuote",
      "type": "object"
    }
  },
  "additionalProperties": false,
  "description": "Structured grounded QA output.",
  "properties": {
    "answerability": {
      "$ref": "#/$defs/Answerability"
    },
    "evidence": {
      "items": {
        "$ref": "#/$defs/EvidenceQuote"
      },
      "title": "Evidence",
      "type": "array"
    },
    "rationale": {
      "minLength": 1,
      "title": "Rationale",
      "type": "string"
    },
    "answer": {
      "minLength": 1,
      "title": "Answer",
      "type": "string"
    },
    "confidence": {
      "$ref": "#/$defs/ConfidenceLevel"
    }
  },
  "required": [
    "answerability",
    "evidence",
    "rationale",
    "answer",
    "confidence"
  ],
  "title": "StructuredQaOutput",
  "type": "object"
}"""

_TEACHER = """You are preparing structured grounded-QA supervision data.
Return exactly one JSON object and nothing else.
Requirements:
1) Use the field order: answerability, evidence, rationale, answer, confidence.
2) Every evidence quote must be copied from the provided knowledge.
3) Evidence must be the smallest sufficient span or spans from the knowledge needed to answer the question.
4) The rationale must use only the information contained in the evidence.
5) The rationale must perform only the minimal reasoning needed to reach the answer.
6) The rationale must not be identical to the final answer text.
7) When the question is answerable, cite evidence and answer directly.
8) When the question is unanswerable, use an allowed refusal template and keep evidence as [].
9) For unanswerable cases, the rationale must briefly identify what information is missing, ambiguous, or contradictory in the provided knowledge.
10) Preserve the natural answer form when possible.

""".replace("'", "''")
_TEMPLATES = """["I don't know based on the provided knowledge.", 'The provided knowledge does not contain enough information to answer the question.', 'I cannot answer from the provided knowledge.']"""
_TEACHER_TAIL = f"JSON schema:\n{_SCHEMA}\n\nAllowed refusal templates: {_TEMPLATES}\n\nKnowledge:\n".replace("'", "''")
_EXTRACTION = """Read the model answer and return exactly one JSON object.
The JSON must use this schema and field order:
{
  "short_answer": string,
  "refusal_detected": boolean,
  "refusal_reason": string
}

Instructions:
- Determine whether the model answer refuses to answer, says it does not know, or states that the information is missing.
- If the answer is a refusal or non-answer, set refusal_detected to true and short_answer to an empty string.
- If the answer contains a real answer, set refusal_detected to false and extract the shortest complete answer span needed to answer the question.
- Do not include explanations outside the JSON.

Question: """.replace("'", "''")
_TEACHER_PROMPT = f"""('{_TEACHER}' || CASE WHEN {_opt('reference_answer')} <> '' THEN 'Reference answer:' || chr(10) || {_opt('reference_answer')} || chr(10) || chr(10) || 'Keep your final answer semantically consistent with the reference answer.' || chr(10) || chr(10) ELSE '' END
        || '{_TEACHER_TAIL}' || {_opt('knowledge')} || chr(10) || chr(10) || 'Question: ' || {_opt('question')} || chr(10))"""


def _track(name: str, source: str, answer: str) -> str:
    """Counts of one track: ``source`` has the gate, the answerability and its gold label."""
    return f"""SELECT model_tag, '{name}' AS eval_track, count(*) AS num_rows, count(*) FILTER (gold = 'answerable') AS num_source_answerable, count(*) FILTER (e2e) AS num_e2e_answerability_success, count(missing) AS deepeval_num_cases, count(missing) AS deepeval_num_scored,
            count(*) FILTER (missing <= 0.5) AS deepeval_pass_count, 0::BIGINT AS deepeval_num_errors, count(*) FILTER (CASE WHEN gold = 'unanswerable' THEN e2e ELSE gold = 'answerable' AND e2e AND missing <= 0.5 END) AS num_e2e_deepeval_success,
            count(*) FILTER (gold = 'answerable' AND e2e AND missing <= 0.5) AS num_answerable_deepeval_success, round(avg(missing), 6) AS deepeval_hallucination_score_mean, {_share('count(*) FILTER (missing <= 0.5)', 'count(missing)')} AS deepeval_pass_rate_on_scored,
            {_share("count(missing) FILTER (gold = 'answerable' AND e2e)", "count(*) FILTER (gold = 'answerable' AND e2e)")} AS deepeval_scored_rate_on_answerable_gate,
            {_share("count(*) FILTER (CASE WHEN gold = 'unanswerable' THEN e2e ELSE gold = 'answerable' AND e2e AND missing <= 0.5 END)", 'count(*)')} AS e2e_deepeval_pass_rate,
            {_share("count(*) FILTER (gold = 'answerable' AND e2e AND missing <= 0.5)", "count(*) FILTER (gold = 'answerable')")} AS answerable_deepeval_pass_rate
        FROM (SELECT *, CASE WHEN {_opt(answer)} <> '' AND {_opt('know')} <> '' THEN 1 - {_nli('know', answer)} END AS missing FROM {source}) GROUP BY 1"""


def _array(path: str, x: str) -> str:
    return f"SELECT '{path}' AS path, coalesce(sum(len({x})), 0)::BIGINT AS n_nodes, count(*) FILTER (len({x}) > 0) AS n_parents, count(*) FILTER (len({x}) > 0) AS n_records FROM qa_examples"


def _nested(path: str, x: str, field: str) -> str:
    return f"""SELECT '{path}' AS path, coalesce(sum(list_sum(n)), 0)::BIGINT AS n_nodes, coalesce(sum(len(list_filter(n, lambda k: k > 0))), 0)::BIGINT AS n_parents, count(*) FILTER (list_sum(n) > 0) AS n_records
        FROM (SELECT list_transform({x}, lambda e: coalesce(len(e.{field}), 0)) AS n FROM qa_examples)"""


def _struct(path: str, x: str) -> str:
    return f"SELECT '{path}' AS path, count({x}) AS n_nodes, count({x}) AS n_parents, count({x}) AS n_records FROM qa_examples"


_NODES = " UNION ALL ".join([
    _array("supporting_sentences", "supporting_sentences"), _nested("supporting_sentences.window_sentences", "supporting_sentences", "window_sentences"),
    _array("context_documents", "context_documents"), _nested("context_documents.sentences", "context_documents", "sentences"),
    *[_struct(x, x) for x in ("metadata", "metadata.knowledge_strategy", "metadata.negative_strategy", "metadata.source_prefilter", "metadata.nli_prefilter")],
    *[_array(x, x) for x in ("metadata.negative_strategy.replaced_supports", "metadata.negative_strategy.replacement_sentences", "metadata.source_prefilter.issues", "metadata.nli_prefilter.issues")],
])

_PACK = f"""
    s AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, evidence, rationale, answer, lower(trim(answerability)) AS pred FROM structured_outputs),
    api AS (SELECT DISTINCT gen_id FROM api_generations),
    l AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, text FROM local_generations),
    rows_ AS (
        SELECT gen_id, 'structured' AS src, {_opt('question')} AS q, {_opt('knowledge')} AS k, {_opt('q.reference_answer')} AS ref, {_opt('answer')} AS ans,
               coalesce(pred = 'answerable' AND len(list_filter(evidence, lambda e: {_opt('e.quote')} <> '')) > 0 AND {_opt('rationale')} <> '' AND {_opt('answer')} <> '', false) AS gate FROM s JOIN api USING (gen_id) JOIN qa_examples q USING (rec_id)
        UNION ALL SELECT gen_id, 'flat', {_opt('question')}, {_opt('knowledge')}, {_opt('q.reference_answer')}, {_opt('text')}, text IS NOT NULL AND {_opt('text')} <> '' FROM l JOIN qa_examples q USING (rec_id)),
    tasks AS (
        SELECT *, CASE src WHEN 'flat' THEN 'nli_flat' ELSE 'nli_structured' END AS task,
               CASE WHEN NOT gate THEN CASE src WHEN 'flat' THEN 'missing_fields' ELSE 'refusal_or_unanswerable' END WHEN q = '' OR (src = 'flat' AND (k = '' OR ans = '')) THEN 'missing_fields' END AS reason FROM rows_
        UNION ALL SELECT *, 'matcher', CASE WHEN NOT gate OR ref = '' THEN 'refusal_or_unanswerable' WHEN q = '' OR k = '' OR ans = '' THEN 'missing_fields' END FROM rows_),
    seen AS (SELECT *, coalesce(sum((reason IS NULL)::INT) OVER (PARTITION BY task ORDER BY sha1('42:' || gen_id), gen_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tasks)"""

_FULL = lambda xs: f"len(list_filter(coalesce({xs}, []), lambda x: {_opt('x')} <> ''))"

SQL: dict[str, str] = {
    "restored_examples": f"""
        SELECT rec_id::VARCHAR AS rec_id, {_opt('source_id')} AS source_id, {_strip('data_split')} AS data_split, {_opt('answerability_label')} AS answerability_label, {_opt('difficulty')} AS difficulty, md5({_opt('knowledge')}) AS knowledge_md5,
               coalesce(len(supporting_sentences), 0)::INT AS n_supports, coalesce(list_sum(list_transform(supporting_sentences, lambda s: {_FULL('s.window_sentences')})), 0)::INT AS n_window,
               coalesce(len(context_documents), 0)::INT AS n_documents, coalesce(list_sum(list_transform(context_documents, lambda d: {_FULL('d.sentences')})), 0)::INT AS n_sentences FROM qa_examples""",
    "p2_nodes": _NODES,
    "annotation_pack": f"""WITH {_PACK}
        SELECT task AS task_type, src AS input_source_path, count(*) FILTER (reason IS NULL) AS num_kept, count(*) FILTER (reason = 'refusal_or_unanswerable') AS num_skipped_refusal_or_unanswerable, count(*) FILTER (reason = 'missing_fields') AS num_skipped_missing_fields,
               0::BIGINT AS num_skipped_missing_eval_state, 0::BIGINT AS num_skipped_matcher_not_applicable FROM seen WHERE before < 200 GROUP BY 1, 2""",
    "teacher_prompts": f"SELECT rec_id, md5({_TEACHER_PROMPT}) AS prompt_md5, {_words(_TEACHER_PROMPT)}::INT AS prompt_tokens FROM qa_examples",
    "extraction_prompts": f"""WITH g AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, text FROM local_generations)
        SELECT gen_id, md5('{_EXTRACTION}' || {_opt('question')} || chr(10) || 'Model answer:' || chr(10) || {_opt('text')} || chr(10)) AS prompt_md5 FROM g JOIN qa_examples USING (rec_id)""",
    "full_report": f"""WITH {_DETAILS}, {_FLAT}, said AS (SELECT *, CASE WHEN parse_ok THEN {_opt('rationale')} || chr(10) || 'Therefore the answer is ' || {_opt('answer')} END AS statement FROM rows_)
        {_track('sft_structured', 'said', 'statement')} UNION ALL {_track('base_task', 'a', _strip('t'))}""",
    "structured_metrics": f"""WITH {_DETAILS}, {_resolution('c', 'rc')}, {_resolution('m', 'rm')},
        c AS (
            SELECT model_tag, count(*) AS num_rows, count(*) FILTER (parse_ok) AS num_parse_ok, count(*) FILTER (parse_ok AND protocol_ok) AS num_protocol_ok, count(*) FILTER (usable) AS num_usable, count(*) FILTER (is_a) AS num_source_answerable, count(*) FILTER (is_u) AS num_source_unanswerable,
                   count(*) FILTER (e2e) AS num_e2e_answerability_success, count(*) FILTER (usable AND pred = 'answerable') AS num_usable_pred_answerable, count(*) FILTER (usable AND pred = 'answerable' AND evidence_ok) AS evidence_substring_success_count, count(*) FILTER (gate) AS answerable_gate_total,
                   count(*) FILTER (strict_ok) AS correctness_strict_ok, count(matcher_ok) AS correctness_matcher_review_total, count(*) FILTER (matcher_ok) AS correctness_matcher_positive, count(*) FILTER (reviewed_ok) AS correctness_reviewed_ok, count(*) FILTER (e2e_correct) AS num_e2e_reviewed_correctness_success,
                   count(decision) AS semantic_total, count(*) FILTER (decision = 'yes') AS semantic_yes, count(*) FILTER (e2e_semantic) AS num_e2e_semantic_success, count(*) FILTER (is_a AND e2e_correct) AS num_answerable_reviewed_correctness_success, count(*) FILTER (is_a AND e2e_semantic) AS num_answerable_semantic_success,
                   count(*) FILTER (is_u AND e2e) AS num_unanswerable_success, round(avg(shown), 6) AS semantic_margin_mean, count(*) FILTER (NOT protocol_ok) AS generation_failed_count
            FROM rows_ GROUP BY 1)
        SELECT c.*, {_share('num_parse_ok', 'num_rows')} AS parse_ok_rate, {_share('num_protocol_ok', 'num_parse_ok')} AS protocol_ok_rate_given_parse_ok, {_share('num_usable', 'num_rows')} AS usable_rate, {_share('num_e2e_answerability_success', 'num_rows')} AS e2e_answerability_accuracy,
               {_share('evidence_substring_success_count', 'num_usable_pred_answerable')} AS evidence_substring_rate_on_usable_pred_answerable, {_share('correctness_matcher_positive', 'correctness_matcher_review_total')} AS correctness_matcher_positive_rate,
               {_share('num_e2e_reviewed_correctness_success', 'num_rows')} AS e2e_reviewed_correctness_success_rate, {_share('semantic_total', 'answerable_gate_total')} AS semantic_evaluated_rate_on_answerable_gate, {_share('num_e2e_semantic_success', 'num_rows')} AS e2e_semantic_success_rate,
               {_share('num_answerable_reviewed_correctness_success', 'num_source_answerable')} AS answerable_reviewed_correctness_success_rate, {_share('num_answerable_semantic_success', 'num_source_answerable')} AS answerable_semantic_success_rate, {_share('num_unanswerable_success', 'num_source_unanswerable')} AS unanswerable_success_rate,
               {_share('generation_failed_count', 'num_rows')} AS generation_failed_rate, 1.0::DOUBLE AS avg_attempt_count, {_share('(num_rows - generation_failed_count)', 'num_rows')} AS success_on_first_attempt_rate, false AS supporting_fact_check_enabled,
               rc.resolution AS e2e_confidence_resolution_reviewed_correctness, coalesce(rc.n, 0) AS e2e_confidence_resolution_reviewed_correctness_num_rows, rm.resolution AS e2e_confidence_resolution_semantic, coalesce(rm.n, 0) AS e2e_confidence_resolution_semantic_num_rows
        FROM c LEFT JOIN rc USING (model_tag) LEFT JOIN rm USING (model_tag)""",
    "structured_confidence": f"WITH {_DETAILS} {_correlation('c', 'e2e_correct')} UNION ALL {_correlation('m', 'e2e_semantic')} UNION ALL {_correlation('margin', 'margin')}",
    "flat_metrics": f"""
        WITH {_FLAT},
        f AS (SELECT *, {_tokens('short')} AS ts, {_tokens('ra')} AS tr FROM a),
        c AS (SELECT *, CASE WHEN gate AND ra <> '' THEN ts = tr OR {_f1('ts', 'tr')} >= 0.85 END AS correct, CASE WHEN gate AND ra <> '' THEN {_f1('ts', 'tr')} END AS f1 FROM f),
        j AS (SELECT *, CASE WHEN NOT correct THEN f1 >= 0.27 END AS matcher_ok, CASE WHEN gate THEN {_judge('premise', _strip('t'), 'question')} END AS s FROM c),
        r AS (SELECT *, CASE WHEN correct THEN true ELSE matcher_ok END AS reviewed_ok FROM j),
        d AS (SELECT *, {_E2E.format('reviewed_ok')} AS e2e_correct, {_E2E.format("s.full = 'yes'")} AS e2e_semantic, gold = 'answerable' AS is_a, gold = 'unanswerable' AS is_u FROM r),
        n AS (
            SELECT model_tag, count(*) AS num_rows, count(*) FILTER (parse_ok) AS u, count(*) FILTER (parse_ok AND refused) AS ref, count(*) FILTER (is_a) AS num_source_answerable, count(*) FILTER (is_u) AS num_source_unanswerable, count(*) FILTER (e2e) AS num_e2e_answerability_success, count(*) FILTER (gate) AS content_eval_total,
                   count(*) FILTER (NOT gate AND parse_ok AND refused) AS num_refusal_or_unanswerable_skipped, count(correct) AS correctness_total, count(*) FILTER (correct) AS correctness_strict_ok, count(matcher_ok) AS correctness_matcher_review_total, count(*) FILTER (matcher_ok) AS correctness_matcher_positive,
                   count(*) FILTER (reviewed_ok) AS correctness_reviewed_ok, count(*) FILTER (e2e_correct) AS num_e2e_reviewed_correctness_success, count(s) AS semantic_total, count(*) FILTER (s.full = 'yes') AS semantic_yes, count(*) FILTER (e2e_semantic) AS num_e2e_semantic_success,
                   count(*) FILTER (is_a AND e2e_correct) AS num_answerable_reviewed_correctness_success, count(*) FILTER (is_a AND e2e_semantic) AS num_answerable_semantic_success, count(*) FILTER (is_u AND e2e) AS num_unanswerable_success, round(avg(s.margin), 6) AS semantic_margin_mean
            FROM d GROUP BY 1)
        SELECT n.* EXCLUDE (u, ref), {_share('u', 'num_rows')} AS extraction_parse_ok_rate, {_share('u', 'num_rows')} AS usable_rate, {_share('ref', 'num_rows')} AS refusal_detected_rate, {_share('num_e2e_answerability_success', 'num_rows')} AS e2e_answerability_accuracy, {_share('content_eval_total', 'num_rows')} AS content_eval_gate_rate,
               {_share('correctness_matcher_positive', 'correctness_matcher_review_total')} AS correctness_matcher_positive_rate, {_share('num_e2e_reviewed_correctness_success', 'num_rows')} AS e2e_reviewed_correctness_success_rate, {_share('num_e2e_semantic_success', 'num_rows')} AS e2e_semantic_success_rate,
               {_share('num_answerable_reviewed_correctness_success', 'num_source_answerable')} AS answerable_reviewed_correctness_success_rate, {_share('num_answerable_semantic_success', 'num_source_answerable')} AS answerable_semantic_success_rate, {_share('num_unanswerable_success', 'num_source_unanswerable')} AS unanswerable_success_rate FROM n""",
    "parsed_outputs": f"WITH {_STRUCT} SELECT gen_id, parse_ok, pred AS answerability, confidence, len(quotes)::INT AS n_quotes, md5(rationale) AS rationale_md5, md5(answer) AS answer_md5 FROM issues",
    "protocol_checks": f"WITH {_STRUCT} SELECT gen_id, unnest(issue) AS issue FROM issues",
    "validated_candidates": f"""WITH {_VALIDATED}
        SELECT gen_id, model_tag, parse_ok, n_reasons = 0 AS hard_pass, n_reasons::INT AS n_reasons, CASE WHEN parse_ok THEN {_words('completion')}::INT END AS completion_tokens, {_six('margin')} AS margin, {_six('support_rate')} AS support_rate, {_six('token_f1')} AS token_f1,
               selected, derived AS derived_confidence, said AS confidence, md5(completion) AS canonical_md5 FROM final""",
    "validation_counts": f"""WITH {_VALIDATED}
        SELECT model_tag, gold AS answerability_label, count(*) AS num_rows, count(*) FILTER (parse_ok) AS num_parse_ok, count(*) FILTER (protocol_ok) AS num_protocol_ok, count(*) FILTER (evidence_ok) AS num_evidence_ok, count(*) FILTER (correct) AS num_correct,
               count(*) FILTER (decision = 'yes') AS num_semantic_yes, count(*) FILTER (n_reasons = 0) AS num_hard_pass, count(*) FILTER (selected) AS num_selected FROM final GROUP BY 1, 2""",
    "training_records": f"""WITH {_VALIDATED}
        SELECT rec_id::VARCHAR AS id, data_split, md5('{_HEAD}' || {_opt('know')} || chr(10) || chr(10) || 'Question: ' || {_opt('question')} || chr(10)) AS prompt_md5, md5(completion) AS completion_md5, said AS confidence, gold AS answerability_label
        FROM final WHERE selected AND (gold = 'unanswerable' OR derived IS NOT NULL)""",
    "judge_decisions": f"""
        WITH s AS (SELECT DISTINCT ON (gen_id) gen_id, rec_id, answer FROM structured_outputs), g AS (SELECT DISTINCT ON (gen_id) gen_id, model_tag FROM api_generations),
        a AS (SELECT model_tag, CASE WHEN {_opt('knowledge')} <> '' THEN {_opt('knowledge')} || chr(10) ELSE '' END || 'Question: ' || {_opt('question')} AS premise, answer, question
              FROM s JOIN qa_examples USING (rec_id) JOIN g USING (gen_id) WHERE answer IS NOT NULL AND knowledge IS NOT NULL),
        d AS (SELECT model_tag, {_judge('premise', 'answer', 'question')} AS s FROM a)
        SELECT model_tag, count(*) AS num_rows, count(*) FILTER (s.full = 'yes') AS num_full_yes, count(*) FILTER (s.full = 'no') AS num_full_no, count(*) FILTER (s.reject = 'yes') AS num_reject_yes, count(*) FILTER (s.reject = 'no') AS num_reject_no,
               count(*) FILTER (s.reject = 'abstain') AS num_reject_abstain, count(*) FILTER (s.reject = 'abstain') / greatest(1, count(*)) AS abstain_rate FROM d GROUP BY 1""",
}

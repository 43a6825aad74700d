"""SQL for the core queries, written independently of the DataFrame plans."""

from __future__ import annotations

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _opt(x: str) -> str:
    return f"coalesce({_strip(x)}, '')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+', ' ', 'g')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+')"


def _words(x: str) -> str:
    return rf"len(regexp_extract_all(coalesce({x}, ''), '[^\s\x1c-\x1f\x{{85}}\p{{Z}}]+'))"


def _ratio(salt: str, key: str) -> str:
    return f"(('0x' || substr(sha1('{salt}:' || {key}), 1, 8))::UBIGINT / 4294967295.0)"


def _draw(tag: str) -> str:
    return f"('0x' || substr(sha1(seed || ':' || {tag}), 1, 8))::UBIGINT::BIGINT"


def _six(x: str) -> str:
    return f"round({x}, 6)"


_PROMPT = """('Return exactly one JSON object with fields in this order:
[''answerability'', ''evidence'', ''rationale'', ''answer'', ''confidence'']

Rules:
- If answerable, cite 1 to 4 quotes copied from the knowledge.
- Provide a short rationale showing how the evidence supports the answer.
- The rationale must not be identical to the answer.
- If unanswerable, set evidence to [] and use an allowed refusal template.
- In unanswerable cases, the rationale should briefly state what key information is missing, ambiguous, or contradictory.
- Keep the answer concise and directly responsive.
- Do not add explanations outside the JSON.

Refusal templates: I don''t know based on the provided knowledge.

Knowledge:
' || {k} || '

Question: ' || {q} || '
')"""
_LABEL = "lower(trim(answerability_label))"

_RAW = f"""
    raw AS (
        SELECT rec_id::VARCHAR AS id, {_opt('question')} AS question, {_opt('reference_answer')} AS ra, context_documents AS docs0, supporting_sentences AS ss,
               CASE WHEN rec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split
        FROM qa_examples),
    tags AS (
        SELECT id, split AS hotpot_source_split,
               CASE WHEN split = 'train' THEN 'train_sft_raw' WHEN {_ratio('data_split', 'id')} < 0.5 THEN 'validation' ELSE 'test' END AS data_split,
               CASE WHEN {_ratio('answerability_split', 'id')} < 0.7 / (0.7 + 0.1 + 0.2) THEN 'answerable' WHEN {_ratio('answerability_split', 'id')} < 0.7 / (0.7 + 0.1 + 0.2) + 0.1 / (0.7 + 0.1 + 0.2) THEN 'unanswerable' ELSE 'both' END AS answerability_split
        FROM raw)"""

_EXAMPLES = f"""
    clean AS (
        SELECT *, list_transform(coalesce(docs0, []), lambda d: {{'t': {_opt('d.title')}, 's': list_filter(list_transform(coalesce(d.sentences, []), lambda s: {_opt('s')}), lambda s: s <> '')}}) AS docs,
               list_transform(ss, lambda s: {{'t': {_opt('s.title')}, 'i': s.sent_id}}) AS pairs0
        FROM raw),
    paired AS (SELECT *, list_filter(pairs0, lambda x, i: list_position(pairs0, x) = i) AS pairs FROM clean),
    placed AS (
        SELECT *, list_transform(pairs, lambda p: {{'p': p, 's': list_filter(docs, lambda d: d.t = p.t AND d.t <> '')[-1].s}}) AS found
        FROM paired WHERE question <> '' AND ra <> '' AND len(pairs) BETWEEN 1 AND 4),
    windows AS (
        SELECT *, list_transform(found, lambda f: f.p.t || ': ' || array_to_string(f.s[greatest(1, f.p.i) : least(len(f.s), f.p.i + 2)], ' ')) AS texts
        FROM placed WHERE len(list_filter(found, lambda f: coalesce(f.p.i >= 0 AND f.p.i < len(f.s), false))) = len(found))"""

_ANSWERS = f"""
    s AS (SELECT DISTINCT ON (gen_id) * FROM structured_outputs),
    g AS (SELECT DISTINCT ON (gen_id) gen_id, model_tag, candidate_id FROM api_generations),
    a AS (
        SELECT s.gen_id, s.rec_id, s.evidence, s.answer, s.confidence, lower(trim(s.answerability)) AS pred, q.question, q.knowledge, q.reference_answer, lower(trim(q.answerability_label)) AS gold, g.model_tag
        FROM s JOIN qa_examples q USING (rec_id) JOIN g USING (gen_id))"""


def _nli(premise: str, hypothesis: str) -> str:
    return f"(CASE WHEN len({_tokens(hypothesis)}) > 0 THEN len(list_intersect(list_distinct({_tokens(hypothesis)}), {_tokens(premise)})) / len(list_distinct({_tokens(hypothesis)})) ELSE 0.0 END)"


def _margin(e: str, t: str = "2.17") -> str:
    """From the entailment share alone, as neutral and contradiction are fixed parts of the rest."""
    ln = lambda x: f"ln(greatest({x}, 1e-12)) / {t}"
    return f"({ln(e)} - greatest({ln(f'(1 - {e}) * 0.75')}, {ln(f'(1 - {e}) * 0.25')}))"


_SCORED = f"""{_ANSWERS},
    scored AS (SELECT gen_id, model_tag, {_nli('knowledge', 'answer')} AS e, pred = 'answerable' AS y FROM a WHERE answer IS NOT NULL AND knowledge IS NOT NULL AND pred IS NOT NULL)"""

_CAL = """
    logs AS (SELECT *, ln(greatest(e, 1e-12)) / t AS le, ln(greatest((1 - e) * 0.75, 1e-12)) / t AS ln_, ln(greatest((1 - e) * 0.25, 1e-12)) / t AS lc FROM tempered),
    cal0 AS (SELECT *, le - greatest(ln_, lc) AS margin, exp(le - greatest(le, ln_, lc)) AS pe, exp(ln_ - greatest(le, ln_, lc)) AS pn, exp(lc - greatest(le, ln_, lc)) AS pc FROM logs),
    cal AS (SELECT * EXCLUDE (pe, pn, pc), pe / (pe + pn + pc) AS pe, pn / (pe + pn + pc) AS pn, pc / (pe + pn + pc) AS pc FROM cal0)"""


def _f1(p: str, r: str) -> str:
    common = f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({r}, lambda x: x = t)))))"
    return f"(CASE WHEN len({p}) = 0 AND len({r}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({r}) = 0 THEN 0.0 ELSE 2.0 * {common} / (len({p}) + len({r})) END)"


def _stats(group: str, source: str, extra: str = "") -> str:
    """Counts of predictions ``p`` against labels ``y``, null predictions rejecting."""
    return f"""counts AS (
        SELECT {group}, count(*) AS num_rows, count(y) AS num_labeled, count(*) FILTER (p IS NOT NULL AND y IS NOT NULL) AS num_kept, count(*) FILTER (p AND y) AS tp, count(*) FILTER (NOT p AND NOT y) AS tn,
               count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM {source} GROUP BY {group}),
    stats AS (
        SELECT *, CASE WHEN num_kept > 0 THEN (tp + tn) / num_kept END AS accuracy, CASE WHEN num_kept > 0 THEN tp / greatest(1, tp + fp) END AS precision, CASE WHEN num_kept > 0 THEN tp / greatest(1, tp + fn) END AS recall{extra} FROM counts),
    scores AS (SELECT *, CASE WHEN num_kept > 0 THEN 2.0 * precision * recall / greatest(1e-12, precision + recall) END AS f1 FROM stats)"""


_CANDIDATES = """
    d AS (SELECT DISTINCT ON (gen_id) * FROM api_generations WHERE ok AND text IS NOT NULL),
    c AS (SELECT rec_id AS id, candidate_id, gen_id, length(text) > 3 AS hard_pass, CASE WHEN token_usage IS NOT NULL THEN round((token_usage.completion_tokens % 17) / 10.0, 6) END AS margin,
                 round((length(text) % 4) / 4.0, 6) AS support_rate, round((length(text) % 7) / 7.0, 6) AS token_f1, length(text) % 5 AS evidence_count FROM d)"""

_CURVE = """
    l AS (SELECT DISTINCT ON (gen_id) *, coalesce(text, '') AS t, coalesce(model_step, 0) AS step FROM local_generations),
    curve AS (
        SELECT model_tag, step AS model_step, count(*) AS num_rows, count(*) FILTER (length(trim(t)) > 0) / count(*) AS parse_ok, count(*) FILTER (length(t) > 3) / count(*) AS protocol_ok, count(*) FILTER (contains(t, 'e')) / count(*) AS evidence_ok,
               count(*) FILTER (ends_with(t, '.')) / count(*) AS correctness, count(*) FILTER (length(t) > 30) / count(*) AS answerability, count(*) FILTER (length(t) > 90) / count(*) AS semantic
        FROM l GROUP BY ALL),
    losses AS (
        SELECT model_tag, step AS model_step, count(*) AS num_used_rows, avg(length(text) / 7.0 / token_usage.completion_tokens) AS mean_loss, sum(length(text) / 7.0) / sum(token_usage.completion_tokens) AS per_token
        FROM l WHERE text IS NOT NULL AND token_usage.completion_tokens > 0 GROUP BY ALL),
    joined AS (SELECT c.*, o.mean_loss, parse_ok >= 0.9 AND protocol_ok >= 0.9 AND evidence_ok >= 0.9 AS pass FROM curve c LEFT JOIN losses o USING (model_tag, model_step)),
    chosen AS (
        SELECT *, row_number() OVER (ORDER BY NOT pass, correctness DESC, answerability DESC, semantic DESC, coalesce(mean_loss, 'inf'::DOUBLE), model_step, num_rows) AS place FROM joined WHERE model_tag <> 'base')"""

_TERCILE = "CASE WHEN n = 1 THEN 'medium' WHEN n = 2 THEN CASE WHEN r = 1 THEN '{0}' ELSE '{1}' END WHEN r <= n // 3 THEN '{0}' WHEN r > n - n // 3 THEN '{1}' ELSE 'medium' END"


def _terciles(low: str, high: str, columns: str) -> str:
    return f"""WITH {_CANDIDATES},
        ranked AS (SELECT *, row_number() OVER (ORDER BY margin, gen_id) AS r, count(*) OVER () AS n FROM c WHERE margin IS NOT NULL)
        SELECT {columns}, {_TERCILE.format(low, high)} AS derived_confidence FROM ranked UNION ALL SELECT {columns}, NULL FROM c WHERE margin IS NULL"""


def _premise() -> str:
    return f"(CASE WHEN {_opt('knowledge')} <> '' THEN {_opt('knowledge')} || '\nQuestion: ' ELSE 'Question: ' END || {_opt('question')})"


_GRID_MARGINS = "[" + ", ".join(f"{-0.95 + 0.2 * k:.10g}" for k in range(11)) + "]"

_NEGATIVES = f"""
        seeded AS (
            SELECT w.*, CASE WHEN t.answerability_split = 'both' THEN 'paired_answerable' ELSE 'external_raw' END AS track,
                   '42:' || w.id || '::answerable::' || CASE WHEN t.answerability_split = 'both' THEN 'paired_answerable' ELSE 'external_raw' END || '::' || t.answerability_split AS seed
            FROM windows w JOIN tags t USING (id)),
        drawn AS (SELECT *, list_sort(list_transform(generate_series(0, len(pairs) - 1), lambda i: {{'h': {_draw("'s' || i")}, 'i': i}}))[1].i AS r FROM seeded),
        picked AS (
            SELECT *, found[r + 1].p AS p, found[r + 1].s AS s, len(docs) - list_position(list_reverse(list_transform(docs, lambda d: d.t)), found[r + 1].p.t) AS last FROM drawn),
        free AS (SELECT *, list_filter(generate_series(0, len(s) - 1), lambda j: NOT list_contains(pairs, {{'t': p.t, 'i': j::INT}})) AS f FROM picked),
        near AS (SELECT *, CASE WHEN len(list_filter(f, lambda j: abs(j - p.i) <= 1)) > 0 THEN list_filter(f, lambda j: abs(j - p.i) <= 1) ELSE f END AS c FROM free),
        options AS (
            SELECT *, CASE WHEN len(c) > 0 THEN list_transform(c, lambda j: {{'t': p.t, 'i': j, 's': s[j + 1]}})
                           ELSE list_transform(list_filter([last - 1, last + 1], lambda k: k >= 0 AND k < len(docs) AND len(docs[k + 1].s) > 0), lambda k: {{'t': docs[k + 1].t, 'i': 0::BIGINT, 's': docs[k + 1].s[1]}}) END AS o
            FROM near),
        chosen AS (SELECT *, o[({_draw("'c' || r")} % len(o)) + 1] AS x FROM options WHERE len(o) > 0),
        blocks AS (
            SELECT *, list_transform(texts, lambda w, i: CASE WHEN i = r + 1 THEN CASE WHEN x.t <> '' THEN x.t || ': ' || x.s ELSE x.s END ELSE w END) AS b,
                   array_to_string(list_filter(texts, lambda w, i: list_position(texts, w) = i), '\n\n') AS before FROM chosen),
        joined AS (SELECT *, array_to_string(list_filter(b, lambda w, i: list_position(b, w) = i), '\n\n') AS after FROM blocks)"""

SQL: dict[str, str] = {
    "split_tags": f"WITH {_RAW} SELECT * FROM tags",
    "split_tag_counts": f"""WITH {_RAW}
        SELECT 'data_split' AS dim, data_split AS value, count(*) AS n FROM tags GROUP BY ALL UNION ALL SELECT 'answerability_split', answerability_split, count(*) FROM tags GROUP BY ALL
        UNION ALL SELECT 'hotpot_source_split', hotpot_source_split, count(*) FROM tags GROUP BY ALL""",
    "answerable_examples": f"""WITH {_RAW}, {_EXAMPLES}
        SELECT id, question, ra AS reference_answer, len(pairs)::INT AS n_supports, md5(array_to_string(list_filter(texts, lambda x, i: list_position(texts, x) = i), '\n\n')) AS knowledge_md5, len(docs)::INT AS n_docs FROM windows""",
    "negative_examples": f"""WITH {_RAW}, {_EXAMPLES}, {_NEGATIVES}
        SELECT id, track AS origin_track, md5(after) AS knowledge_md5, p.i::INT AS replaced, x.i::INT AS replacement, x.t AS title FROM joined WHERE after <> '' AND after <> before""",
    "prepared_examples": f"""WITH {_RAW}, {_EXAMPLES}, {_NEGATIVES},
        made AS (
            SELECT 'answerable' AS variant_id, 'answerable' AS answerability_label, t.data_split, array_to_string(list_filter(texts, lambda x, i: list_position(texts, x) = i), '\n\n') AS k FROM windows JOIN tags t USING (id) WHERE t.answerability_split IN ('answerable', 'both')
            UNION ALL
            SELECT CASE WHEN track = 'paired_answerable' THEN 'unanswerable-paired-v1' ELSE 'unanswerable-external-v1' END, 'unanswerable', t.data_split, after FROM joined JOIN tags t USING (id) WHERE after <> '' AND after <> before AND t.answerability_split IN ('unanswerable', 'both'))
        SELECT variant_id, answerability_label, data_split, count(*) AS n, count(DISTINCT k) AS n_knowledge FROM made GROUP BY ALL""",
    "sentence_windows": f"""
        WITH d AS (SELECT rec_id, unnest(generate_series(1, len(context_documents))) AS k, context_documents AS c FROM qa_examples WHERE len(context_documents) > 0),
        s AS (SELECT rec_id, k - 1 AS doc, coalesce(c[k].title, '') AS title, list_transform(c[k].sentences, lambda x: {_strip('x')}) AS s, unnest(generate_series(1, len(c[k].sentences))) AS j FROM d WHERE len(c[k].sentences) > 0),
        w AS (SELECT *, {_strip("array_to_string(list_filter(s[greatest(1, j - 1) : least(len(s), j + 1)], lambda x: coalesce(x <> '', false)), ' ')")} AS body FROM s)
        SELECT rec_id, doc::INT AS doc, (j - 1)::INT AS sent, md5(CASE WHEN title <> '' THEN title || ': ' || body ELSE body END) AS block_md5 FROM w""",
    "prompt_budget": f"""WITH p AS (SELECT rec_id, {_words(_PROMPT.format(k=_opt('knowledge'), q=_opt('question')))} AS n FROM qa_examples) SELECT rec_id, n::INT AS prompt_tokens, n <= 512 AS within_budget FROM p""",
    "prompt_round_trip": f"SELECT rec_id, md5({_opt('knowledge')}) AS knowledge_md5, {_opt('question')} AS question FROM qa_examples",
    "partition_counts": f"SELECT {_strip('data_split')} AS data_split, count(*) AS n FROM qa_examples WHERE {_opt('data_split')} <> '' GROUP BY 1",
    "candidate_fanout": f"""
        WITH q AS (SELECT rec_id, {_LABEL} AS label FROM qa_examples)
        SELECT rec_id, label AS answerability_label, unnest(generate_series(0, CASE WHEN label = 'answerable' THEN 2 ELSE 0 END))::INT AS candidate_id FROM q WHERE label IN ('answerable', 'unanswerable')""",
    "error_log": "SELECT g.call_index, g.model_tag, g.error_type, g.error_message, substr(q.question, 1, 500) AS prompt_preview FROM api_generations g JOIN qa_examples q USING (rec_id) WHERE NOT g.ok",
    "token_usage": f"""
        SELECT model_tag, CASE WHEN token_usage.completion_tokens IS NOT NULL THEN 'provider' ELSE 'estimated' END AS source, count(*) AS n, sum(coalesce(token_usage.completion_tokens, {_words('text')}))::BIGINT AS completion_tokens
        FROM api_generations GROUP BY 1, 2""",
    "question_types": rf"""
        WITH q AS (SELECT *, lower({_opt('question')}) AS l FROM qa_examples)
        SELECT rec_id, CASE WHEN starts_with(l, 'who') THEN 'who' WHEN starts_with(l, 'where') THEN 'where' WHEN starts_with(l, 'when') THEN 'when' WHEN starts_with(l, 'how many') OR starts_with(l, 'how much') THEN 'how_many' ELSE 'other' END AS question_type,
               regexp_matches(' ' || coalesce(reference_answer, '') || ' ', '[^\p{{L}}\p{{N}}_][0-9]{{4}}[^\p{{L}}\p{{N}}_]') AS has_year FROM q""",
    "normalized_answers": f"SELECT rec_id, array_to_string({_tokens('question')}, ' ') AS normalized FROM qa_examples",
    "sanitized_generations": f"SELECT DISTINCT gen_id, {_strip('text')} AS sanitized FROM local_generations WHERE text IS NOT NULL",
    "answer_token_f1": f"""WITH {_ANSWERS},
        t AS (SELECT gen_id, {_tokens('answer')} AS p, {_tokens('reference_answer')} AS r FROM a WHERE answer IS NOT NULL AND reference_answer IS NOT NULL),
        f AS (SELECT gen_id, p = r AS same, {_f1('p', 'r')} AS f1 FROM t)
        SELECT gen_id, same OR f1 >= 0.85 AS ok, same AS exact_match, {_six('f1')} AS token_f1 FROM f""",
    "evidence_match": f"""WITH {_ANSWERS},
        t AS (SELECT gen_id, list_transform(list_filter(evidence, lambda e: e IS NOT NULL), lambda e: {_collapse(_opt('e.quote'))}) AS q, {_collapse('knowledge')} AS k FROM a WHERE evidence IS NOT NULL AND knowledge IS NOT NULL),
        h AS (SELECT *, len(list_filter(q, lambda x: x <> '' AND contains(k, x))) AS hit FROM t)
        SELECT gen_id, hit = len(q) AS ok, {_six('hit / greatest(1, len(q))')} AS match_rate, len(list_distinct(q))::INT AS unique_quotes, (len(q) - hit)::INT AS outside FROM h""",
    "judge_margins": f"""WITH {_SCORED}, tempered AS (SELECT *, 2.17 AS t FROM scored), {_CAL}
        SELECT gen_id, {_six('margin')} AS margin, {_six('pe')} AS p_entail, CASE WHEN pe >= pn AND pe >= pc THEN 'entail' WHEN pn >= pc THEN 'neutral' ELSE 'contradict' END AS argmax_label, margin >= 0.4 AS full,
               CASE WHEN abs(margin - 0.6) <= 0.05 THEN 'abstain' WHEN margin >= 0.6 THEN 'yes' ELSE 'no' END AS reject FROM cal""",
    "answer_deviation": f"""WITH {_ANSWERS},
        f AS (SELECT gen_id, {_premise()} AS premise, 'chosen' AS field, {_opt('reference_answer')} AS answer FROM a WHERE knowledge IS NOT NULL
              UNION ALL SELECT gen_id, {_premise()}, 'rejected', CASE WHEN pred = 'unanswerable' THEN {_opt('answer')} ELSE '' END FROM a WHERE knowledge IS NOT NULL),
        n AS (SELECT gen_id, field, {_nli('premise', 'answer')} AS e FROM f WHERE answer <> ''),
        d AS (SELECT gen_id, field, CASE WHEN field = 'chosen' THEN NOT (e >= 0.6 AND (1 - e) * 0.25 <= 0.9) ELSE e >= 0.6 AND (1 - e) * 0.25 <= 0.9 END AS dev FROM n),
        r AS (SELECT gen_id, bool_or(dev) AS any_dev, count(*) FILTER (field = 'chosen') AS nc, count(*) FILTER (field = 'rejected') AS nr, count(*) FILTER (field = 'chosen' AND dev) AS dc, count(*) FILTER (field = 'rejected' AND dev) AS dr FROM d GROUP BY 1)
        SELECT count(*) AS num_rows, sum(nc)::BIGINT AS num_chosen, sum(nr)::BIGINT AS num_rejected, sum(dc)::BIGINT AS chosen_deviation, sum(dr)::BIGINT AS rejected_deviation, count(*) FILTER (any_dev) AS rows_with_deviation,
               CASE WHEN sum(nc) > 0 THEN sum(dc) / sum(nc) ELSE 0.0 END AS chosen_rate, CASE WHEN sum(nr) > 0 THEN sum(dr) / sum(nr) ELSE 0.0 END AS rejected_rate, CASE WHEN count(*) > 0 THEN count(*) FILTER (any_dev) / count(*) ELSE 0.0 END AS row_rate FROM r""",
    "source_prefilter": f"""
        WITH q AS (SELECT *, {_LABEL} AS label, {_words(_PROMPT.format(k=_opt('knowledge'), q=_opt('question')))} <= 512 AS within, {_premise()} AS premise, lower({_opt('reference_answer')}) AS yn FROM qa_examples),
        s AS (SELECT label, within, {_nli('premise', "('The answer is ' || " + _opt('reference_answer') + " || '.')")} AS e, CASE WHEN yn = 'yes' THEN {_nli('premise', "'The answer is no.'")} WHEN yn = 'no' THEN {_nli('premise', "'The answer is yes.'")} END AS f FROM q),
        m AS (SELECT label, within, {_margin('e')} < 0.4 AND coalesce({_margin('f')} < 0.4, true) AS keep, f, within AND coalesce(label = 'unanswerable', false) AS checked FROM s),
        k AS (SELECT *, within AND (NOT checked OR keep) AS kept FROM m)
        SELECT label AS answerability_label, count(*) AS num_input, count(*) FILTER (kept) AS num_kept, count(*) FILTER (NOT kept) AS num_dropped, count(*) FILTER (NOT within) AS num_drop_prompt_budget, count(*) FILTER (checked) AS num_unanswerable_checked,
               count(*) FILTER (checked AND kept) AS num_unanswerable_kept, count(*) FILTER (checked AND NOT kept) AS num_unanswerable_nli_drop, count(*) FILTER (checked AND f IS NOT NULL) AS num_unanswerable_yes_no_checked FROM k GROUP BY 1""",
    "prefiltered_examples": f"""
        WITH q AS (SELECT rec_id, {_LABEL} AS label, {_words(_PROMPT.format(k=_opt('knowledge'), q=_opt('question')))} AS tokens, {_premise()} AS premise, reference_answer, lower({_opt('reference_answer')}) AS yn FROM qa_examples),
        s AS (SELECT *, {_margin(_nli('premise', "('The answer is ' || " + _opt('reference_answer') + " || '.')"))} AS m, CASE WHEN yn = 'yes' THEN {_margin(_nli('premise', "'The answer is no.'"))} WHEN yn = 'no' THEN {_margin(_nli('premise', "'The answer is yes.'"))} END AS f FROM q),
        k AS (SELECT *, tokens <= 512 AND coalesce(label = 'unanswerable', false) AS checked FROM s)
        SELECT rec_id, tokens::INT AS prompt_tokens, tokens <= 512 AND (NOT checked OR (m < 0.4 AND coalesce(f < 0.4, true))) AS kept, CASE WHEN checked THEN CASE WHEN m < 0.4 THEN 'no' ELSE 'yes' END END AS decision, CASE WHEN checked THEN {_six('CASE WHEN f IS NOT NULL THEN (m + f) / 2 ELSE m END')} END AS score FROM k""",
    "best_candidates": f"""WITH {_CANDIDATES},
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(margin, '-inf'::DOUBLE) DESC, support_rate DESC, token_f1 DESC, CASE WHEN evidence_count = 0 THEN 'inf'::DOUBLE ELSE evidence_count END, candidate_id, gen_id) AS k, min(gen_id) OVER (PARTITION BY id) AS group_order FROM c WHERE hard_pass)
        SELECT id, candidate_id, gen_id, margin, group_order FROM r WHERE k = 1""",
    "first_valid": f"WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY candidate_id, gen_id) AS k, min(gen_id) OVER (PARTITION BY id) AS group_order FROM c WHERE hard_pass) SELECT id, candidate_id, gen_id, group_order FROM r WHERE k = 1",
    "confidence_terciles": _terciles("low", "high", "gen_id, margin"),
    "reverse_terciles": _terciles("high", "low", "gen_id"),
    "token_correlations": f"""
        WITH p AS (SELECT model_tag, token_usage.prompt_tokens::DOUBLE AS x, token_usage.completion_tokens::DOUBLE AS y FROM api_generations WHERE token_usage.prompt_tokens IS NOT NULL AND token_usage.completion_tokens IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY model_tag ORDER BY x) + (count(*) OVER (PARTITION BY model_tag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model_tag ORDER BY y) + (count(*) OVER (PARTITION BY model_tag, y) - 1) / 2.0 AS ry FROM p)
        SELECT model_tag, {_six('corr(x, y)')} AS pearson, {_six('corr(rx, ry)')} AS spearman, count(*) AS n FROM r GROUP BY 1""",
    "confidence_resolution": f"""WITH {_ANSWERS},
        y AS (SELECT model_tag, lower(confidence) AS b, (pred = gold)::INT::DOUBLE AS y FROM a WHERE gold IS NOT NULL AND confidence IS NOT NULL AND pred IS NOT NULL),
        t AS (SELECT model_tag, avg(y) AS mu, count(*) AS n FROM y GROUP BY 1),
        k AS (SELECT y.model_tag, b, avg(y) AS m, count(*) AS c FROM y GROUP BY 1, 2)
        SELECT t.model_tag, CASE WHEN max(mu) * (1 - max(mu)) > 0 THEN {_six('sum(c / n * (m - mu) ^ 2) / (max(mu) * (1 - max(mu)))')} END AS resolution, max(n) AS n FROM t JOIN k USING (model_tag) GROUP BY 1""",
    "confidence_levels": f"""WITH {_ANSWERS},
        y AS (SELECT model_tag, lower(confidence) AS confidence, (pred = gold)::INT::DOUBLE AS y FROM a WHERE gold IS NOT NULL),
        d AS (SELECT DISTINCT model_tag, unnest(['high', 'medium', 'low']) AS confidence FROM y),
        k AS (SELECT model_tag, confidence, avg(y) AS m, count(*) AS c FROM y GROUP BY 1, 2)
        SELECT model_tag, confidence, coalesce(c, 0) AS n, {_six('m')} AS accuracy FROM d LEFT JOIN k USING (model_tag, confidence)""",
    "deduplicated_records": f"""SELECT min(rec_id) AS rec_id FROM qa_examples GROUP BY coalesce(id, ''), coalesce(source_id, ''), coalesce(variant_id, ''), {_opt('answerability_label')}, coalesce(question, ''), coalesce(knowledge, ''), coalesce(reference_answer, '')""",
    "capped_sample": f"""
        WITH q AS (SELECT rec_id, {_LABEL} AS label, sha1('42:' || rec_id) AS h FROM qa_examples),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, rec_id) AS k FROM q),
        s AS (SELECT *, row_number() OVER (ORDER BY h, rec_id) AS spot FROM r WHERE CASE label WHEN 'answerable' THEN k <= 60 WHEN 'unanswerable' THEN k <= 40 ELSE true END)
        SELECT rec_id, label AS answerability_label FROM s WHERE spot <= 90""",
    "prepared_training_set": f"""
        WITH q AS (SELECT *, {_opt(_LABEL)} AS label, CASE WHEN lower(trim(data_split)) IN ('validation', 'test') THEN lower(trim(data_split)) ELSE 'train' END AS split FROM qa_examples),
        u AS (SELECT *, row_number() OVER (PARTITION BY coalesce(id, ''), coalesce(source_id, ''), coalesce(variant_id, ''), label, coalesce(question, ''), coalesce(knowledge, ''), coalesce(reference_answer, '') ORDER BY rec_id) AS dup FROM q),
        p AS (SELECT rec_id, id, split, label, {_opt('reference_answer')} AS completion, CASE WHEN {_opt('knowledge')} <> '' AND {_opt('question')} <> '' THEN {_PROMPT.format(k=_opt('knowledge'), q=_opt('question'))} ELSE '' END AS prompt FROM u WHERE dup = 1),
        t AS (SELECT *, {_words('prompt')} AS n, {_words('completion')} AS m, sha1(CASE split WHEN 'train' THEN '53:' WHEN 'validation' THEN '65:' ELSE '79:' END || id) AS h FROM p WHERE prompt <> '' AND (completion <> '' OR split = 'test')),
        b AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY h, rec_id) AS k FROM t WHERE n <= 512 AND m <= 512),
        c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, rec_id) AS spot FROM b WHERE CASE label WHEN 'answerable' THEN k <= CASE split WHEN 'train' THEN 8000 ELSE 400 END WHEN 'unanswerable' THEN k <= CASE split WHEN 'train' THEN 2000 ELSE 100 END ELSE true END)
        SELECT split AS data_split, label AS answerability_label, count(*) AS n, max(n)::INT AS max_prompt_tokens FROM c WHERE spot <= CASE split WHEN 'train' THEN 10000 ELSE 500 END GROUP BY 1, 2""",
    "selective_answerability": f"""WITH {_ANSWERS},
        py AS (SELECT model_tag, CASE WHEN lower(confidence) <> 'low' THEN pred = 'answerable' END AS p, gold = 'answerable' AS y FROM a), {_stats('model_tag', 'py')},
        k AS (SELECT *, (tp + fp) / greatest(1, num_kept) * (tp + fn) / greatest(1, num_kept) + (1 - (tp + fp) / greatest(1, num_kept)) * (1 - (tp + fn) / greatest(1, num_kept)) AS chance FROM scores)
        SELECT model_tag, num_rows, num_labeled, num_kept, tp, tn, fp, fn, CASE WHEN num_labeled > 0 THEN {_six('num_kept / num_labeled')} END AS coverage, CASE WHEN num_labeled > 0 THEN {_six('(num_labeled - num_kept) / num_labeled')} END AS reject_rate,
               {_six('accuracy')} AS accuracy, {_six('precision')} AS precision, {_six('recall')} AS recall, {_six('f1')} AS f1, CASE WHEN num_kept > 0 AND abs(1 - chance) >= 1e-12 THEN {_six('(accuracy - chance) / (1 - chance)')} END AS cohen_kappa,
               CASE WHEN num_labeled > 0 THEN {_six('CASE WHEN num_kept > 0 THEN 1 - accuracy ELSE 1.0 END + 0.5 * (num_labeled - num_kept) / num_labeled')} END AS lagrangian_objective FROM k""",
    "temperature_fit": f"""WITH {_SCORED}, tempered AS (SELECT *, unnest(generate_series(1, 40)) * 0.25 AS t FROM scored), {_CAL},
        n AS (SELECT model_tag, t, round(avg(-ln(CASE WHEN y THEN least(greatest(pe, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest(pe, 1e-12), 1 - 1e-12) END)), 12) AS nll FROM cal WHERE y IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY model_tag ORDER BY nll, t) AS k FROM n)
        SELECT model_tag, round(t, 2)::DOUBLE AS temperature, {_six('nll')} AS fit_nll FROM r WHERE k = 1""",
    "best_settings": f"""WITH {_SCORED}, tempered AS (SELECT *, round(0.05 + 0.01 * unnest(generate_series(0, 495)), 10) AS t FROM scored), {_CAL},
        n AS (SELECT model_tag, t, round(avg(-ln(CASE WHEN y THEN least(greatest(pe, 1e-12), 1 - 1e-12) ELSE 1 - least(greatest(pe, 1e-12), 1 - 1e-12) END)), 12) AS nll FROM cal WHERE y IS NOT NULL GROUP BY 1, 2),
        fit AS (SELECT model_tag, t FROM (SELECT *, row_number() OVER (PARTITION BY model_tag ORDER BY nll, t) AS k FROM n) WHERE k = 1),
        z AS (SELECT model_tag, y, margin, pe >= pn AND pe >= pc AS is_top FROM cal JOIN fit USING (model_tag, t)),
        settings AS (SELECT 0 AS ordinal, 'argmax' AS method, NULL::DOUBLE AS mt UNION ALL SELECT 1 + i, 'margin', round(0.05 * i, 10) FROM generate_series(0, 20) AS x(i)),
        py AS (SELECT model_tag, ordinal, method, mt, y, CASE method WHEN 'argmax' THEN is_top ELSE margin >= mt END AS p FROM z, settings),
        {_stats('model_tag, ordinal, method, mt', 'py')},
        best AS (SELECT *, row_number() OVER (PARTITION BY model_tag ORDER BY coalesce(f1, '-inf'::DOUBLE) DESC, coalesce(accuracy, '-inf'::DOUBLE) DESC, ordinal) AS place FROM scores)
        SELECT model_tag, ordinal::INT AS ordinal, method, mt AS margin_threshold, {_six('f1')} AS f1 FROM best WHERE place = 1""",
    "grid_search": f"""WITH {_SCORED}, tempered AS (SELECT *, 2.17 AS t FROM scored), {_CAL},
        z AS (SELECT model_tag, y, round(margin, 9) AS margin, round(greatest(pe, pn, pc), 9) AS top, pe >= pn AND pe >= pc AS is_top FROM cal),
        m AS (SELECT unnest({_GRID_MARGINS}) AS v, unnest(generate_series(0, 10)) AS i),
        settings AS (SELECT 0 AS ordinal, 'argmax' AS method, NULL::DOUBLE AS mt, NULL::DOUBLE AS ct, NULL::DOUBLE AS bw
              UNION ALL SELECT 1 + i, 'margin', v, NULL, NULL FROM m
              UNION ALL SELECT 12 + i, 'argmax_with_reject', NULL, round(0.45 + 0.1 * i, 10), NULL FROM generate_series(0, 5) AS x(i)
              UNION ALL SELECT 18 + 2 * i + j, 'margin_with_reject_band', v, NULL, CASE j WHEN 0 THEN 0.07 ELSE 0.23 END FROM m, generate_series(0, 1) AS y(j)),
        py AS (SELECT model_tag, ordinal, method, y, CASE method WHEN 'argmax' THEN is_top WHEN 'margin' THEN margin >= mt WHEN 'argmax_with_reject' THEN CASE WHEN top >= ct THEN is_top END ELSE CASE WHEN abs(margin - mt) > bw THEN margin >= mt END END AS p FROM z, settings),
        {_stats('model_tag, ordinal, method', 'py')}
        SELECT model_tag, ordinal::INT AS ordinal, method, num_kept, tp, tn, fp, fn, {_six('f1')} AS f1 FROM scores""",
    "matcher_grid": f"""WITH {_ANSWERS},
        t AS (SELECT model_tag, {_tokens('answer')} AS p, {_tokens('reference_answer')} AS r, gold = 'answerable' AS y FROM a WHERE answer IS NOT NULL AND reference_answer IS NOT NULL AND gold IS NOT NULL),
        f AS (SELECT model_tag, y, round({_f1('p', 'r')}, 9) AS f1 FROM t),
        py AS (SELECT model_tag, i AS ordinal, y, f1 >= round(0.11 + 0.2 * i, 10) AS p FROM f, generate_series(0, 4) AS x(i)), {_stats('model_tag, ordinal', 'py')}
        SELECT model_tag, ordinal::INT AS ordinal, num_labeled, tp, tn, fp, fn, {_six('f1')} AS f1 FROM scores""",
    "human_labels": "SELECT coalesce(answerability, '') AS task_type, count(*) AS num_rows, count(*) FILTER (lower(confidence) IN ('high', 'low')) AS num_labeled FROM structured_outputs GROUP BY 1",
    "sampled_sources": f"""
        WITH k AS (SELECT DISTINCT {_opt('source_id')} AS k FROM api_generations), c AS (SELECT k FROM k ORDER BY sha1('7:' || k), k LIMIT 50)
        SELECT DISTINCT gen_id, source_id FROM api_generations WHERE {_opt('source_id')} IN (SELECT k FROM c)""",
    "loss_curve": f"WITH {_CURVE} SELECT model_tag, model_step, num_used_rows, {_six('mean_loss')} AS mean_loss, {_six('per_token')} AS mean_nll_per_token, {_six('per_token')} AS log_perplexity FROM losses",
    "curve_with_losses": f"WITH {_CURVE} SELECT model_tag, model_step, num_rows, {_six('parse_ok')} AS parse_ok_rate, {_six('mean_loss')} AS mean_loss, pass AS constraint_pass FROM joined",
    "checkpoint_choice": f"""WITH {_CURVE} SELECT model_tag, model_step, model_tag || '/' || model_step AS model_path, pass AS constraint_satisfied, (SELECT count(*) FROM chosen) AS num_candidates, (SELECT count(*) FROM chosen WHERE pass) AS num_constraint_pass FROM chosen WHERE place = 1""",
    "checkpoint_summary": f"WITH {_CURVE} SELECT model_tag, model_step, pass AS constraint_satisfied, place = 1 AS selected_best FROM chosen",
    "hallucination_summary": f"""WITH {_CURVE},
        d AS (SELECT model_tag, step, gen_id, source_id, length(t) % 3 <> 0 AS ans, length(t) % 3 = 0 AS un, length(t) % 2 = 0 AS ok, length(t) % 5 <> 0 AS has, CASE WHEN length(t) % 7 <> 0 THEN length(t) % 4 < 2 END AS success, length(t) % 10 / 10.0 AS score, length(t) % 7 = 0 AS err FROM l)
        SELECT model_tag, step AS model_step, count(*) FILTER (has) AS deepeval_num_cases, count(success) FILTER (has) AS deepeval_num_scored, count(*) FILTER (has AND success) AS deepeval_pass_count, count(*) FILTER (has AND err) AS deepeval_num_errors,
               {_six('avg(score) FILTER (has)')} AS score_mean, count(*) FILTER (CASE WHEN un THEN ok WHEN ans AND ok THEN coalesce(has AND success, false) ELSE false END) AS num_e2e_deepeval_success,
               {_six('count(*) FILTER (CASE WHEN un THEN ok WHEN ans AND ok THEN coalesce(has AND success, false) ELSE false END) / count(*)')} AS e2e_pass_rate
        FROM d GROUP BY 1, 2""",
    "merged_curves": f"""WITH {_CURVE}
        SELECT model_tag, model_step::VARCHAR AS model_step, model_tag || '/' || model_step AS model_path, 'sft_structured' AS eval_track, 'checkpoint' AS eval_variant, num_rows::VARCHAR AS num_rows FROM curve
        UNION ALL SELECT DISTINCT model_tag, '0', 'nan', 'base_task', 'nan', 'nan' FROM api_generations""",
    "enriched_details": """
        WITH s AS (SELECT coalesce(l.source_id, '') AS s, coalesce(l.model_tag, '') AS m, q.question, row_number() OVER (PARTITION BY coalesce(l.source_id, ''), coalesce(l.model_tag, '') ORDER BY l.gen_id DESC) AS k FROM local_generations l JOIN qa_examples q USING (rec_id))
        SELECT DISTINCT l.gen_id, s.question FROM local_generations l LEFT JOIN s ON s.s = coalesce(l.source_id, '') AND s.m = coalesce(l.model_tag, '') AND s.k = 1""",
    "label_vocabulary": f"SELECT CASE lower({_opt('answerability')}) WHEN 'answerable' THEN true WHEN 'unanswerable' THEN false END AS label, count(*) AS n FROM structured_outputs GROUP BY 1",
    "seeded_order": "SELECT rec_id, row_number() OVER (ORDER BY sha1('42:' || rec_id), rec_id) AS place FROM qa_examples",
}

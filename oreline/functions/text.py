"""Text functions: canonical forms, answer tokens, prompts. JVM-side but for two Arrow UDFs
(compatibility normalization with entity decoding, and canonical JSON)."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULTS
from .coerce import let, opt_str, strip

_DROPPED = re.compile("[﻿​‌‍⁠]")
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
_TOKEN = r"([\p{L}\p{N}_]+)"


def _canonical(text: str) -> str:
    text = unicodedata.normalize("NFKC", html.unescape(text)).replace("\r\n", "\n").replace("\r", "\n")
    return _DROPPED.sub("", text).strip()


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_canonical, na_action="ignore")


def canonical(c: Column) -> Column:
    """Entities decoded, NFKC, line ends as LF, zero-width characters dropped, stripped."""
    return _canonical_udf(F.coalesce(c.cast("string"), F.lit("")))


def collapse(c: Column) -> Column:
    """White space runs as one blank."""
    return F.regexp_replace(c, _SPACE, " ")


def normalized(c: Column) -> Column:
    """Canonical form with collapsed white space: what quotes and refusals are compared in."""
    return collapse(canonical(c))


def answer_tokens(c: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_TOKEN), 1)


def normalized_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 over token multisets; 1 if both are empty, 0 if one is. For answers, not documents: the
    overlap is counted per distinct token."""
    return multiset_f1(F.struct(answer_tokens(prediction).alias("p"), answer_tokens(reference).alias("r")))


def multiset_f1(tokens: Column) -> Column:
    """F1 of the arrays ``p`` and ``r`` of a struct."""

    def score(x: Column) -> Column:
        p, r = x["p"], x["r"]
        common = F.aggregate(F.array_intersect(p, r), F.lit(0), lambda acc, t: acc + F.least(F.size(F.filter(p, lambda w: w == t)), F.size(F.filter(r, lambda w: w == t))))
        n = F.size(p) + F.size(r)
        return F.when(n == 0, F.lit(1.0)).when((F.size(p) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(2.0 * common / n)

    return let(tokens, score)


def json_span(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def sanitized(c: Column, think: bool = True, roles: bool = True) -> Column:
    """Generated text after its last ``assistant`` line, without role lines and think blocks."""
    out = strip(F.coalesce(c, F.lit("")))
    if roles:
        out = strip(F.regexp_replace(out, r"(?is)^.*assistant\n", ""))
        out = strip(F.regexp_replace(out, r"(?i)^(?:\s*(?:system|user|assistant)\s*\n)+", ""))
    return strip(F.regexp_replace(out, r"(?is)<think>.*?</think>", "")) if think else out


def numbers(c: Column) -> Column:
    """Numbers, also with thousands commas, decimals or a percent sign."""
    return F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?)(?![\p{L}\p{N}_])"), 1)


def has_year(c: Column) -> Column:
    return c.rlike(r"(?<![\p{L}\p{N}_])\d{4}(?![\p{L}\p{N}_])")


def question_type(c: Column) -> Column:
    q = F.lower(opt_str(c))
    return (
        F.when(q.startswith("who"), "who").when(q.startswith("where"), "where").when(q.startswith("when"), "when")
        .when(q.startswith("how many") | q.startswith("how much"), "how_many").otherwise("other")
    )


def question_of_prompt(c: Column) -> Column:
    p = opt_str(c)
    return F.when(p.startswith("Question:"), strip(F.substr(p, F.lit(10)))).when(p.contains("\nQuestion:"), strip(F.substring_index(p, "\nQuestion:", -1))).otherwise(F.lit(""))


def split_prompt(c: Column) -> Column:
    """Struct ``knowledge, question`` taken from the last ``Knowledge:`` block of a prompt and the
    last question after it."""
    p = F.coalesce(c, F.lit(""))
    tail = F.substring_index(p, "\nKnowledge:\n", -1)
    at = F.instr(F.reverse(tail), ":noitseuQ")
    head = F.when(at > 0, F.substr(tail, F.lit(1), F.length(tail) - at - 8)).otherwise(tail)
    asked = F.when(at > 0, F.substr(tail, F.length(tail) - at + 2)).otherwise(F.lit(None))
    has = p.contains("\nKnowledge:\n")
    return F.struct(
        F.when(has, strip(head)).otherwise(F.lit("")).alias("knowledge"),
        F.when(has & asked.isNotNull() & asked.startswith(" "), strip(asked)).when(has & asked.isNotNull(), F.lit("")).otherwise(question_of_prompt(p)).alias("question"),
    )


def qa_premise(knowledge: Column, question: Column) -> Column:
    k, q = opt_str(knowledge), opt_str(question)
    return F.when(k != "", F.concat(k, F.lit("\nQuestion: "), q)).otherwise(F.concat(F.lit("Question: "), q))


def rationale_answer(rationale: Column, answer: Column) -> Column:
    return F.concat(opt_str(rationale), F.lit("\nTherefore the answer is "), opt_str(answer))


def evidence_text(evidence: Column) -> Column:
    """Non-empty quotes, one a line; null if there are none."""
    quotes = F.filter(F.transform(evidence, lambda e: opt_str(e["quote"])), lambda q: q != "")
    return F.when(F.size(quotes) > 0, F.array_join(quotes, "\n"))


def word_count(c: Column) -> Column:
    """The default token counter: white-space separated words."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([^\s\x1c-\x1f\x{85}\p{Z}]+)"), 1))


# Fixed value: the inference prompt before the knowledge.
INFER_HEAD = """Return exactly one JSON object with fields in this order:
['answerability', 'evidence', 'rationale', 'answer', 'confidence']

Rules:
- If answerable, cite 1 to 4 quotes copied from the knowledge.
- Provide a short rationale showing how the evidence supports the answer.
- The rationale must not be identical to the answer.
- If unanswerable, set evidence to [] and use an allowed refusal template.
- In unanswerable cases, the rationale should briefly state what key information is missing, ambiguous, or contradictory.
- Keep the answer concise and directly responsive.
- Do not add explanations outside the JSON.

Refusal templates: """


def infer_prompt(knowledge: Column, question: Column) -> Column:
    return F.concat(F.lit(INFER_HEAD + DEFAULTS.protocol.refusals[0] + "\n\nKnowledge:\n"), F.coalesce(knowledge, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n"))


def prompt_with(template: str, **parts: Column) -> Column:
    """A prompt from a template with ``{name}`` slots, so that other styles are data, not code."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(parts[p].cast("string"), F.lit("")) for k, p in enumerate(pieces)])


def chat_content(message: Column) -> Column:
    """Text of a chat message given as JSON: a string, or the parts of a list joined by line ends."""

    def flat(v: Column) -> Column:
        parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.text", "string")))
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.array_join(F.filter(parts, lambda x: x != ""), "\n"))

    return F.coalesce(strip(let(F.try_parse_json(message), flat)), F.lit(""))


@F.pandas_udf(StringType())
def canonical_json(answerability: pd.Series, quotes: pd.Series, rationale: pd.Series, answer: pd.Series, confidence: pd.Series) -> pd.Series:
    """The five fields in protocol order, indented by two, characters as they are."""

    def one(a, q, r, w, c):
        if a is None:
            return None
        evidence = [{"quote": _canonical(x)} for x in (q if q is not None else [])]
        return json.dumps({"answerability": a, "evidence": evidence, "rationale": _canonical(r or ""), "answer": _canonical(w or ""), "confidence": c}, indent=2, ensure_ascii=False)

    return pd.Series([one(*row) for row in zip(answerability, quotes, rationale, answer, confidence)], dtype=object)


def stable_ratio(key: Column, salt: str) -> Column:
    """Salted SHA-1 of a key as a number in 0..1, equal in any engine."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt + ":"), key)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)

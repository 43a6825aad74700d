"""Prompt builders: teacher, extraction, repair and flat question answering, worked examples, chat templates.
All are column expressions but for the chat template, which is the tokenizer's."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULTS
from .coerce import opt_str
from .text import infer_prompt, qa_premise

STYLES = ("preserve", "short_phrase", "short_sentence")
# What the teacher is told about the form of the answer, by style.
GUIDANCE = {
    "preserve": "Preserve the natural answer form when possible.",
    "short_phrase": "Return a short phrase when the question naturally allows it.",
    "short_sentence": "Return a short sentence.",
}
# Fixed value: the teacher prompt before the guidance.
TEACHER_HEAD = """You are preparing structured grounded-QA supervision data.
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
10) """
# Fixed value: what follows a reference answer.
TEACHER_REFERENCE = "Keep your final answer semantically consistent with the reference answer."
# Fixed value: the extraction prompt before the question.
EXTRACTION_HEAD = """Read the model answer and return exactly one JSON object.
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

"""
# Fixed value: the repair prompt before the knowledge.
REPAIR_HEAD = """You are a strict factual editor.
Task: minimally edit the candidate answer so it is fully supported by the knowledge and directly answers the question.
Constraints:
1) Keep wording, tone, and format as close as possible to the candidate answer.
2) Do not add any unsupported facts.
3) Return only the revised answer text, without explanation.

"""
# Fixed value: instruction of a flat prompt that invites refusals.
REFUSAL_HEAD = """Use only the provided knowledge to answer the question.
If the knowledge is insufficient, answer exactly: I do not know based on the knowledge.
Do not repeat or paraphrase this instruction in the answer.
"""
# The worked examples, as knowledge, question, answerability, quotes, rationale, answer, confidence.
EXAMPLES = (
    ("DocA: The capital of Italy is Rome.", "What is the capital of Italy?", "answerable", ["The capital of Italy is Rome."], "The evidence directly states the capital of Italy.", "Rome", "high"),
    ("DocB: Marie Curie discovered polonium.\nDocC: The document does not mention her birthplace.", "Where was Marie Curie born?", "unanswerable", [], "The provided knowledge mentions discoveries but does not provide her birthplace.", "I don't know based on the provided knowledge.", "low"),
    ("DocD: The tallest mountain in Earth is Mount Everest with a height of 8,848 meters.", "Which mountain is the tallest on Earth?", "answerable", ["The tallest mountain in Earth is Mount Everest"], "The evidence explicitly identifies the tallest mountain.", "Mount Everest", "high"),
)


def output_schema() -> dict:
    """JSON schema of the structured output, keys in alphabetical order but for the fields'."""
    text = lambda title: {"minLength": 1, "title": title, "type": "string"}
    ref = lambda name: {"$ref": f"#/$defs/{name}"}
    one_of = lambda name, what, *values: {"description": what, "enum": list(values), "title": name, "type": "string"}
    item = {"additionalProperties": False, "description": "One evidence quote selected from the provided knowledge.", "properties": {"quote": text("Quote")}, "required": ["quote"], "title": "EvidenceQuote", "type": "object"}
    fields = {"answerability": ref("Answerability"), "evidence": {"items": ref("EvidenceQuote"), "title": "Evidence", "type": "array"}, "rationale": text("Rationale"), "answer": text("Answer"), "confidence": ref("ConfidenceLevel")}
    return {
        "$defs": {
            "Answerability": one_of("Answerability", "Answerability labels in the structured QA protocol.", "answerable", "unanswerable"),
            "ConfidenceLevel": one_of("ConfidenceLevel", "Confidence labels in the structured QA protocol.", "high", "medium", "low"),
            "EvidenceQuote": item,
        },
        "additionalProperties": False, "description": "Structured grounded QA output.", "properties": fields, "required": list(fields), "title": "StructuredQaOutput", "type": "object",
    }


def answer_style(question: Column, reference: Column) -> Column:
    """The style asked of the teacher: always to keep the natural form."""
    return F.lit(STYLES[0])


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def teacher_prompt(knowledge: Column, question: Column, reference: Column | None = None, style: Column | None = None) -> Column:
    """The teacher's prompt; a non-empty reference answer gets a block of its own."""
    chosen = answer_style(question, F.lit("") if reference is None else reference) if style is None else style
    guidance = F.coalesce(*[F.when(chosen == k, v) for k, v in GUIDANCE.items()], F.lit(GUIDANCE["preserve"]))
    known = F.lit("") if reference is None else F.coalesce(reference, F.lit(""))
    block = F.when(known != "", _lines("Reference answer:\n", known, f"\n\n{TEACHER_REFERENCE}\n\n")).otherwise("")
    tail = f"JSON schema:\n{json.dumps(output_schema(), indent=2, ensure_ascii=False)}\n\nAllowed refusal templates: {list(DEFAULTS.protocol.refusals)}\n\nKnowledge:\n"
    return _lines(TEACHER_HEAD, guidance, "\n\n", block, tail, knowledge, "\n\nQuestion: ", question, "\n")


def extraction_prompt(question: Column, raw_answer: Column) -> Column:
    """Asks for the short answer of a flat answer, and whether it is a refusal."""
    return _lines(EXTRACTION_HEAD + "Question: ", question, "\nModel answer:\n", raw_answer, "\n")


def repair_prompt(knowledge: Column, question: Column, rejected: Column, reference: Column | None = None) -> Column:
    known = F.lit("") if reference is None else F.coalesce(reference, F.lit(""))
    block = F.when(known != "", _lines("Reference answer (for calibration only):\n", known, "\n\n")).otherwise("")
    return _lines(REPAIR_HEAD + "Knowledge:\n", knowledge, "\n\nQuestion: ", question, "\n\nCandidate answer:\n", rejected, "\n\n", block, "Revised answer:\n")


def answer_prompt(knowledge: Column, question: Column, encourage_refusal: bool = False) -> Column:
    """The flat prompt; an empty question fails the job."""
    asked = F.when(opt_str(question) != "", question).otherwise(F.raise_error(F.lit("question must not be empty.")).cast("string"))
    return _lines(REFUSAL_HEAD if encourage_refusal else "", qa_premise(knowledge, asked), "\nAnswer: ")


def question_answer(question: Column, answer: Column) -> Column:
    return _lines("Question: ", opt_str(question), "\nAnswer: ", opt_str(answer))


def example_output(example: tuple) -> str:
    _, _, label, quotes, rationale, answer, confidence = example
    return json.dumps({"answerability": label, "evidence": [{"quote": q} for q in quotes], "rationale": rationale, "answer": answer, "confidence": confidence}, indent=2, ensure_ascii=False)


def worked_examples(k: int) -> str:
    """The first ``k`` examples (0 to 3; others are clamped) as they stand before a prompt."""
    parts = ["Few-shot format examples (follow the same JSON schema and field order):"]
    for n, example in enumerate(EXAMPLES[: max(0, min(k, len(EXAMPLES)))], 1):
        parts += [f"Example {n}", f"Knowledge:\n{example[0]}", f"Question: {example[1]}", "Output:", example_output(example)]
    return "\n\n".join([*parts, "Now solve the next case."]) + "\n\n" if len(parts) > 1 else ""


def prompt_of(mode: str, knowledge: Column, question: Column, reference: Column | None = None, prompt: Column | None = None, k: int = 0) -> Column:
    """The prompt of a generation mode: ``infer`` (the row's own, else the inference prompt), ``teacher`` or
    ``teacher_fewshot``; others raise."""
    known, asked = opt_str(knowledge), opt_str(question)
    if mode == "infer":
        own = F.lit("") if prompt is None else opt_str(prompt)
        return F.when(own != "", own).otherwise(infer_prompt(known, asked))
    if mode not in ("teacher", "teacher_fewshot"):
        raise ValueError(f"unknown prompt mode {mode!r}")
    plain = teacher_prompt(known, asked, None if reference is None else opt_str(reference))
    return plain if mode == "teacher" else F.concat(F.lit(worked_examples(k)), plain)


def new_labels(mode: str, track: str | None = None, variant: str | None = None) -> tuple[str, str]:
    """Track and variant of new generations: the given ones, else by prompt mode."""
    own = ("sft_structured", "checkpoint") if mode == "infer" else ("base_protocol", "fewshot")
    return (track or "").strip() or own[0], (variant or "").strip() or own[1]


def chat_prompt(tokenizer: Callable[[], object], thinking: bool = False):
    """A function from a prompt column to its chat form under the template of ``tokenizer()``, which is made
    once a worker. A template that takes no thinking flag is called without; where there is none, or it
    fails, the prompt stays as it is."""
    made: list = []

    def templated(text: str) -> str:
        template = getattr(made[0], "apply_chat_template", None)
        if template is None:
            return text
        messages = [{"role": "user", "content": text}]
        try:
            return template(messages, tokenize=False, add_generation_prompt=True, enable_thinking=thinking)
        except TypeError:
            return template(messages, tokenize=False, add_generation_prompt=True)
        except Exception:  # noqa: BLE001
            return text

    @F.pandas_udf(StringType())
    def chat(prompts: pd.Series) -> pd.Series:
        if not made:
            made.append(tokenizer())
        return prompts.map(templated, na_action="ignore")

    return chat

"""Strict parsing of structured model output and the row checks on it, without Python but for
character normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, ProtocolSettings
from ..functions.coerce import first_non_empty, let, once, opt_str
from ..functions.text import answer_tokens, canonical, collapse, has_year, json_span, multiset_f1, numbers, question_type

PARSED = "struct<answerability:string,evidence:array<struct<quote:string>>,rationale:string,answer:string,confidence:string>"


def parsed_output(json_text: Column) -> Column:
    """The object of a JSON text if it has exactly the protocol's fields and types, else null.

    Strict: other keys (also in evidence items), wrong types, unknown labels and empty strings make it
    null; nothing is coerced."""
    v = F.try_parse_json(json_text)
    keys = F.array_sort(F.json_object_keys(json_text))
    want = F.array(*[F.lit(x) for x in sorted(DEFAULTS.protocol.fields)])
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$.evidence", "array<variant>")
    text = lambda path: F.try_variant_get(v, path, "string")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    good_items = F.forall(items, lambda i: F.coalesce((F.schema_of_variant(i) == "OBJECT<quote: STRING>") & (F.length(F.try_variant_get(i, "$.quote", "string")) > 0), F.lit(False)))
    ok = (
        v.isNotNull() & kind.startswith("OBJECT") & (keys == want) & text("$.answerability").isin("answerable", "unanswerable") & text("$.confidence").isin("high", "medium", "low")
        & is_text(part("rationale")) & (F.length(text("$.rationale")) > 0) & is_text(part("answer")) & (F.length(text("$.answer")) > 0)
        & F.schema_of_variant(part("evidence")).startswith("ARRAY") & items.isNotNull() & good_items
    )
    return F.when(F.coalesce(ok, F.lit(False)), F.from_json(json_text, PARSED))


def parse(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """``df`` with ``parsed_output`` (canonical field texts; null if it can't be parsed), ``parse_ok``
    and ``parse_error`` (empty, or what is wrong)."""
    text = once(df.withColumn("_text", canonical(F.col(raw))), _span=json_span(F.col("_text")))
    text = once(text, _p=parsed_output(F.when(F.col("_span") != "", F.col("_span"))))
    quotes = F.split(canonical(F.array_join(F.transform("_p.evidence", lambda e: F.regexp_replace(e["quote"], "\x01", "")), "\x01")), "\x01")
    evidence = F.when(F.size("_p.evidence") > 0, F.transform(quotes, lambda q: F.struct(F.regexp_replace(q, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("quote")))).otherwise(F.array().cast("array<struct<quote:string>>"))
    made = F.struct(F.col("_p.answerability").alias("answerability"), evidence.alias("evidence"), canonical(F.col("_p.rationale")).alias("rationale"), canonical(F.col("_p.answer")).alias("answer"), F.col("_p.confidence").alias("confidence"))
    error = F.when(F.col("_p").isNotNull(), "").when(F.col("_text") == "", "Empty model output.").when(F.col("_span") == "", "No JSON object found in model output.").otherwise("invalid")
    return text.withColumns({"parsed_output": F.when(F.col("_p").isNotNull(), made), "parse_ok": F.col("_p").isNotNull(), "parse_error": error}).drop("_text", "_span", "_p")


def is_refusal(answer: Column, cfg: ProtocolSettings = ProtocolSettings()) -> Column:
    return collapse(answer).isin(*cfg.refusals)


def protocol_issues(o: Column, rationale: Column, answer: Column, cfg: ProtocolSettings = ProtocolSettings()) -> Column:
    """Issues of a parsed output; ``rationale`` and ``answer`` are its normalised texts."""
    n = F.size(o["evidence"])
    un = o["answerability"] == "unanswerable"
    issue = lambda cond, text: F.when(cond, F.lit(text))
    return F.array_compact(F.array(
        # fixed values: what the issues say
        issue(rationale == answer, "Rationale must not be identical to the final answer."),
        issue(un & (n != 0), "Unanswerable output must use an empty evidence list."),
        issue(un & ~is_refusal(answer, cfg), "Unanswerable output must use an allowed refusal template."),
        issue(~un & (n < 1), "Answerable output must include at least one evidence quote."),
        issue(~un & (n > cfg.max_evidence), f"Evidence count exceeds max_evidence_count={cfg.max_evidence}."),
    ))


def normalized_quotes(evidence: Column) -> Column:
    """White-space collapsed quotes of a canonical output."""
    return F.transform(evidence, lambda e: collapse(opt_str(e["quote"])))


def evidence_report(quotes: Column, knowledge: Column) -> Column:
    """``ok, match_rate, unique_quotes, outside`` of normalised quotes in normalised knowledge."""
    found = F.struct(F.size(F.filter(quotes, lambda q: (q != "") & F.contains(knowledge, q))).alias("hit"), F.size(quotes).alias("n"), F.size(F.array_distinct(quotes)).alias("u"))
    return let(found, lambda x: F.struct((x["hit"] == x["n"]).alias("ok"), (x["hit"] / F.greatest(F.lit(1), x["n"])).alias("match_rate"), x["u"].alias("unique_quotes"), (x["n"] - x["hit"]).alias("outside")))


def support_report(quotes: Column, supports: Column, unanswerable: Column) -> Column:
    """``match_rate, outside`` of quotes in the gold sentences; 1 and 0 for unanswerable outputs."""
    gold = F.filter(F.transform(supports, lambda s: collapse(opt_str(s["sentence"]))), lambda s: s != "")
    hit = let(gold, lambda g: F.size(F.filter(quotes, lambda q: F.exists(g, lambda s: (q != "") & F.contains(s, q)))))
    some = let(F.struct(hit.alias("hit"), F.size(quotes).alias("n")), lambda x: F.struct((x["hit"] / F.greatest(F.lit(1), x["n"])).alias("match_rate"), (x["n"] - x["hit"]).alias("outside")))
    return F.when(unanswerable, F.struct(F.lit(1.0).alias("match_rate"), F.lit(0).alias("outside"))).otherwise(some)


def correctness(answer: Column, reference: Column, least: float = DEFAULTS.token_f1) -> Column:
    """``ok, exact_match, token_f1``: equal tokens, or an F1 of at least ``least``."""
    tokens = F.struct(answer_tokens(answer).alias("p"), answer_tokens(reference).alias("r"))
    scored = let(tokens, lambda x: F.struct((x["p"] == x["r"]).alias("same"), multiset_f1(x).alias("f1")))
    return let(scored, lambda s: F.struct((s["same"] | (s["f1"] >= least)).alias("ok"), s["same"].alias("exact_match"), s["f1"].alias("token_f1")))


def answer_type(question: Column, answer: Column, entities: Column | None) -> Column:
    """``question_type, answer_type_ok, reason``; without entity labels the check is off and null."""
    kind = question_type(question)
    if entities is None:
        return F.struct(kind.alias("question_type"), F.lit(None).cast("boolean").alias("answer_type_ok"), F.lit("disabled").alias("reason"))
    has = lambda *names: F.arrays_overlap(entities, F.array(*[F.lit(x) for x in names]))
    ok = F.when(kind == "who", has("PERSON", "ORG")).when(kind == "where", has("GPE", "LOC")).when(kind == "when", has("DATE", "TIME") | has_year(answer)).when(kind == "how_many", F.size(numbers(answer)) > 0).otherwise(F.lit(True))
    reason = F.when(kind == "who", "expects_person_or_org").when(kind == "where", "expects_location").when(kind == "when", "expects_time").when(kind == "how_many", "expects_number").otherwise("not_type_constrained")
    return F.struct(kind.alias("question_type"), ok.alias("answer_type_ok"), reason.alias("reason"))


def extraction(text: Column) -> Column:
    """Lenient parse of an answer-extraction object: ``ok, short_answer, refusal_detected,
    refusal_reason``. A refusal clears the answer; flags may be written as words."""
    t = opt_str(text)
    span = F.when(t.startswith("{"), t).otherwise(json_span(t))
    v = F.try_parse_json(F.when(span != "", span))
    raw = F.try_variant_get(v, "$.refusal_detected", "variant")
    kind = F.schema_of_variant(raw)
    word = F.lower(F.trim(F.try_variant_get(v, "$.refusal_detected", "string")))
    flag = F.when(kind == "BOOLEAN", word == "true").when((kind == "STRING") & word.isin("true", "yes", "1"), F.lit(True)).when((kind == "STRING") & word.isin("false", "no", "0"), F.lit(False))
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT") & flag.isNotNull()
    get = lambda p: opt_str(F.try_variant_get(v, p, "string"))
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok & ~flag, get("$.short_answer")).otherwise(F.lit("")).alias("short_answer"),
        F.when(ok, flag).alias("refusal_detected"), F.when(ok, get("$.refusal_reason")).otherwise(F.lit("")).alias("refusal_reason"),
    )


def decoded(o: Column) -> Column:
    """A payload that is a struct already, if it is valid: both labels in their vocabularies, texts and quotes
    non-empty, evidence a list; else null."""
    full = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    ok = o["answerability"].isin("answerable", "unanswerable") & o["confidence"].isin("high", "medium", "low") & full(o["rationale"]) & full(o["answer"]) & o["evidence"].isNotNull() & F.forall(o["evidence"], lambda e: full(e["quote"]))
    return F.when(F.coalesce(ok, F.lit(False)), o)


def payload(df: DataFrame, sources: tuple[str, ...] = ("raw_output", "answer", "actual_output")) -> DataFrame:
    """``df`` with ``parsed_output``: the row's own where it has one, else parsed anew from the first
    non-empty of ``sources``; null where neither gives one."""
    texts = [F.col(c) for c in sources if c in df.columns]
    own = F.col("parsed_output").cast(PARSED) if "parsed_output" in df.columns else F.lit(None).cast(PARSED)
    marked = df.withColumn("_own", own).withColumn("_raw", first_non_empty(*texts) if texts else F.lit(""))
    aside = {c: f"_{c}" for c in ("parse_ok", "parse_error") if c in df.columns}  # an earlier parse's results stay
    marked = marked.withColumnsRenamed(aside)
    anew = lambda x: parse(x.drop("parsed_output"), "_raw").drop("parse_ok", "parse_error")
    kept = marked.where("_own is not null").withColumn("parsed_output", F.col("_own"))
    return kept.unionByName(anew(marked.where("_own is null")).select(*kept.columns)).drop("_own", "_raw").withColumnsRenamed({v: k for k, v in aside.items()})


def checked(df: DataFrame, cfg: ProtocolSettings = ProtocolSettings(), least_f1: float = DEFAULTS.token_f1) -> DataFrame:
    """Rows of :func:`parse` with ``protocol_issues, protocol_ok, evidence, support, correct`` (null
    where nothing was parsed). Columns read: ``parsed_output, knowledge, reference_answer,
    supporting_sentences``."""
    o = F.col("parsed_output")
    df = once(df.withColumn("_c", canonical(F.col("knowledge"))), _r=collapse(o["rationale"]), _a=collapse(o["answer"]), _k=collapse(F.col("_c")), _q=normalized_quotes(o["evidence"])).drop("_c")
    parsed = o.isNotNull()
    issues = protocol_issues(o, F.col("_r"), F.col("_a"), cfg)
    done = once(
        df, protocol_issues=F.when(parsed, issues),
        evidence=F.when(parsed & (o["answerability"] == "answerable"), evidence_report(F.col("_q"), F.col("_k"))),
        support=F.when(parsed, support_report(F.col("_q"), F.col("supporting_sentences"), o["answerability"] == "unanswerable")),
        correct=F.when(parsed & (o["answerability"] == "answerable") & (opt_str(F.col("reference_answer")) != ""), correctness(o["answer"], F.col("reference_answer"), least_f1)),
    )
    return done.withColumn("protocol_ok", F.when(F.col("protocol_issues").isNotNull(), F.size("protocol_issues") == 0)).drop("_r", "_a", "_k", "_q")

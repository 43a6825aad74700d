import json

import pytest
from pyspark.sql import functions as F

from oreline.functions import text as X
from oreline.operators import protocol

GOOD = {"answerability": "answerable", "evidence": [{"quote": "Tom &amp; Jerry"}], "rationale": "Based on ＡＢＣ.", "answer": "ＡＢＣ", "confidence": "high"}


def parsed(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, raw_output string")
    return [r for r in protocol.parse(df).orderBy("k").collect()]


def test_canonical_parse(spark):
    raw = "﻿```json\r\n" + json.dumps(GOOD, ensure_ascii=False).replace("Jerry", "Jer​ry") + "\r\n```"
    r = parsed(spark, raw)[0]
    assert r.parse_ok and r.parsed_output.evidence[0].quote == "Tom & Jerry" and r.parsed_output.rationale == "Based on ABC." and r.parsed_output.answer == "ABC"


@pytest.mark.parametrize("change", [
    {"extra": 1}, {"answer": 5}, {"answer": ""}, {"confidence": "sure"}, {"answerability": "maybe"}, {"evidence": "x"}, {"evidence": [{"quote": ""}]}, {"evidence": [{"quote": "a", "n": 1}]}, {"evidence": ["a"]}, {"rationale": None}, {"evidence": None},
])
def test_strict(spark, change):
    assert not parsed(spark, json.dumps({**GOOD, **change}))[0].parse_ok


def test_errors_and_empty_evidence(spark):
    rows = parsed(spark, None, "", "no object", "{broken", json.dumps({**GOOD, "evidence": []}), "x" * 100_000)
    assert [r.parse_error for r in rows] == ["Empty model output."] * 2 + ["No JSON object found in model output."] * 2 + ["", "No JSON object found in model output."]
    assert rows[4].parsed_output.evidence == []


def test_checks(spark):
    knowledge = "Tom & Jerry live\there. They like cheese."
    o = {**GOOD, "evidence": [{"quote": "Tom & Jerry  live here."}, {"quote": "dogs"}], "answer": "cheese they like", "rationale": "so"}
    un = {"answerability": "unanswerable", "evidence": [{"quote": "x"}], "rationale": "r", "answer": "No idea", "confidence": "low"}
    same = {**GOOD, "rationale": "a  b", "answer": "a b"}
    df = spark.createDataFrame([(0, json.dumps(o), knowledge, "They like cheese", [("Tom & Jerry live here.",)]), (1, json.dumps(un), knowledge, "", []), (2, json.dumps(same), knowledge, None, None), (3, "bad", None, None, None)], "k int, raw_output string, knowledge string, reference_answer string, supporting_sentences array<struct<sentence:string>>")
    a, b, c, d = protocol.checked(protocol.parse(df)).orderBy("k").collect()
    assert a.protocol_ok and not a.evidence.ok and a.evidence.match_rate == 0.5 and a.evidence.outside == 1 and a.support.match_rate == 0.5
    assert a.correct.token_f1 == 1.0 and not a.correct.exact_match and a.correct.ok
    assert b.protocol_issues == ["Unanswerable output must use an empty evidence list.", "Unanswerable output must use an allowed refusal template."] and b.support.match_rate == 1.0 and b.evidence is None
    assert c.protocol_issues == ["Rationale must not be identical to the final answer."] and c.correct is None
    assert d.protocol_ok is None and d.evidence is None


def test_extraction(spark):
    texts = ['{"short_answer": "x", "refusal_detected": false, "refusal_reason": ""}', 'so {"short_answer": "x", "refusal_detected": "Yes", "refusal_reason": "r"}', '{"short_answer": "x"}', "", None, '{"refusal_detected": "maybe"}', "[1]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.e for r in df.select("k", protocol.extraction(F.col("t")).alias("e")).orderBy("k").collect()]
    assert [g.ok for g in got] == [True, True, False, False, False, False, False]
    assert got[0].short_answer == "x" and got[1].short_answer == "" and got[1].refusal_detected is True


def test_text_functions(spark):
    df = spark.createDataFrame([("a b b", "b b c"), ("", ""), ("x", ""), (None, "x")], "p string, r string")
    assert [round(r[0], 4) for r in df.select(X.token_f1(F.col("p"), F.col("r"))).collect()] == [0.6667, 1.0, 0.0, 0.0]
    t = spark.createDataFrame([("user\nhi\nassistant\n<think>a\nb</think> Yes. ",), ("System\nUser\nplain",), (None,)], "t string")
    assert [r[0] for r in t.select(X.sanitized(F.col("t"))).collect()] == ["Yes.", "plain", ""]
    n = spark.createDataFrame([("1,234.5 and 12% of a1 in 1999, 7",)], "t string").select(X.numbers(F.col("t")), X.has_year(F.col("t"))).first()
    assert n[0] == ["1,234.5", "12%", "1999", "7"] and n[1]
    p = spark.createDataFrame([("K1\nKnowledge:\nx", "What?")], "k string, q string").select(X.split_prompt(X.infer_prompt(F.col("k"), F.col("q"))).alias("s")).first().s
    assert p.knowledge == "x" and p.question == "What?"  # the last knowledge block counts

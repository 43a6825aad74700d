import hashlib
import random

from pyspark.sql import functions as F

from oreline.config import NegativeSettings
from oreline.operators import source

RAW = "_id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>, hotpot_source_split string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def one(key="s2", split="train", supports=(["Doc1", "Doc2"], [1, 0]), docs=(["Doc1", "Doc2"], [["a0", "a1", "a2"], ["b0", "b1"]]), q="Q?", a="A"):
    return (key, q, a, "bridge", None, docs, supports, split)


def test_split_hash_equals_python(spark):
    keys = [f"hotpot-{k}" for k in (123, 456, 789, 999)]
    t = source.tagged(raw(spark, *[one(k, "validation") for k in keys])).collect()
    ratio = lambda salt, k: int(hashlib.sha1(f"{salt}:{k}".encode()).hexdigest()[:8], 16) / (16**8 - 1)
    for r in t:
        assert r.data_split == ("validation" if ratio("data_split", r._1 if hasattr(r, "_1") else r["_id"]) < 0.5 else "test")
    assert {r.data_split for r in source.tagged(raw(spark, one("hotpot-123", "train"))).collect()} == {"train_sft_raw"}


def test_both_gives_two_examples(spark):
    t = raw(spark, one()).withColumns({"data_split": F.lit("train_sft_raw"), "answerability_split": F.lit("both")})
    got = {r.answerability_label: r for r in source.examples(t).collect()}
    assert set(got) == {"answerable", "unanswerable"}
    yes, no = got["answerable"], got["unanswerable"]
    assert yes.knowledge == "Doc1: a0 a1 a2\n\nDoc2: b0 b1" and yes.difficulty == "unknown" and yes.id == "s2:answerable"
    assert no.knowledge != yes.knowledge and no.variant_id == "unanswerable-paired-v1" and no.data_split == "train_sft_raw" and len(no.metadata.negative_strategy.replacement_sentences) == 1


def test_dropped_rows(spark):
    bad = [one("a", supports=(["Doc1"], [9])), one("b", supports=(["Nope"], [0])), one("c", q=" "), one("d", a=None), one("e", supports=([], [])), one("f", supports=(["Doc1"] * 5, [0, 1, 2, 0, 1])), one("g", supports=(["Doc1", "Doc1", "Doc2", "Doc2", "Doc1"], [0, 1, 0, 1, 2]))]
    assert [r.source_id for r in source.answerable(raw(spark, *bad)).collect()] == ["f"]  # repeats count once, five supports are too many


def test_empty_sentences_shift_positions_and_last_title_wins(spark):
    r = source.answerable(raw(spark, one(supports=(["D"], [1]), docs=(["D", "D"], [["x"], [" ", "first", "", "second", "third"]])))).first()
    assert r.supports[0].sentence == "second" and r.supports[0].window_text == "D: first second third"


def test_negative_choice_by_twister_matches_the_generator(spark):
    t = source.answerable(raw(spark, one(supports=(["Doc1", "Doc2"], [0, 1]), docs=(["Doc1", "Doc2"], [["a0", "a1", "a2", "a3"], ["b0", "b1", "b2"]])))).withColumn("answerability_split", F.lit("unanswerable"))
    r = source.negatives(t, NegativeSettings(replace_max=2, seed=7), parity=True).first()
    rng = random.Random("7:s2::answerable::external_raw::unanswerable")
    k = rng.randint(1, 2)
    want = []
    for s in rng.sample([("Doc1", 0), ("Doc2", 1)], k=k):
        want.append(rng.choice({"Doc1": [("Doc1", 1, "a1")], "Doc2": [("Doc2", 0, "b0"), ("Doc2", 2, "b2")]}[s[0]]))
    assert [tuple(x) for x in r.replacement_sentences] == want


def test_no_candidates_and_adjacent_documents(spark):
    alone = raw(spark, one(supports=(["A"], [0]), docs=(["A"], [["only"]])))
    beside = raw(spark, one(supports=(["B"], [0]), docs=(["A", "B", "C"], [["a0", "a1"], ["only"], ["c0"]])))
    neg = lambda df: source.negatives(source.answerable(df).withColumn("answerability_split", F.lit("both"))).collect()
    assert neg(alone) == []
    assert neg(beside)[0].replacement_sentences[0].title in ("A", "C") and neg(beside)[0].replacement_sentences[0].sent_id == 0


def test_unknown_split_fails(spark):
    import pytest

    with pytest.raises(Exception):
        source.tagged(raw(spark, one("k", "dev"))).collect()


def test_restored_examples(spark):
    kind = "id string, source_id bigint, data_split string, question string, supporting_sentences array<struct<title:string,sent_id:string,sentence:string,window_sentences:array<string>,window_text:string>>, context_documents array<struct<title:string,sentences:array<string>>>, extra string"
    rows = [(" i ", 7, " test ", None, [(" T ", "2", " s ", [" a ", "", None], None), ("U", "x", None, None, "w")], [("D", ["one ", " "])], "c"), (None, None, None, " q ", None, None, "c")]
    a, b = source.restored(spark.createDataFrame(rows, kind)).orderBy("source_id", ascending=False).collect()
    assert (a.id, a.source_id, a.data_split, a.question, a.answerability_split) == ("i", "7", "test", "", None) and "extra" not in a.asDict()
    assert [(s.title, s.sent_id, s.sentence, s.window_sentences, s.window_text) for s in a.supporting_sentences] == [("T", 2, "s", ["a"], ""), ("U", 0, "", [], "w")]
    assert a.context_documents[0].sentences == ["one"] and (b.question, b.data_split, b.supporting_sentences, b.context_documents) == ("q", None, [], [])
    assert source.restored(spark.createDataFrame(rows, kind).limit(0)).count() == 0

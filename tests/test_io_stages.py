import asyncio
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from oreline import cli, schemas
from oreline.functions import scorers
from oreline.plans import stages
from oreline.sources import files, scans, sinks
from oreline.streaming import checks


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_schema_and_fail_fast(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [{"id": "1", "metadata": {"x": 1}}, {"id": "2", "metadata": {"y": [1]}}])
    df = files.read_jsonl(spark, p, "id string, metadata struct<x:int,y:array<int>>, more string", provenance=True)
    assert [(r.id, r.more) for r in df.collect()] == [("1", None), ("2", None)] and "input_source_path" in df.columns
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string").collect()


def test_split_loader(spark, tmp_path):
    for name, payload, n in (("l", [{"a": 1}, {"a": 2}, 3], 2), ("s", {"test": [{"a": 1}], "data": [{"a": 7}, {"a": 8}]}, 1), ("d", {"data": [{"a": 7}, {"a": 8}]}, 2), ("o", {"a": 5}, 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
        assert files.load_split(spark, str(tmp_path / f"{name}.json"), "test", "a int").count() == n
    df = spark.createDataFrame([(1, "train"), (2, "validation")], "a int, split string")
    sinks.write_splits(df, str(tmp_path / "ds"))
    assert files.load_split(spark, str(tmp_path / "ds"), "train", "a int").first().a == 1
    with pytest.raises(ValueError):
        files.load_split(spark, str(tmp_path / "ds"), "test", "a int")
    with pytest.raises(Exception):
        sinks.write_splits(df, str(tmp_path / "ds"))
    with pytest.raises(ValueError):
        sinks.write_splits(df.where("split = 'train'"), str(tmp_path / "d2"))


def test_csv_partition_json_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([("1", 'x "q", y')], "a string, b string"), spark.createDataFrame([("2", "z")], "a string, c string")
    sinks.write_csv(str(tmp_path / "c"), a, b, one_file=True)
    back = {r.a: (r.b, r.c) for r in files.read_csv(spark, str(tmp_path / "c")).collect()}
    assert back == {"1": ('x "q", y', None), "2": (None, "z")}
    n = sinks.write_partitioned(spark.createDataFrame([("1", "test"), ("2", " "), ("3", None), ("4", "test")], "a string, data_split string"), str(tmp_path / "p"))
    assert [tuple(r) for r in n.collect()] == [("test", 2)] and os.path.isdir(tmp_path / "p" / "data_split=test")
    sinks.write_json(n, str(tmp_path / "m" / "n.json"))
    assert json.loads((tmp_path / "m" / "n.json").read_text()) == {"data_split": "test", "n": 2}
    sinks.manifest(str(tmp_path / "x.json"), rows=2)


def test_checkpoints_and_positions(spark, tmp_path):
    for k in (30, 4):
        (tmp_path / f"checkpoint-{k}").mkdir()
    assert [r.step for r in files.checkpoints(spark, str(tmp_path)).collect()] == [4, 30]
    (tmp_path / "list.txt").write_text("checkpoint-30\n\ncheckpoint-4\n")
    assert files.model_specs(spark, "base", adapter_list=str(tmp_path / "list.txt")).count() == 3
    with pytest.raises(ValueError):
        files.model_specs(spark)
    assert sorted(r._ord for r in files.with_position(spark.range(0, 50, 1, 4)).collect()) == list(range(50))


def test_seeded_scans(spark):
    rows = [(k, f"q{k}" if k % 3 else " ", "K", "a", "yes" if k % 2 else "?", "nli_flat" if k % 4 else None, "p", "c" if k % 5 else "") for k in range(60)]
    df = spark.createDataFrame(rows, "_ord bigint, question string, knowledge string, answer string, label string, task_type string, prompt string, completion string").repartition(5)
    places = {r._ord: r._place for r in scans.shuffled(df, 7).collect()}
    assert sorted(places.values()) == list(range(60)) and places != {k: k for k in range(60)} and places == {r._ord: r._place for r in scans.shuffled(df.coalesce(1), 7).collect()}
    want = list(range(60))
    random.Random(7).shuffle(want)
    assert [r._ord for r in scans.shuffled(df, 7, exact=True).orderBy("_place").collect()] == want
    by_place = sorted(places, key=places.get)
    items = scans.generation_items(df, 7, 10).collect()
    assert sorted(r.sample_id for r in items) == sorted(places[k] for k in [k for k in by_place if k % 3][:10])
    assert scans.generated_rows(df, 7).count() == 40 and scans.source_rows(df, 7, 5).count() == 5
    assert {r._source_index for r in scans.source_rows(df, 7, 5).collect()} == set(by_place[:5])
    loss = scans.loss_rows(df, 7, 4).collect()
    cut = [k for k in by_place if k % 5][3]
    assert sum(r.skip_reason == "" for r in loss) == 4 and len(loss) == by_place.index(cut) + 1
    marked = df.withColumns({c: F.lit(None).cast("string") for c in ("model_tag", "model_path", "model_step", "sample_id", "human_label")})
    assert scans.annotation_rows(marked, 7, 12).count() == 12 and scans.annotation_rows(marked, 7).count() == 45
    ext = scans.labelled_rows(df.withColumnRenamed("question", "ask"), 7, question="ask")
    assert ext.count() == 20 and {r.gold_supported for r in ext.collect()} == {True} and scans.labelled_rows(df, 7, allow_unlabeled=True).count() == 40
    assert scans.generation_items(df.limit(0), 7, 3).count() == scans.labelled_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scans.training_set({"test": df})
    with pytest.raises(ValueError):
        scans.training_set({"train": df.drop("prompt")})


def test_calls_in_flight_and_retries(spark):
    class Flaky(Exception):
        status = 429

    def timed(prompt, seed):
        time.sleep(0.2)
        return f"{prompt} {seed}"

    df = spark.range(64).select(F.col("id").alias("n"), F.lit("p").alias("prompt")).coalesce(1)
    began = time.time()
    got = scorers.generate(df, timed, index="n", seed=5).collect()
    assert time.time() - began < 8 and sorted(r.text for r in got) == sorted(f"p {5 + k}" for k in range(64))  # one after the other they take 13 s

    async def later(prompt, seed):
        await asyncio.sleep(0.01)
        return scorers.Attempt(True, "done", usage=(3, 4))

    assert {(r.text, r.usage_source) for r in scorers.generate(df, later).collect()} == {("done", "provider")}
    tries: dict = {}

    def flaky(prompt, seed):
        tries[seed] = tries.get(seed, 0) + 1
        kind = seed % 3
        if kind == 0 and tries[seed] < 3:
            raise Flaky("busy")
        if kind == 1:
            raise TimeoutError("late")
        if kind == 2 and tries[seed] < 2:
            raise ConnectionError("gone")
        return "ok"

    fast = scorers.Retry(base_seconds=0.01)
    rows = {r.n: r for r in scorers.generate(df.limit(3).coalesce(1), flaky, index="n", retry=fast).collect()}
    assert [(rows[k].ok, rows[k].attempt_count) for k in range(3)] == [(True, 3), (False, 4), (True, 2)] and rows[1].error_type == "TimeoutError"
    slow = scorers.generate(df.limit(1), timed, retry=scorers.Retry(retries=0, timeout_seconds=0.05)).first()
    assert not slow.ok and slow.error_type == "TimeoutError"
    assert 0.4 <= scorers.Retry().pause(1, 0.0) <= 0.6 and scorers.Retry().pause(9, 1.0) == pytest.approx(9.6)


def test_local_models_in_batches(spark):
    def load(path):
        def decode(batch):
            if any("bad" in p for p in batch):
                raise RuntimeError("boom")
            return [f"{path}:{p}:{len(batch)}" for p in batch]

        return decode

    items = spark.createDataFrame([(f"p{k}" if k else "bad",) for k in range(20)], "prompt string")
    jobs = scorers.jobs(items, [{"model_tag": m, "model_step": 0, "model_path": m} for m in ("A", "B")])
    got = scorers.generate_batches(jobs, load, batch=4, parts=2).collect()
    assert len(got) == 40 and sum(not r.ok for r in got) == 2 and all(r.text.startswith(r.model_path + ":") for r in got if r.ok)
    good = json.dumps({"answerability": "answerable", "evidence": [{"quote": "k"}], "rationale": "r", "answer": "a", "confidence": "low"})
    rows = spark.createDataFrame([("i1", "Q", "k", "a"), ("i2", "Q2", "k", "a")], "id string, question string, knowledge string, reference_answer string")
    spec = [{"model_tag": "base", "model_step": 0, "model_path": "b"}]
    out = stages.generate_structured(rows, spec, lambda path: lambda batch: [good if "Q2" not in p else "<think>x</think> junk" for p in batch], "teacher_fewshot", 2)
    r = {x.id: x for x in out.collect()}
    assert r["i1"].protocol_passed and r["i2"].generation_failed and r["i2"].raw_output == "junk" and (r["i1"].eval_track, r["i1"].eval_variant) == ("base_protocol", "fewshot") and "Example 2" in r["i1"].prompt
    flat = stages.generate_answers(rows, spec, lambda path: lambda batch: ["assistant\nAnn" for _ in batch], thinking=True)
    assert {(x.answer, x.eval_variant) for x in flat.collect()} == {("Ann", "think")}
    said = json.dumps({"short_answer": "Ann", "refusal_detected": False, "refusal_reason": ""})
    done = stages.extract_answers(flat, lambda p, s: said if "Question: Q\n" in p else "??").collect()
    assert {(x.id, x.extraction_text == said, x.extraction_attempt_count) for x in done} == {("i1", True, 1), ("i2", False, 2)}


def test_generation_errors_and_retries(spark):
    def call(prompt, seed):
        if "bad" in prompt:
            raise RuntimeError("boom")
        return scorers.Attempt(True, prompt.upper(), usage=(1, 2)) if "use" in prompt else prompt.upper()

    df = spark.createDataFrame([("a b",), ("bad",), ("use",)], "prompt string")
    got = {r.prompt: r for r in scorers.generate(df, call).collect()}
    assert got["a b"].text == "A B" and got["a b"].usage_source == "estimated" and got["bad"].text == scorers.ERROR_TEXT and got["bad"].error_type == "RuntimeError" and got["use"].usage_completion_tokens == 2
    once = lambda d: d.withColumn("ok", F.lit(False))
    assert [r.extraction_attempt_count for r in scorers.retry_failed(df, once, "ok").collect()] == [2, 2, 2]


RAW = {"_id": "s1", "question": "Who built it?", "answer": "Ann", "type": "bridge", "level": "hard", "context": {"title": ["Doc1", "Doc2"], "sentences": [["Ann built it.", "It was big.", "It fell."], ["Other text.", "More text."]]}, "supporting_facts": {"title": ["Doc1"], "sent_id": [0]}}


def test_pipeline_end_to_end(spark, tmp_path):
    a = write(tmp_path / "train.jsonl", [RAW, {**RAW, "_id": "s2"}])
    b = write(tmp_path / "val.jsonl", [{**RAW, "_id": f"v{k}"} for k in range(20)])
    tagged = stages.tag(files.read_jsonl(spark, a, schemas.RAW), files.read_jsonl(spark, b, schemas.RAW))
    examples = stages.prefilter(stages.build(tagged))
    good = json.dumps({"answerability": "answerable", "evidence": [{"quote": "Ann built it."}], "rationale": "The text says Ann built it.", "answer": "Ann", "confidence": "low"})
    refusal = json.dumps({"answerability": "unanswerable", "evidence": [], "rationale": "Nothing is said.", "answer": "I cannot answer from the provided knowledge.", "confidence": "low"})
    made = stages.generate(examples, lambda p, s: good if "Ann built it." in p else refusal)
    v = stages.validate_candidates(made).cache()
    picked = v.where("selected")
    assert picked.groupBy("id").count().where("count > 1").count() == 0 and picked.where("hard_pass").count() == picked.count() > 0
    assert v.where("selected and answerability_label = 'answerable' and derived_confidence is null").count() == 0
    r = stages.records(v)
    assert r.count() >= 1 and json.loads(r.first().completion)["evidence"] in ([{"quote": "Ann built it."}], [])
    v.unpersist()


def test_cli(tmp_path, spark, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    p = write(tmp_path / "v.jsonl", [{"id": "1", "knowledge": "Ann built it", "question": "Who?", "chosen": "Ann", "rejected": "Bob"}])
    assert cli.main(["verify", "--in", p, "--out", str(tmp_path / "o"), "--metrics-out", str(tmp_path / "m.json"), "--master", "local[4]"]) == 0
    m = json.loads((tmp_path / "m.json").read_text())
    assert m["num_chosen"] == 1 and m["rows_with_deviation"] == 0


def test_stream(spark, tmp_path):
    good = json.dumps({"answerability": "unanswerable", "evidence": [], "rationale": "r", "answer": "I cannot answer from the provided knowledge.", "confidence": "low"})
    (tmp_path / "in").mkdir()
    row = lambda k, t: {"gen_id": k, "at": "2025-01-01T00:00:00", "raw_output": t, "knowledge": "k"}
    write(tmp_path / "in" / "a.json", [row(1, good), row(1, good), row(2, "junk")])
    s = checks.generation_stream(spark, str(tmp_path / "in"), "gen_id bigint, at timestamp, raw_output string, knowledge string, reference_answer string, supporting_sentences array<struct<sentence:string>>")
    q = checks.start(checks.checked_stream(s, key="gen_id", event_time="at"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    got = {r.gen_id: r.protocol_ok for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: None} and spark.read.parquet(str(tmp_path / "out")).count() == 2

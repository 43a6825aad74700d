import random

import numpy as np
from pyspark.sql import functions as F

from oreline.llm import mixing, overlap

QA = "rec_id bigint, id string, source_id string, data_split string, question string, knowledge string, k string"


def data(n=240, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            _, _, _, _, q, t, _ = rng.choice(rows)
            q, t = q.split(), t.split()
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.4:
                q[rng.randrange(len(q))] = rng.choice(words)
            q, t = " ".join(q), " ".join(t)
        else:
            q, t = "what is " + " ".join(rng.choices(words, k=6)), " ".join(rng.choices(words, k=30))
        rows.append((k, f"src-{k % 9}:a", None, rng.choice(["train_sft_raw", "Test", " validation"]), q, t, "clash"))
    return rows


def test_pruned_join_equals_all_pairs(spark):
    one, _ = overlap.classes(spark.createDataFrame(data(), QA))
    vecs = [r for r in overlap.vectors(one, overlap.term_counts(one)).collect()]
    want = set()
    for a in (v for v in vecs if v.held_out):
        for b in (v for v in vecs if not v.held_out):
            c = []
            for f in "qk":
                w = dict(zip(b[f"t{f}"], b[f"w{f}"]))
                c.append(2 * sum(x * w.get(t, 0) for t, x in zip(a[f"t{f}"], a[f"w{f}"])))
            if c[0] >= overlap.LEAST_QUESTION + 1e-5 and c[1] >= overlap.LEAST_KNOWLEDGE + 1e-5 and sum(c) / 2 >= overlap.LEAST + 1e-5:
                want.add((a.class_id, b.class_id))
    got = {(r.a, r.b) for r in overlap.class_pairs(one).collect()}
    assert want and want <= got and len(got - want) <= 2
    assert all(abs(np.linalg.norm([*v.wq, *v.wk]) - 1) < 1e-3 for v in vecs)


def test_split_lists_meet_the_same_pairs(spark):
    a = spark.createDataFrame([(t, k) for t in range(3) for k in range(4)], "term bigint, class_id bigint")
    b = spark.createDataFrame([(t, 100 + k) for t in range(3) for k in range(40 if t == 1 else 2)], "term bigint, class_id bigint")
    want = sorted(tuple(r) for r in a.join(b.withColumnRenamed("class_id", "b"), "term").select("term", "class_id", "b").collect())
    one, other, keys = overlap.split_lists(a, b, 7)
    assert keys == ["term", "part"] and other.where("term = 1").select("part").distinct().count() == 6
    assert sorted(tuple(r) for r in one.join(other.withColumnRenamed("class_id", "b"), keys).select("term", "class_id", "b").collect()) == want
    assert overlap.split_lists(a, b)[2] == ["term"]


def test_pairs_and_report(spark):
    text = "the stone bridge of Ulm was rebuilt by the Old Guild in 1837 after the long flood near the harbour"
    rows = [
        (5, "src-1:a", "src-1", "test", "Who rebuilt the bridge of Ulm?", text, "c"), (3, "src-2:a", "src-2", "train_sft_raw", "who rebuilt thе bridge of Ulm", text + " again", "c"), (4, "src-2:a", "src-2", " TRAIN_SFT_RAW", "who rebuilt thе bridge of Ulm", text + " again", "c"),
        (6, "src-3:a", "src-3", "train_sft_raw", "What was sold to the millers of Leeds?", text, "c"), (7, "src-4:a", "src-4", "train_sft_raw", "Who rebuilt the bridge of Ulm?", "nothing in common but words on quite other things such as wool, tin and salt", "c"),
        (8, "src-1:a", "src-1", "test", None, text, "c"), (9, "src-1:a", "src-1", None, "Who rebuilt the bridge of Ulm?", text, "c"), (10, "src-5:a", None, "validation", "", "", "c"),
        (None, "src-9:a", "src-9", "train_sft_raw", "Who rebuilt the bridge of Ulm?", text, "c"),
    ]
    df = spark.createDataFrame(rows, QA)
    pairs = overlap.overlapping(df)
    assert sorted((r.rec_id_a, r.rec_id_b) for r in pairs.collect()) == [(3, 5), (4, 5)]
    rep = {(r.data_split, r.source): (r.n_records, r.n_overlapping) for r in overlap.overlaps_by_source(df, pairs).collect()}
    assert rep == {("test", "src-1"): (2, 1), ("validation", "src-5"): (1, 0)}
    assert overlap.overlapping(df.where("rec_id < 0")).count() == 0 and overlap.overlapping(df.where("data_split = 'test'")).count() == 0


def docs(spark):
    rows = [(k, "big" if k < 300 else "small" if k < 330 else None if k < 335 else "other", "one two three four five " * (1 + k % 3), "c") for k in range(340)] + [(900, "small", None, "c"), (901, "small", "", "c")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string")


TARGETS = "source string, target_permille int, max_repeats int, doc_id int"


def test_mixture(spark):
    t = spark.createDataFrame([("big", 600, 1, 0), ("small", 300, 3, 0), ("gone", 100, 2, 0)], TARGETS)
    d = docs(spark)
    assert sorted(r.source for r in mixing.unreachable(d, t).collect()) == ["gone", "small"]
    m = mixing.mixture(d, t, {"big": 0.5}, buckets=8)
    rows = m.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    copies = {}
    for r in rows:
        copies[r.source, r.doc_id] = copies.get((r.source, r.doc_id), 0) + 1
    assert max(v for (s, _), v in copies.items() if s == "small") == 3 and max(v for (s, _), v in copies.items() if s == "big") == 1
    shares = {r.source: r for r in mixing.reached_shares(d, t, {"big": 0.5}).collect()}
    assert abs(shares["big"].share_of_demand - 1) < 0.02 and shares["small"].share_of_demand < 1 and shares["gone"].most_copies == 0
    plan = {r.source: r for r in mixing.curriculum(mixing.sized(d, mixing.TOKENIZER), t).collect()}
    assert plan["big"].runs_dry is None and 0 < plan["small"].runs_dry < 1 and plan["gone"].runs_dry == 0
    assert mixing.mixture(d.where("doc_id < 0"), t).count() == 0 and mixing.unreachable(d.where("doc_id < 0"), t).count() == 0


def test_inverse_of_the_demand(spark):
    times, weights = [0.0, 0.4, 1.0], [0.1, 0.5, 0.0]
    cum = mixing.integrate(times, weights)
    df = spark.createDataFrame([(x / 50 * cum[-1], times, weights, cum) for x in range(51)], "y double, t array<double>, w array<double>, c array<double>")
    for r in df.select("y", mixing.invert(F.col("y"), F.col("t"), F.col("w"), F.col("c")).alias("x")).collect():
        grid = np.linspace(0, r.x, 2001)
        assert abs(np.trapezoid(np.interp(grid, times, weights), grid) - r.y) < 1e-3


def test_token_count(spark):
    import os

    if not os.path.exists(mixing.TOKENIZER):
        import pytest

        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([("Hello world",), ("<|endoftext|>",), ("",), (None,)], "t string").select(mixing.token_count()(F.col("t")).alias("n"))
    n = [r.n for r in df.collect()]
    assert n[0] == 2 and n[1] > 1 and n[2:] == [0, 0]

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oreline.llm import quotas, splits

QA = "rec_id bigint, id string, source_id string, data_split string, metadata struct<raw_source_id:string>, own string, component string"


def records(spark, rows):
    return spark.createDataFrame([(k, *r[:3], (r[3],) if r[3] != "nostruct" else None, "clash", "clash") for k, r in enumerate(rows)], QA)


def test_names(spark):
    same = ["src-00000012", "SRC_12", "Src 00012", "src‑00000012", " src-12\t", "ｓｒｃ－１２", "sr​c-12"]
    df = spark.createDataFrame([(x,) for x in same], "s string").select(splits.source_name(F.col("s")).alias("n"))
    assert {r.n for r in df.collect()} == {"src-12"}
    odd = spark.createDataFrame([("",), (" ",), (None,), ("src-100",)], "s string").select(splits.source_name(F.col("s")).alias("n"))
    assert [r.n for r in odd.collect()] == [None, None, None, "src-100"]


def brute(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for own, raw in rows:
        up[find(own)] = find(raw)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(150)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("hub", f"h{k}") for k in range(80)] + [("x", "x"), (None, "y")]
    got = {r.node: r.component for r in splits.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = brute([p for p in pairs if p[0]])
    groups = defaultdict(set)
    for n, r in want.items():
        groups[r].add(n)
    assert got == {n: min(groups[r]) for n, r in want.items()}


def test_straddling(spark):
    rows = [
        ("a:1", "src-1", "train", "src-2"), ("b:1", "SRC 0002", " Test ", None), ("c:1", "src-3", "train", None), ("src-3:x", None, "TRAIN", None),
        ("d:1", "src-4", None, "src-5"), ("e:1", "src-5", "train", None), ("f:1", "src-4", "test", "nostruct"), (None, None, "test", None), (None, None, "train", None), ("g:1", "src-6", " ", None),
    ]
    df = records(spark, rows)
    assert sorted(r.rec_id for r in splits.straddling(df).collect()) == [0, 1, 5, 6]
    assert splits.straddling(df.where("rec_id < 0")).count() == 0
    lost = df.unionByName(df.where("rec_id = 0").withColumns({"rec_id": F.lit(None).cast("bigint"), "data_split": F.lit("test")}))
    assert sorted(r.rec_id for r in splits.straddling(lost).collect()) == [0, 1, 5, 6]
    assert splits.straddling(df.unionByName(df)).count() == 4


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(f"i{k}", f"src-{k // 3}" if k > 900 else "src-hot", "train", None) for k in range(3000)]
    w = {"train": 0.7, "validation": 0.15, "test": 0.15}
    a = splits.assign_splits(records(spark, rows), w)
    assert a.groupBy("component").agg(F.countDistinct("assigned_split").alias("n")).where("n > 1").count() == 0
    shares = {r.assigned_split: r.share for r in splits.split_shares(a, w).collect()}
    assert abs(shares["train"] - 0.7) < 0.05 and abs(shares["test"] - 0.15) < 0.05
    assert splits.assign_splits(records(spark, rows).where("rec_id < 0"), w).count() == 0
    sizes = a.groupBy("component").agg(F.count("*").alias("n"))
    assert a.where(F.col("assigned_split") != splits.rendezvous(F.col("component"), splits.calibrated(sizes, w))).count() == 0  # one rule for all


def test_calibrated_weights(spark):
    sizes = spark.createDataFrame([(f"c{k}", 1 + k % 5) for k in range(4000)], "component string, n bigint")
    w = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.0}
    placed = {r.s: r.n for r in sizes.groupBy(splits.rendezvous(F.col("component"), splits.calibrated(sizes, w)).alias("s")).agg(F.sum("n").alias("n")).collect()}
    total = sum(placed.values())
    assert set(placed) == {"a", "b", "c"} and all(abs(placed[k] / total - w[k]) < 0.002 for k in placed)
    assert splits.calibrated(sizes.limit(0), {"a": 2.0, "b": 2.0}) == {"a": 0.5, "b": 0.5}


def test_numbers_are_names(spark):
    names, _ = splits.numbered(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string"))
    assert sorted(r.name for r in names.collect()) == ["a", "b"] and names.select("node").distinct().count() == 2


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 100), st.integers(0, 30), st.integers(0, 200)), min_size=1, max_size=12))
def test_largest_remainder(total, cells):
    rows = [(k, float(w), f, a) for k, (w, f, a) in enumerate(cells)]
    q = quotas.largest_remainder(total, rows)
    for k, w, f, a in rows:
        assert min(f, a) <= q[k] <= max(a, 0)
    room = sum(a if w > 0 else min(f, a) for _, w, f, a in rows)
    floors = sum(min(f, a) for _, _, f, a in rows)
    assert sum(q.values()) == min(max(total, floors), room)


def test_known_quotas():
    assert quotas.largest_remainder(10, [(1, 50, 0, 100), (2, 30, 0, 100), (3, 20, 0, 100)]) == {1: 5, 2: 3, 3: 2}
    assert quotas.largest_remainder(10, [(1, 1, 0, 100), (2, 1, 0, 100), (3, 1, 0, 100)]) == {1: 4, 2: 3, 3: 3}
    assert quotas.largest_remainder(10, [(1, 90, 0, 2), (2, 10, 3, 100)]) == {1: 2, 2: 8}
    assert quotas.largest_remainder(10, [(1, 99, 0, 100), (2, 1, 4, 100)]) == {1: 6, 2: 4}


TARGETS = "cell_id int, data_split string, answerability_label string, difficulty string, target_permille int, min_rows int, id string"


def test_sample_and_shortfalls(spark):
    rows = [(f"i{k}", " Train" if k % 2 else "train", "A", "easy" if k % 4 else "HARD", k) for k in range(400)] + [("i1", "train", "a", "easy", 1), ("n", None, "a", "easy", 1), ("o", "test", "a", "easy", 1)]
    df = spark.createDataFrame(rows, "id string, data_split string, answerability_label string, difficulty string, cell_id int")
    t = spark.createDataFrame([(1, "train", "a", "easy", 500, 5, "x"), (2, "train", "a", "hard", 400, 5, "x"), (3, "test", "a", "easy", 100, 20, "x"), (4, "test", "b", "easy", 0, 1, "x")], TARGETS)
    assert sorted(r.cell_id for r in quotas.short_cells(df, t).collect()) == [3, 4]
    a = {r.cell_id: r for r in quotas.allocate(df, t).collect()}
    n = 401 // 4
    assert sum(r.quota for r in a.values()) == n and a[3].quota == 1 and a[3].shortfall == 19 and a[4].quota == 0
    got = quotas.draw(df, t, buckets=16)
    counts = {r.cell_id: r["count"] for r in got.groupBy("cell_id").count().collect()}
    assert counts == {k: r.quota for k, r in a.items() if r.quota}
    keyed = df.where("difficulty <> 'HARD' and id <> 'n' and id <> 'o'").select("id").distinct().withColumn("k", F.xxhash64(F.lit(42), "id")).orderBy("k")
    assert {r.id for r in keyed.limit(counts[1]).collect()} == {r.id for r in got.where("cell_id = 1").collect()}
    empty = df.where("id = ''")
    assert quotas.draw(empty, t).count() == 0 and sorted(r.cell_id for r in quotas.short_cells(empty, t).collect()) == [1, 2, 3, 4]

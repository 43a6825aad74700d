from pyspark.sql import functions as F

from oreline.operators import dewey

SCHEMA = """rec_id bigint, node string, supporting_sentences array<struct<title:string,sent_id:int,sentence:string>>,
    context_documents array<struct<title:string,sentences:array<string>>>,
    metadata struct<negative_strategy:struct<replaced_supports:array<struct<title:string,sent_id:int>>,replacement_sentences:array<struct<title:string,sent_id:int,sentence:string>>>>"""


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def brute(data):
    out = set()
    for rec, _, supports, docs, meta in data:
        neg = (meta or (None,))[0] or (None, None)
        for link, items in (("supporting", supports), ("replaced", neg[0]), ("replacement", neg[1])):
            for pos, item in enumerate(items or []):
                title, sent = (item[0], item[1]) if item else (None, None)
                ok = title is not None and sent is not None and sent >= 0 and any(d and d[0] == title and len(d[1] or []) > sent for d in docs or [])
                if not ok:
                    out.add((rec, link, pos))
    return out


DATA = [
    (1, "x", [("A", 0, "s"), ("A", 2, "s"), ("B", 0, "s"), (None, 0, "s"), ("A", None, "s"), ("A", -1, "s")], [("A", ["one", "two"]), ("A", ["1", "2", "3"]), ("C", None)], ((([("C", 0)]), [("A", 1, "z")]),)),
    (2, None, None, None, None),
    (3, "y", [], [], ((None, []),)),
    (4, "y", [None, ("T" * 5000, 0, "")], [("T" * 5000, ["" * 9, "ü" * 20000]), None], None),
    (5, "y", [("a", 0, "s")], [("A", ["s"])], ((None, None),)),
]


def test_dead_links_equal_brute_force(spark):
    found = {tuple(r) for r in dewey.dead_links(rows(spark, DATA)).collect()}
    assert found == brute(DATA)
    assert dewey.dead_links(rows(spark, DATA + DATA)).count() == len(found)  # repeated rows


def test_links_name_their_context(spark):
    got = {(r.rec_id, r.link, r.pos): r.context_node for r in dewey.sentence_links(rows(spark, DATA)).collect()}
    links = dewey.sentence_links(rows(spark, DATA))
    sentences = {(r.rec_id, r.node): r.value for r in dewey.shred(rows(spark, DATA), "rec_id")["context_documents.sentences"].selectExpr("rec_id", "node", "value").collect()}
    led = {(r.link, r.pos): sentences[r.rec_id, r.sentence_node] for r in links.where("rec_id = 1 and sentence_node is not null").collect()}
    assert led == {("supporting", 0): "one", ("supporting", 1): "3", ("replacement", 0): "two"}
    assert links.where("(context_node is null) <> (sentence_node is null)").count() == 0
    assert got[1, "supporting", 0] == "3.0" and got[1, "supporting", 1] == "3.1" and got[1, "replacement", 0] == "3.0" and got[1, "replaced", 0] is None


def test_round_trip_and_parents(spark):
    tables = dewey.shred(rows(spark, DATA), "rec_id")
    back = {(r.rec_id, r.parent): r["items"] for r in dewey.unlabel(tables["context_documents.sentences"], "rec_id").collect()}
    assert back[1, "3.1"] == ["1", "2", "3"] and back[1, "3.0"] == ["one", "two"]
    t = tables["context_documents.sentences"]
    assert t.where(dewey.parent_of(F.col("node")) != F.col("parent")).count() == 0
    nodes = {(r.rec_id, r.node) for r in tables["context_documents"].select("rec_id", "node").collect()}
    assert {(r.rec_id, r.parent) for r in t.select("rec_id", "parent").collect()} <= nodes


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, [("n", 7, 8)])], "rec_id bigint, xs array<struct<node:string,pos:int,parent:int>>")
    t = dewey.shred(df, "rec_id")["xs"]
    assert t.columns == ["rec_id", "node", "parent", "pos", "node_", "pos_", "parent_"]
    empty = rows(spark, [])
    assert dewey.dead_links(empty).count() == 0 and all(x.count() == 0 for x in dewey.shred(empty, "rec_id").values())

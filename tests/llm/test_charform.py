from oreline.llm import charform

OUT = "gen_id bigint, rec_id bigint, evidence array<struct<quote:string>>, knowledge string"
KNOWN = "rec_id bigint, knowledge string"


def _tables(spark, quotes, knowledge):
    return spark.createDataFrame([(k, rec, [(q,)], "clash") for k, (rec, q) in enumerate(quotes)], OUT), spark.createDataFrame(knowledge, KNOWN)


def test_quotes_that_stand_as_they_are_get_their_form_too(spark):
    """Knowledge and quote with the same foreign letters, full-width digits, invisible characters and spaces."""
    o, k = _tables(spark, [(1, "оld mіll"), (1, "１９０７"), (1, "ca­fé"), (1, "the\ttown"), (1, "old mill"), (1, "​"), (1, "new mill"), (9, "оld")], [(1, "Near the оld mіll, in １９０７, a ca­fé​ fed the\ttown."), (2, None)])
    got = {r.gen_id: (r.canonical_quote, r.is_substring, r.looks_same, r.at) for r in charform.matched_quotes(o, k).collect()}
    assert got == {
        0: ("old mill", True, True, 9), 1: ("1907", True, True, 22), 2: ("café", True, True, 30), 3: ("the town", True, True, 39),
        4: ("old mill", False, True, 9), 5: ("", True, True, None), 6: ("new mill", False, False, None), 7: ("old", False, False, None),
    }
    assert sorted(r.gen_id for r in charform.lookalike_quotes(o, k).collect()) == [4]


def test_every_record_comes_out_in_the_form_quotes_are_found_in(spark):
    o, k = _tables(spark, [(1, "old mill")], [(1, "The оld mіll."), (2, "The nеw ﬁeld."), (3, None), (4, "")])
    assert {r.rec_id: r.canonical_knowledge for r in charform.canonical_records(o, k).collect()} == {1: "The old mill.", 2: "The new field.", 3: None, 4: ""}
    forms = charform.canonical_records(o, k)
    for r in charform.matched_quotes(o, k).join(forms.join(o.select("gen_id", "rec_id"), "rec_id"), "gen_id").collect():
        assert r.canonical_knowledge[r.at :].startswith(r.canonical_quote)


def test_a_quote_goes_by_the_script_of_its_record(spark):
    """A short quote all of whose letters are foreign has no Latin word of its own to tell it."""
    o, k = _tables(spark, [(1, "сор"), (2, "сор")], [(1, "A cop met the other one at the station near the old port."), (2, "Старый сор лежал у реки.")])
    assert [(r.gen_id, r.looks_same, r.is_substring) for r in charform.matched_quotes(o, k).orderBy("gen_id").collect()] == [(0, True, False), (1, True, True)]


def test_texts_of_all_scripts_are_counted(spark):
    """A consistent text stays as it is whatever its script, also words all of whose letters have Latin look-alikes."""
    text = "Երկիր հո սո նոր հոս քաղաք է"
    o, k = _tables(spark, [(1, "հոս"), (2, "uno hun soon oh us on no")], [(1, text), (2, "uno hun soon oh us on no hon nous house ohun"), (3, "ქართული ენა"), (4, "עברית")])
    scores = charform.bigram_scores(k.select(k.knowledge.alias("text")))
    assert {"^հ", "հո", "ქა", "עב", "ho"} <= set(scores)
    got = {r.rec_id: r.canonical_knowledge for r in charform.canonical_records(o, k).collect()}
    assert got == {r.rec_id: r.knowledge for r in k.collect()}

import math
import random

import pytest
from pyspark.sql import functions as F

from oreline.llm import charform, defects, endings, leakage, pii, truncation

PASSAGE = "Visitors reach the municipal foundry through Neramora, eight hours from the restored mill. In 1772, Royal Tarodale Press renovated the narrow museum near Upper Marirdale, next to the modest glasshouse. After the blockade of 1705, Brenholm Union secretly moved thirty miners to Zanaszell."


def test_one_form():
    s = charform.Speller()
    assert s.canonical("In whiсh уear did Мount ﬁne ｗｉｄｅ 1​2 a b é") == "In which year did Mount fine wide 12 a b é"
    assert s.canonical("В Москве рос старый дуб") == "В Москве рос старый дуб"
    assert s.canonical("") == "" and s.canonical("naïve ﬂag‐ship") == "naïve flag-ship"
    assert s.canonical("а" * 10_000 + " word word word") .endswith("word word word")
    scores = {"^c": -1.0, "ca": -1.0, "ap": -1.0, "^с": -9.0, "са": -9.0, "ар": -9.0}
    assert charform.Speller(scores).canonical("сар the dog") == "cap the dog"


def test_more_lookalikes(tmp_path):
    (tmp_path / "c.txt").write_text("\ufeff# a comment\n0501 ;\t0064 ;\tMA\t# d\n10E7 ;\t0079 ;\tMA\nA65F ;\t0061 0062 ;\tMA\n0031 ;\t006C ;\tMA\n\n", encoding="utf-8")
    groups = charform.lookalikes(str(tmp_path / "c.txt"))
    assert any(x.split() == ["y", "у", "γ", "ყ"] for x in groups.split("\n")) and groups.count("ԁ") == 1
    s = charform.Speller(groups=groups)
    assert s.canonical("manყ հօuse doors Ꮯlosed") == "many house doors Closed" and charform.Speller().canonical("manყ doors") == "manყ doors"
    assert charform.script_of("я") == 1 and charform.script_of("1") == charform.script_of("中") == -1
    assert charform.Speller().canonical("Երկիր հին քաղաք է") == "Երկիր հին քաղաք է"  # a text in one script stays


def test_bigrams_and_quotes(spark):
    out = "gen_id bigint, rec_id bigint, evidence array<struct<quote:string>>, knowledge string"
    o = spark.createDataFrame([(1, 1, [("the оld mіll",), ("the old mill",), ("The old mill",), (None,), ("",), ("café",), ("cafe",)], "clash"), (1, 1, [("the оld mіll",)], "clash"), (2, 9, [("x",)], "c"), (3, 2, None, "c"), (4, 2, [("ｘ",)], "c")], out)
    q = spark.createDataFrame([(1, "Near the old mill stands a café."), (2, None)], "rec_id bigint, knowledge string")
    assert sorted(tuple(r) for r in charform.lookalike_quotes(o, q).collect()) == [(1, 0), (1, 5)]
    assert charform.lookalike_quotes(o.where("gen_id < 0"), q).count() == 0
    b = charform.bigram_scores(spark.createDataFrame([("ab ab",), (None,), ("аб",), ("aб",)], "text string"))
    assert math.isclose(b["^a"], 0 + math.log(2 / 3)) and "aб" not in b and b["ab"] == 0


@pytest.mark.parametrize(("text", "want"), [
    ("Write to anna.berg+x@mail.example. Thanks", [("email", "anna.berg+x@mail.example")]),
    ("reach rosa_21 (at) north [dot] example now", [("email", "rosa_21 (at) north [dot] example")]),
    ("me at leon-a2 at post dot example most evenings", [("email", "leon-a2 at post dot example")]),
    ("rose to 735.26 @ Ostomnau. The handle @cider posted", []),
    ("Ring 020 7946 0561, ext. 12", [("phone", "020 7946 0561")]),
    ("Tel. +49 (0)30 23125-055 83 pilots", [("phone", "+49 (0)30 23125-055")]),
    ("The desk answers on ５５５-５７７-０１７０ at", [("phone", "５５５-５７７-０１７０")]),
    ("Part no. 665-665-2299 was shipped in 1928. ISBN 978-0-5301-5301-0", []),
    ("The passport number X58942679 was", [("identity", "X58942679")]),
    ("Tax ID: QQ 78 54 94 C The mill", [("identity", "QQ 78 54 94 C")]),
    ("Send to Flat 5, 122 Beacon Court, Ulm", [("address", "122 Beacon Court")]),
    ("wohnt Harrowstraße 208, 14297 Ulm", [("address", "Harrowstraße 208")]),
    ("Flat 1, Calle Saltmarsh, 23B, X", [("address", "Calle Saltmarsh, 23B")]),
    ("at 67 rue de la Juniper, 79626 X", [("address", "67 rue de la Juniper")]),
    ("Foxglove Street was paved in 1710. In 1904 Lantern Street", []),
    ("signed by Pavel Calloway-Finch. Dear A. Hesselby, hello", [("name", "Pavel Calloway-Finch"), ("name", "A. Hesselby")]),
    ("taken by Dr LINDQVALE, Marta during", [("name", "LINDQVALE, Marta")]),
    ("ask for pavel hartsune at the desk. ask for the porter", []),  # nothing says yet that these are names
    ("mailto:anna@north.example tel:+49 30 1234567 https://user@host.example/x", [("email", "anna@north.example"), ("phone", "+49 30 1234567"), ("email", "user@host.example")]),
    ("The Marta Stakes was first held. Dear Sir or Madam", []),
    ("", []), ("x" * 200_000, []),
])
def test_pieces(text, want):
    assert [(k, p) for k, p, _, _ in pii.find(text)] == want


def test_long_pieces():
    mail = "anna." * 30 + "berg@" + "post." * 30 + "example"
    street = "122 " + "Beacon" * 8 + " " + "Harbour" * 8 + " Court"
    assert [(k, p) for k, p, _, _ in pii.find(f"Write to {mail} today. Send to {street}, Ulm")] == [("email", mail), ("address", street)]


CORPUS = [
    "Mrs Anna Hartsune asked us. Herr Otto Berg was there. Dr Pavel Klein wrote. Dear Anna Klein, thank you. Frau Anna Berg and Mr Otto Klein came.",
    "The Pavel Bay was first held in 1928. Ships passed Pavel Bay at dusk. Pavel Bay lies south of Otto Stakes. The Royal Klein Works moved.",
]


def test_names_from_the_corpus(spark):
    text = "Yesterday Anna Berg met Otto Klein in the office, and ask for pavel hartsune or P. Hartsune. BERG, Anna and Otto K. Hartsune too. Pavel Bay and Otto Stakes lie south. Anna. Berg is a hill."
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*CORPUS, text, None, ""])], "doc_id bigint, text string")
    got = [r.pii for r in pii.personal_data(df).where("doc_id = 2 and kind = 'name'").collect()]
    assert sorted(got) == sorted(["Anna Berg", "Otto Klein", "pavel hartsune", "P. Hartsune", "BERG, Anna", "Otto K. Hartsune"])
    names = pii.Names(*pii.name_words(df))
    assert names.role("Anna,") & 1 and names.role("(Klein)") & 2 and not names.role("Bay") and not names.role("Stakes") and not names.role("Works")
    assert pii.find(text) == [] and pii.Names(*pii.name_words(df.limit(0))).unannounced(text) == []
    times = spark.createDataFrame([(k, t) for k, t in enumerate([*CORPUS * 7, text])], "doc_id bigint, text string")
    assert sorted(r.pii for r in pii.personal_data(times).where("doc_id = 14").collect()) == sorted(got)  # shares, not counts


def test_accounts():
    text = "My card number is 4539 1488 0343 6467, my IBAN DE89 3704 0044 0532 0130 00. Card 4539 1488 0343 6468 is wrong, IBAN DE88 3704 0044 0532 0130 00 too."
    assert [(k, p) for k, p, _, _ in pii.find(text, accounts=True)] == [("account", "4539 1488 0343 6467"), ("account", "DE89 3704 0044 0532 0130 00")]
    assert pii.find(text) == [] and pii.luhn("79927398713") and not pii.luhn("79927398710") and pii.iban("GB82 WEST 1234 5698 7654 32")


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "Call 555-946-0124 now. Mail a@b.example", "c"), (1, "Call 555-946-0124 now. Mail a@b.example", "c"), (2, None, "c"), (3, "", "c")], "doc_id bigint, text string, kind string")
    assert sorted(tuple(r) for r in pii.personal_data(docs).collect()) == [(1, "email", "a@b.example"), (1, "phone", "555-946-0124")]
    got = {r.doc_id: (r.text, r.n_found) for r in pii.redacted(docs).collect()}
    assert got == {1: ("Call [PHONE] now. Mail [EMAIL]", 2), 2: (None, 0), 3: ("", 0)}
    assert pii.personal_data(docs.where("doc_id < 0")).count() == 0


def test_leaks(spark):
    half = PASSAGE.split(". ")[1].replace("renovated", "renovatd").replace("museum", "mus eum")
    other = PASSAGE.replace("Neramora", "Ulm").replace("1772", "1801").replace("Tarodale", "Velmont").replace("Marirdale", "Oxford").replace("1705", "1999").replace("Brenholm", "Dorset").replace("Zanaszell", "Leeds")
    for a, b in (("municipal foundry", "painted harbour"), ("eight", "two"), ("restored mill", "rural well"), ("renovated", "leased"), ("narrow museum", "twin clock"), ("modest glasshouse", "inland quarry"), ("blockade", "storm"), ("secretly", "twice"), ("thirty miners", "six monks")):
        other = other.replace(a, b)
    docs = spark.createDataFrame([(1, "Intro. " + PASSAGE + " Outro.", "c"), (2, "Before. " + half + ". Behind us the sea.", "c"), (3, other, "c"), (4, None, "c"), (5, "", "c"), (6, "Visitors reach the municipal foundry.", "c"), (7, "filler words " * 20_000 + PASSAGE.upper(), "c")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE)], "item_id bigint, passage string")
    docs = docs.unionByName(spark.createDataFrame([(None, PASSAGE, "c")], docs.schema))
    got = {r.doc_id: r.part for r in leakage.carried(docs, items).collect()}
    assert set(got) == {1, 2, 7} and got[1] == 1.0 and 0.31 <= got[2] < 0.6
    assert leakage.carried(docs, items.where("item_id > 5")).count() == 0 and leakage.carried(docs.where("doc_id < 0"), items).count() == 0
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.part, 9), round(r.renamed, 9), r.kind) for r in df.collect())
    assert key(leakage.carried(docs, items, most=0)) == key(leakage.carried(docs, items))  # as tables
    counts = {r.item_id: r.n_docs for r in leakage.leaked_items(leakage.carried(docs, items), items.where("item_id is not null")).collect()}
    assert counts == {1: 3, 2: 0, 3: 0}


def test_plain_and_scattered_leaks():
    plain = "the old mill stood near a quiet river and its keepers ground the grain of every farm around while slow boats carried the flour down to many hungry towns below"
    mixed = plain + " In 1837, Neramora 12 Ulm 13 Oxford 14 Leeds 15 Dorset 16 Brenholm 17 Velmont 18 Tarodale 19 Marirdale 20 Zanaszell 21"
    for text, part in ((plain, 1.0), (mixed, 0.5)):
        found = leakage.scan(leakage.Passages([(1, text)]), ["Before. " + plain + ". After.", "Nothing of it."])
        assert [(r, n) for r, n, _, _ in found] == [(0, 0)] and found[0][2] >= part
    numbers = [f"{k}x" for k in range(300)]
    edited = " ".join("typo" if k % 6 == 5 else w for k, w in enumerate(numbers[:120]))
    assert [(r, n) for r, n, _, _ in leakage.scan(leakage.Passages([(1, " ".join(numbers))]), [edited])] == [(0, 0)]


def test_leak_does_not_depend_on_the_other_items():
    small, other = PASSAGE.lower(), "They met Neramora, Marirdale and Zanaszell by the river, and Brenholm in winter."
    alone = leakage.scan(leakage.Passages([(1, small)]), [small])
    beside = leakage.scan(leakage.Passages([(1, small), (2, other)]), [small])
    assert alone == beside == [(0, 0, 1.0, 0.0)]


def test_stock_phrases_are_no_leak():
    item = "In 1834, Toravik Trust electrified the suspended theatre near Morarmora, next to the municipal orchard. Morshire lies 46,465 metres above the upper promenade, where glassblowers once traded cider. Its sanatorium holds 64,855 barrels of copper, most of them shipped from Torgard by Ravburn Railway. The novel Under the Rural Sanatorium describes farmers who commissioned an embankment during the epidemic in Quilethrada."
    stock = "Lake Wynmora lies 111 metres above the southern promenade, where glassblowers once traded charcoal. Its glasshouse holds 64,855 barrels of pearls, most of them shipped from Morormere by United Maromlund League."
    typos = item.replace("promenade", "promenada").replace("glassblowers", "glasblowers").replace("shipped", "ship ped").replace("barrels", "barels")
    p = leakage.Passages([(1, item)])
    assert leakage.scan(p, [stock]) == [] and leakage.scan(p, [typos])[0][2] > 0.9


def test_renamed_leaks(spark):
    item = "In 1772, Royal Tarodale Press renovated the narrow museum near Upper Marirdale, next to the glasshouse. In 1790, Royal Tarodale Press sold it to thirty miners."
    renamed = item.replace("Royal Tarodale Press", "Velmont Union").replace("1772", "1911").replace("1790", "1954").replace("Upper Marirdale", "Ulm").replace("thirty", "six")
    torn = renamed.replace("In 1954, Velmont Union sold", "In 1954, Dorset Bank sold")
    docs = spark.createDataFrame([(1, "Intro. " + renamed + " Outro."), (2, item), (3, torn), (4, "In 1911, Velmont Union renovated the old well.")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, passage string")
    for most in (leakage.BROADCAST_CHARS, 0):
        got = {r.doc_id: r for r in leakage.carried(docs, items, most=most).collect()}
        assert {k: r.kind for k, r in got.items()} == {1: "renamed", 2: "carried", 3: "renamed"}
        assert got[1].renamed == 1.0 and got[2].part == 1.0 and 0.5 < got[3].renamed < 0.9  # the run ends where a slot stands for another
    counts = leakage.leaked_items(leakage.carried(docs, items), items).first()
    assert (counts.n_docs, counts.n_renamed, counts.most) == (1, 2, 1.0)


API = "gen_id bigint, rec_id bigint, model_tag string, prompt_style string, ok boolean, text string, cut string"
LOCAL = "gen_id bigint, rec_id bigint, model_tag string, text string"


def test_cut_texts(spark):
    whole = "In 1837, the Old Guild rebuilt the stone bridge near the lower harbour. Its keepers sold wool to many traders."
    rows = [
        (1, "flat", True, whole), (2, "flat", True, whole[:-14]), (3, "flat", True, "1837"), (4, "flat", True, "Old Guild"), (5, "flat", True, whole + "…"), (6, "flat", True, whole[:60] + "�"), (7, "flat", False, whole[:50]), (8, "flat", True, "  "), (9, "flat", True, None),
        (10, "structured", True, '{"a": "x } {", "b": [{"c": 1}]}'), (11, "structured", True, '{"a": "x", "b": [{"c": 1}'), (12, "structured", True, '```json\n{"a": 1}\n```'), (13, "structured", True, '{"a": "x'), (14, "flat", True, "N/A"),
        (15, "flat", True, whole + "\n- Old Guild\n- New Guild"), (16, "flat", True, "Who rebuilt the stone bridge near the harbour in 1837"), (2, "flat", True, whole[:-14]),
    ]
    api = spark.createDataFrame([(g, 1, "m", s, ok, t, "clash") for g, s, ok, t in rows], API)
    api = api.unionByName(spark.createDataFrame([(k, 1, "m", "flat", True, f"In {k}, the New Guild leased the mill number {k} near the old harbour.", "clash") for k in range(20, 50)], API))
    local = spark.createDataFrame([(101, 1, "l", whole[:70]), (102, 1, "l", None), (103, 1, "l", whole)], LOCAL)
    asked = spark.createDataFrame([(1, "Who rebuilt the stone bridge near the harbour in 1837?")], "rec_id bigint, question string")
    assert sorted(r.gen_id for r in truncation.cut_generations(api, local, asked).collect()) == [2, 5, 6, 11, 13, 101]
    rates = {r.model_tag: (r.n_texts, r.n_cut) for r in truncation.cut_rates(api, local, asked).collect()}
    assert rates == {"m": (14 + 30, 5), "l": (2, 1)}
    assert truncation.cut_generations(api.where("gen_id < 0"), local.where("gen_id < 0"), asked).count() == 0


WORDS = "river stone mill grain town boat keeper winter bridge market guild wool salt tower garden north south early late broken quiet narrow hollow".split()


def _essay(seed: int, n: int = 90) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def test_early_copies(spark):
    base = "the quick brown fox jumps over the lazy dog while seven old wizards boil green tea for the king of the northern hills and then"
    df = spark.createDataFrame([(base + " they all sleep.",), (base + " th",), (base + " they all sleep. More.",), (None,), ("short",), ("",), (base + " they all sleep",)], "text string")
    got = {r.text: r.partner for r in truncation.early_copies(df).collect()}
    longest = base + " they all sleep. More."
    assert got == {base + " th": longest, base + " they all sleep": longest}  # the last lacks its full stop
    assert truncation.early_copies(df.where("text = ''")).count() == truncation.early_copies(df.where("text is null")).count() == 0


@pytest.mark.parametrize("kept", [0.3, 0.5, 0.7])
def test_copies_that_lost_much(spark, kept):
    """Found by alignment alone: the endings look closed."""
    whole = [_essay(k) + "." for k in range(40)]
    cut = [w[: int(len(w) * kept)].rsplit(" ", 1)[0] + ")" for w in whole]
    df = spark.createDataFrame([(t,) for t in whole + cut], "text string")
    assert not any(r.cut for r in endings.cut_off(df).where("text like '%)'").collect())
    assert {r.text for r in truncation.early_copies(df).collect()} == set(cut)


def test_recall_of_copies_against_all_pairs(spark):
    """Lightly edited copies, cut anywhere: the rows found by banding are those of brute force."""
    r = random.Random(5)
    texts = []
    for k in range(60):
        words = _essay(k, r.randrange(20, 120)).split()
        texts.append(" ".join(words) + ".")
        short = words[: r.randrange(8, len(words))]
        if r.random() < 0.5:
            short[r.randrange(len(short))] = "edited"
        texts.append(" ".join(short))
    want = {a for a in texts if not a.endswith(".") and any(len(b) > len(a) and truncation._ends_early(a, b) for b in texts)}
    got = {x.text for x in truncation.early_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.9 * len(want)


def test_early_copy_behind_a_long_stranger(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog while seven old wizards boil green tea for the king of the northern hills and then"
    whole = base + " they all sleep."
    strangers = [f"{k} " + " ".join(f"other{j} words{k}" for j in range(60)) for k in range(30)]
    assert truncation._ends_early(base + " th", strangers[0]) is None and truncation._ends_early(base + " th", whole)
    one_bucket = F.udf(lambda t: [7] * truncation.BANDS if t else [], "array<bigint>")
    monkeypatch.setattr(truncation, "_bands", one_bucket)
    df = spark.createDataFrame([(x,) for x in [*strangers, whole, base + " th"]], "text string")
    assert [r.text for r in truncation.early_copies(df).collect()] == [base + " th"]


def test_endings_go_by_source(spark):
    """A source that leaves out its full stops is not judged by the others; size alone changes nothing."""
    r = random.Random(3)
    said = lambda k: f"In {1800 + k} the {r.choice(WORDS)} near the {r.choice(WORDS)} was sold to the {r.choice(('guild', 'town', 'market'))}"
    rows = [("tidy", said(k) + ".") for k in range(60)] + [("plain", said(k)) for k in range(60)] + [("tidy", "In 1837 the old mill near the river was sold to the")] + [("plain", "In 1837 the old mill near the river was sold to the")]
    for times in (1, 5):
        df = spark.createDataFrame(rows * times, "source string, text string")
        got = {(x.source, x.text) for x in endings.cut_off(df, "text", "source").where("cut").collect()}
        assert got == {("tidy", rows[-1][1]), ("plain", rows[-1][1])}
    assert endings.cut_off(df.limit(0), "text", "source").count() == 0


def test_defects(spark):
    q = spark.createDataFrame([(1, "In which year did the Old Guild rebuild the bridge near Ulm?", "Answerable "), (2, "Who owns the mill?", "unanswerable")], "rec_id bigint, question string, answerability_label string")
    flat = ["In 1837, the Old Guild rebuilt the bridge near Ulm.", "", "N/A", None, "in which year did the old guild rebuild the bridge near ulm", "Question: In which year did the Old Guild rebuild the bridge near Ulm?",
            "The question was: In which year did the Old Guild rebuild the bridge near Ulm? The answer is 1837.", "I'm sorry, but I cannot answer this question.", "In 1837. Its keepers could not answer for its upkeep.", "Im Jahr 1837 baute die alte Gilde die Brücke bei Ulm wieder auf.", "In 1837, the Old Guild rebuilt the bridge near U", "1837", "В 1837 году старая гильдия открыла мост."]
    api = spark.createDataFrame([(k, 1, "flat", True, t) for k, t in enumerate(flat)] + [(50, 2, "flat", True, "I cannot answer this question."), (51, 1, "flat", False, ""), (52, 1, "structured", True, "")], "gen_id bigint, rec_id bigint, prompt_style string, ok boolean, text string")
    out = spark.createDataFrame([(100, 1, "No answer can be given from this context.", "answerable"), (101, 1, "No answer can be given from this context.", "unanswerable"), (102, 9, None, None)], "gen_id bigint, rec_id bigint, answer string, answerability string")
    got = {r.gen_id: r.defect for r in defects.defects(api, out, q).collect()}
    assert got == {1: "empty", 2: "empty", 3: "empty", 4: "copy", 5: "copy", 7: "refusal", 9: "language", 10: "truncated", 12: "language", 100: "refusal", 102: "empty"}
    assert defects.defects(api.where("gen_id < 0"), out.where("gen_id < 0"), q).count() == 0


@pytest.mark.parametrize("text", ["No", "no.", "Sans", "Antwort", "respuesta", "0", "42"])
def test_short_answers_are_answers(text):
    assert not defects.is_empty(text)


@pytest.mark.parametrize("text", [None, "", " ​ ", "N/A", "(none)", "[no answer]", "--", "**No answer.**", "<empty>", "…"])
def test_nothing_said(text):
    assert defects.is_empty(text)


@pytest.mark.parametrize(("answer", "question", "want"), [("Who won", "Who won?", True), ("Who won?", "Who won in 1837?", False), ("Paris", "Who won?", False), ("谁赢得了比赛", "谁赢得了比赛？", True), ("红队赢得了比赛", "谁赢得了比赛？", False), ("Why?", "Why?", True)])
def test_copies_of_short_questions(answer, question, want):
    assert defects.is_copy(answer, question) is want


@pytest.mark.parametrize(("text", "want"), [
    ("谁在一八三七年建造了这座桥", "Han"), ("من بنى الجسر في المدينة القديمة", "Arabic"), ("Silta rakennettiin vuonna 1837 ja se on vanha", "fi"), ("Bron byggdes av gillet och den är inte ny", "sv"),
    ("この橋は古い町にあります", "Kana"), ("The bridge was built by the guild", "en"), ("Royal Tarodale Press", None), ("1837", None), ("", None),
])
def test_languages(text, want):
    assert defects.language(text) == want


def test_refusals():
    assert not defects.is_refusal("The text does not name Paris but Lyon as the seat.")
    assert defects.is_refusal("The text does not say who built it, but I cannot tell.") and defects.is_refusal("The passages do not mention it.")

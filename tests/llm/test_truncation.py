import random

import pytest

from oreline.llm import truncation

BASE = "the quick brown fox jumps over the lazy dog while seven old wizards boil green tea for the king of the northern hills"


def _brute(texts):
    """Each text that ends early beside any other, and the size of the longest such other."""
    out = {}
    for a in {t for t in texts if not t.endswith(".")}:
        sizes = [len(b) for b in set(texts) - {a} if truncation._ends_early(a, b)]
        if sizes:
            out[a] = max(sizes)
    return out


def _sizes(spark, texts):
    return {r.text: len(r.partner) for r in truncation.early_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}


def test_near_copy_that_ends_alike_hides_no_other(spark):
    """The longest near-copy ends otherwise, another goes on; and a longer text may have fewer letters."""
    cut = BASE + " and then they all sl"
    other = BASE + " while nobody in the whole wide valley ever came to look at the old and very big kettle again."
    whole = BASE + " and then they all sleep."
    assert truncation._ends_early(cut, other) is False and truncation._ends_early(cut, whole)
    spaced = BASE.replace(" ", "   ") + " and then"
    assert len(spaced) > len(whole) and truncation._ends_early(spaced, whole)
    assert _sizes(spark, [cut, other, whole, spaced]) == {cut: len(whole), spaced: len(whole)}


@pytest.mark.parametrize("most", [64, 2])
def test_every_early_copy_with_its_longest_partner(spark, monkeypatch, most):
    """As brute force says, where shared 5-grams are rare and where all are common."""
    monkeypatch.setattr(truncation, "BANDS", most)
    r = random.Random(11)
    texts = []
    for k in range(25):
        words = [f"{r.choice('abcdefgh')}{r.randrange(30)}{r.choice('xyz')}" for _ in range(r.randrange(9, 60))]
        for _ in range(8):
            some = list(words[: r.randrange(7, len(words) + 1)])
            for _ in range(r.randrange(0, 2 + len(some) // 20)):
                some[r.randrange(len(some))] = r.choice(("edited", "other", "words"))
            text = " ".join(some)
            texts.append(text[: -r.randrange(1, 3)] if r.random() < 0.4 else text + "." * r.randrange(2))
    want = _brute(texts)
    assert len(want) > 60 and _sizes(spark, texts) == want


def test_common_phrases_are_not_compared_all_with_all(spark, monkeypatch):
    """A phrase that all texts share bands them by their last word."""
    texts = [f"the answer to the question is place{k}" for k in range(400)]
    texts += [f"place{k} won the big game in the old city of ulm" for k in range(400)]
    cut = ["the answer to the question is place7 and", "place9 won the big game in the old ci"]
    whole = ["the answer to the question is place7 and place8."]
    seen = []
    early = truncation._candidates

    def counted(hashed, one):
        asks, has = early(hashed, one)
        seen.append(asks.join(has, "h").where("key <> other_key").select("key", "other_key").distinct().count())
        return asks, has

    monkeypatch.setattr(truncation, "_candidates", counted)
    all_texts = texts + cut + whole
    assert _sizes(spark, all_texts) == _brute(all_texts)
    assert seen[0] < 10 * len(all_texts)

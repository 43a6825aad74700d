"""Problem 4: one consistent form for text that looks the same but differs in its characters.

Compatibility normalization and deletion of ignorable characters come first. Tokens that then still
hold a letter with a look-alike in another script are spelled anew: a Viterbi search over the lattice
of look-alikes picks the best path that stays in one script, scored by character bigrams counted over
the script-consistent tokens of the whole corpus, with the text's main script as the prior.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of Latin, Cyrillic, Greek, Armenian and Cherokee that look alike, one group a line; more
# can be read from the public confusables table (:func:`lookalikes`).
LOOKALIKES = """
a а α
c с ϲ
d ԁ
e е
g ց
h һ հ
i і ι
j ј
k к κ
l ӏ
n п η ո
o о ο օ
p р ρ
q ԛ
s ѕ
u υ ս
v ѵ ν
w ԝ ω
x х χ
y у γ
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
D Ꭰ
E Е Ε Ꭼ
H Н Η Ꮋ
I І Ι
J Ј Ꭻ
K К Κ Ꮶ
L Ꮮ
M М Μ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
S Ѕ Տ Ꮪ
T Т Τ
V Ꮩ
W Ꮃ
X Х Χ
Y У Υ
Z Ζ Ꮓ
"""
# Dashes and quotation marks that read as the plain ones.
PLAIN_MARKS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "⁃": "-", "ʹ": "'", "ʼ": "'", "‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "‟": '"', "ˮ": '"'}

#: Default-ignorable and other invisible characters.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_SPACES = re.compile(r"[\s  -   　]")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts told apart, as the names of their characters begin.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "GEORGIAN", "HEBREW")
_LATIN = 0
_ONE_SCRIPT = r"^(?:[a-z\x{df}-\x{24f}]+|[\x{400}-\x{52f}]+|[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]+|" + "|".join(rf"\p{{Is{s}}}+" for s in SCRIPTS[3:]) + ")$"
_FLOOR = -14.0


@lru_cache(maxsize=65536)
def script_of(char: str) -> int:
    """Place of the character's script in :data:`SCRIPTS`, -1 for none of them."""
    name = unicodedata.name(char, "").split(" ", 1)[0]
    return SCRIPTS.index(name) if name in SCRIPTS and char.isalpha() else -1


def _alternatives(text: str) -> dict[str, dict[int, str]]:
    out: dict[str, dict[int, str]] = {}
    for line in text.split("\n"):
        group = {script_of(c): c for c in reversed(line.split())}
        for c in line.split():
            out[c] = group
    return out


def lookalikes(path: str) -> str:
    """Groups, one a line, from a file of the public confusables table (``source ; target ; type`` in code points,
    ``#`` comments): the letters of :data:`SCRIPTS` that share a target, beside the built-in ones."""
    groups: dict[str, list[str]] = {}
    for line in LOOKALIKES.split("\n"):
        for c in line.split():
            groups.setdefault(line.split()[0], []).append(c)
    head = {c: k for k, v in groups.items() for c in v}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = line.split("#", 1)[0].split(";")
            if len(parts) < 2 or len(parts[0].split()) != 1 or len(parts[1].split()) != 1:
                continue
            a, b = (chr(int(x.strip(), 16)) for x in parts[:2])
            if script_of(a) < 0 or script_of(b) < 0 or script_of(a) == script_of(b) or a in head:
                continue
            target = head.get(b, b)
            groups.setdefault(target, [target])
            if script_of(a) not in {script_of(c) for c in groups[target]}:
                groups[target].append(a)
                head[a] = head[b] = target
    return "\n".join(" ".join(v) for v in groups.values() if len(v) > 1)


_MARKS = {ord(k): v for k, v in PLAIN_MARKS.items()}
_MARK = re.compile("[" + "".join(PLAIN_MARKS) + "]")


def compatible(text: str) -> str:
    """NFKC without ignorable characters, with plain dashes, quotation marks and spaces."""
    if text.isascii():
        return _SPACES.sub(" ", text)
    text = IGNORABLE.sub("", unicodedata.normalize("NFKC", text))
    text = unicodedata.normalize("NFKC", text)
    return _SPACES.sub(" ", text.translate(_MARKS) if _MARK.search(text) else text)


class Speller:
    """Spells tokens in one script. ``scores``: log probability of each bigram (``^`` opens a token)
    by script, at most alphabet squared; without them only script consistency and the prior count."""

    def __init__(self, scores: Mapping[str, float] | None = None, groups: str = LOOKALIKES) -> None:
        self.scores = dict(scores or {})
        self.alternatives = _alternatives(groups)
        self.foreign = re.compile("[" + "".join(c for c in self.alternatives if script_of(c) != _LATIN) + "]")
        self.spell = lru_cache(maxsize=65536)(self._spell)

    def _spell(self, token: str, prior: int) -> str:
        """Viterbi over (position, script): a path changes script only where a letter has no form in
        the path's script, at a cost that outweighs any bigram."""
        best: dict[int, tuple[float, str]] = {s: (0.0 if s == prior else -4.0, "") for s in range(len(SCRIPTS))}
        for char in token:
            base = unicodedata.normalize("NFD", char)
            forms = self.alternatives.get(base[0])
            options = {s: unicodedata.normalize("NFC", c + base[1:]) for s, c in forms.items()} if forms else {script_of(char): char}
            step: dict[int, tuple[float, str]] = {}
            for s, form in options.items():
                for was, (score, path) in best.items():
                    bigram = (path[-1] if path else "^") + form
                    total = score + self.scores.get(bigram.lower(), _FLOOR if self.scores else -1.0) - (0 if was == s or s < 0 or was < 0 else 40.0)
                    if s not in step or total > step[s][0]:
                        step[s] = (total, path + form)
            best = step
        return max(best.values(), key=lambda x: x[0])[1]

    def canonical(self, text: str, beside: str | None = None) -> str:
        """The consistent form of ``text``; letter case and accents stay as they are. The main script is that of
        ``beside``, the text it is a part of, if that is given."""
        text = compatible(text)
        if text.isascii() or not self.foreign.search(text):
            return text
        counts = [0] * len(SCRIPTS)
        for word in _WORD.findall(text if beside is None else compatible(beside)):
            scripts = {script_of(c) for c in word}
            if len(scripts) == 1 and (s := scripts.pop()) >= 0:
                counts[s] += len(word)
        prior = counts.index(max(counts))
        return _WORD.sub(lambda m: self.spell(m[0], prior) if self.foreign.search(m[0]) else m[0], text)


def bigram_scores(texts: DataFrame) -> dict[str, float]:
    """Conditional log probabilities of letter bigrams over the script-consistent tokens of
    ``texts(text)``. Counted in the cluster over all rows; what comes back is one row per pair of
    letters of one of :data:`SCRIPTS`, bounded by their alphabets (about 2,000 code points), not by the
    data."""
    words = texts.where("text is not null").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    same = words.where(F.col("w").rlike(_ONE_SCRIPT)).groupBy("w").agg(F.count("*").alias("n"))
    pairs = same.select("n", F.concat(F.lit("^"), "w").alias("t")).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, F.lit(2)))).alias("p"))
    rows = pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()
    first: dict[str, int] = {}
    for r in rows:
        first[r.p[0]] = first.get(r.p[0], 0) + r.n
    return {r.p: log(r.n / first[r.p[0]]) for r in rows}


def canonical_column(spark: SparkSession, scores: Mapping[str, float] | None = None, groups: str = LOOKALIKES):
    """A function from a string column, and that of the texts it is a part of, to its consistent form; null stays
    null."""
    shared = spark.sparkContext.broadcast((dict(scores or {}), groups))
    made: list[Speller] = []

    @F.pandas_udf(StringType())
    def canonical(texts: pd.Series, beside: pd.Series) -> pd.Series:
        if not made:
            made.append(Speller(*shared.value))
        return pd.Series([None if t is None else made[0].canonical(t, b) for t, b in zip(texts, beside)], dtype=object)

    return lambda text, beside=None: canonical(text, text if beside is None else beside)


def quotes(outputs: DataFrame) -> DataFrame:
    """``gen_id, rec_id, pos, quote``: the distinct non-null quotes at their positions from 0."""
    return (
        outputs.select("gen_id", "rec_id", "evidence").select("gen_id", "rec_id", F.posexplode("evidence").alias("pos", "e"))
        .select("gen_id", "rec_id", "pos", F.col("e.quote").alias("quote")).where("quote is not null").distinct()
    )


def _speller(outputs: DataFrame, examples: DataFrame, groups: str):
    """:func:`canonical_column` by the bigrams of all knowledge and all quotes."""
    scores = bigram_scores(examples.select(F.col("knowledge").alias("text")).unionByName(quotes(outputs).select(F.col("quote").alias("text"))))
    return canonical_column(outputs.sparkSession, scores, groups)


def canonical_records(outputs: DataFrame, examples: DataFrame, groups: str = LOOKALIKES) -> DataFrame:
    """``rec_id, canonical_knowledge``: the knowledge of every record, quoted or not, in the form that
    :func:`matched_quotes` looks in."""
    return examples.select("rec_id", _speller(outputs, examples, groups)(F.col("knowledge")).alias("canonical_knowledge"))


def matched_quotes(outputs: DataFrame, examples: DataFrame, groups: str = LOOKALIKES) -> DataFrame:
    """Each quote beside its record's knowledge: ``gen_id, pos, quote, canonical_quote, is_substring,
    looks_same, at``.

    A quote is a substring as it stands, or looks the same as a passage when its consistent form is a
    non-empty substring of the knowledge's; ``at`` is the place from 0 where it first stands in that form, null
    for none. Every quote comes out in its consistent form, with the main script of the knowledge. Quotes
    of unknown records or null knowledge match nothing."""
    canonical = _speller(outputs, examples, groups)
    joined = quotes(outputs).join(examples.select("rec_id", "knowledge"), "rec_id", "left").withColumn("is_substring", F.coalesce(F.contains("knowledge", "quote"), F.lit(False)))
    formed = joined.withColumns({"canonical_quote": canonical(F.col("quote"), F.col("knowledge")), "canonical_knowledge": canonical(F.col("knowledge"))})
    at = F.when(F.trim("canonical_quote") != "", F.nullif(F.instr("canonical_knowledge", F.col("canonical_quote")), F.lit(0)) - 1)
    return formed.withColumn("at", at).select("gen_id", "pos", "quote", "canonical_quote", "is_substring", (F.col("is_substring") | F.col("at").isNotNull()).alias("looks_same"), "at")


def lookalike_quotes(outputs: DataFrame, examples: DataFrame) -> DataFrame:
    """``gen_id, pos`` of every quote that looks the same as a passage but is no substring of it."""
    return matched_quotes(outputs, examples).where("looks_same and not is_substring").select("gen_id", "pos").distinct()

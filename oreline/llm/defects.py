"""Problem 7: broken prompt and response pairs.

Copies are found by compressing each answer with its question as a zstandard dictionary, refusals and
languages by dictionaries, truncation by the terminal-context model of :mod:`.endings`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charform import compatible
from .endings import cut_off
from .splits import clean_label

# Function words by language.
LANGUAGES = {
    "de": "der die das den dem des ein eine einer einem einen und oder aber nicht kein keine ist sind war waren wird wurde wurden hat hatte haben im in am an auf aus bei beim bis durch für gegen mit nach neben ohne seit über um unter von vom vor zu zum zur als wie wenn wer was wann wo wohin welche welcher welches welchem welchen warum sich ich du er sie es wir ihr dieser diese dieses diesem noch nur auch obwohl jahr kann",
    "en": "the a an and or but not no is are was were be been has had have did does do in on at by for from to of with near next into through over under after before between until beside as if who what when where which whose why how many much that this these those it its they their he she his her i you we there here few some most both while above can cannot",
    "es": "el la los las un una unos unas y o pero no es son era fue fueron ha había hay en de del al a por para con sin sobre entre hasta desde hacia cerca junto como si quién quien qué que cuándo cuando dónde donde cuál cuántos su sus se lo le este esta esto ese esa yo me mi año todavía aunque más muy también tras según",
    "fr": "le la les l un une des et ou mais ne pas est sont était fut furent a avait ont en de du d au aux par pour avec sans sur sous entre jusque depuis vers près dans chez comme si qui que quoi quand où quel quelle quels quelles combien son sa ses se ce cette ces il elle ils je j me mon on y encore bien plus très aussi selon lors",
    "it": "il lo la i gli le un uno una e o ma non è sono era fu furono ha aveva in di del della dei delle al alla da dal dalla per con senza su sul tra fra fino verso presso come se chi che cosa quando dove quale quali suo sua si questo questa io mi anno ancora più molto anche dopo",
    "nl": "de het een en of maar niet geen is zijn was waren werd werden heeft had hebben in op aan bij uit door voor tegen met na naast zonder sinds over om onder van te tot als wie wat wanneer waar welke waarom zich ik hij zij wij dit deze dat die nog maar ook jaar",
    "pt": "o a os as um uma e ou mas não é são era foi foram há tem em no na nos nas de do da dos das ao à por para com sem sobre entre até desde perto como se quem que quando onde qual seu sua se este esta isso eu me ano ainda mais muito também após",
    "pl": "i oraz lub ale nie jest są był była było były w we na z ze do od po przy przez dla bez nad pod między aż jak jeśli kto co kiedy gdzie który która które się ten ta to ja rok jeszcze też",
    "sv": "och eller men inte är var har hade som att det den en ett på av för med till från om när vad vem hur också efter under mot ingen",
    "da": "og eller men ikke er var har havde som at det den en et på af for med til fra om når hvad hvem hvordan også efter under mod ingen blev",
    "fi": "ja tai mutta ei on oli ovat olivat se että joka jotka kun mitä missä kuka myös vuonna jälkeen ennen kanssa hän he tämä ole sen",
    "cs": "a nebo ale ne je byl byla bylo jsou v ve na z ze do od po při přes pro bez nad pod jak když kdo co který která které se také roku jeho",
    "tr": "ve veya ama değil bir bu şu o için ile gibi daha çok en ne kim nerede hangi olan olarak sonra önce yılında tarafından da de",
    "hu": "és vagy de nem van volt egy a az ez hogy mint ha aki ami mely hol mikor után előtt alatt mellett között is még csak már évben",
    "ro": "și sau dar nu este sunt era au avut un o în pe la de din cu pentru fără care ce cine când unde după înainte anul lui mai foarte",
    "ru": "и или но не нет в во на с со к ко из за от до по о об у при для без над под между через после перед как если кто что когда где куда который которая которое которые чей сколько он она оно они его её их это этот эта эти был была было были есть год году года где ещё тоже я мы вы",
}
# What stands for nothing said; whole answers, not words of them.
PLACEHOLDERS = frozenset("n/a|na|n.a.|none|null|nil|nan|nothing|empty|blank|undefined|tbd|no answer|no response|not available|keine antwort|sin respuesta|sans réponse|нет ответа".split("|"))
# Code points from .. to of the scripts told apart, by name.
SCRIPTS = {"Latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "Cyrillic": "Ѐ-ԯ", "Greek": "Ͱ-Ͽἀ-῿", "Hebrew": "֐-׿", "Arabic": "؀-ۿݐ-ݿ", "Devanagari": "ऀ-ॿ", "Thai": "฀-๿", "Hangul": "가-힯ᄀ-ᇿ", "Kana": "぀-ヿ", "Han": "㐀-鿿"}
# Refusals; a sentence that one of them matches says that no answer is given.
REFUSALS = [
    r"\b(?:i|we)(?: am|'m| are|'re)? (?:sorry|afraid)?,? ?(?:but )?(?:i |we )?(?:cannot|can't|can not|could not|couldn't|am unable to|are unable to|am not able to|must decline|have to decline|won't|will not|would rather not|do not know|don't know|prefer not)",
    r"\b(?:i|we) (?:cannot|can't|can not|could not|couldn't|must decline|have to decline|won't|will not|do not know|don't know|have no (?:answer|way|information))\b",
    r"\b(?:i am|i'm|we are|we're) (?:unable|not able|not in a position)\b",
    r"\b(?:there is|there's|there was) (?:not enough|insufficient|no|too little) (?:information|context|evidence|detail|answer)\b",
    r"\b(?:not enough|insufficient) (?:information|context|evidence) (?:to|is|was|for)\b",
    r"\bno (?:answer|reply|response) (?:can|could|may) be (?:given|found|determined|provided)\b",
    r"\b(?:text|passages?|context|knowledge|document|material|information|source)s?(?: (?:provided|given|supplied|above))? (?:gives? no|provides? no|offers? no|contains? no|lacks?)\b",
    r"\b(?:text|passages?|context|knowledge|document|material|information|source)s?(?: (?:provided|given|supplied|above))? (?:does not|do not|doesn't|don't|did not|didn't)\b(?!.*\bbut (?!i\b|we\b|it\b|no\b|not\b|there\b))",
    r"\b(?:it is|it's|it was) (?:impossible|not possible) to (?:know|tell|say|answer|determine|decide)\b",
    r"\b(?:question|answer) (?:cannot|can't|can not|could not) be (?:answered|determined|given|found)\b",
    r"\bas an ai\b",
    r"\b(?:lässt|laesst|kann|können|konnte) (?:sich )?(?:die|diese|dazu|ich|man|leider|auf)?\b.*\b(?:nicht|keine)\b.*\b(?:beantworten|antwort|antworten|sagen|geben|bestimmen)\b",
    r"\b(?:der|dem) text\b.*\b(?:nicht|keine antwort)\b.*\b(?:hervor|enthält|genannt)\b|\b(?:nicht genug|keine ausreichenden) (?:informationen|angaben)\b",
    r"\bne (?:peux|peut|pouvons|sais|saurais|donne|permet|contient|précise|fournit)\b.*\b(?:pas|aucune?)\b|\b(?:impossible de (?:répondre|savoir|dire)|pas assez d'(?:informations?|éléments))\b",
    r"\bno (?:puedo|podemos|se puede|es posible|ofrece|contiene|indica|da|dice|proporciona|sé)\b.*\b(?:responder|contestar|respuesta|saber|determinar|pregunta|dato|información)\b|\bno hay suficiente\b",
    r"\bне (?:могу|можем|могу дать|содержит|указан[оа]?|даёт|позволяет)\b.*\b(?:ответ\w*|вопрос\w*|сказать|информаци\w*)\b|\bнедостаточно (?:данных|информации)\b",
]
# Words with which a question is only introduced again.
ECHO = frozenset("question the your you my asked ask was is q frage die deine sie ihre fragten lautet lautete war ist la pregunta su era es usted preguntó preguntaste votre vous avez demandé était est domanda vraag вопрос ваш был repeat repeated again here".split())

_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
# a character of a script without spaces is a word of its own
_WORDS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W\d_぀-ヿ㐀-鿿฀-๿]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…。])[)\]\"'”’»]*\s+|\n+")
_SETS = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}


def script(text: str) -> str | None:
    """Script of most letters (over 0.6 of at least four; Kana beside Han is Kana); null if there is none."""
    letters = sum(map(len, _LETTERS.findall(text)))
    if letters < 4:
        return None
    counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    if counts["Kana"] > 0.1 * letters:
        counts["Kana"] += counts.pop("Han")
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] > 0.6 * letters else None


def language(text: str) -> str | None:
    """Language by script, where it is no Latin one, or by function words: at least two, and more than for
    any other; null if undecided."""
    written = script(text)
    if written == "Cyrillic":
        return "ru"
    if written and written != "Latin":
        return written
    words = _LETTERS.findall(text.lower())
    counts = sorted(((sum(w in s for w in words), k) for k, s in _SETS.items()), reverse=True)
    return counts[0][1] if counts[0][0] >= 2 and counts[0][0] > counts[1][0] else None


def is_empty(text: str | None) -> bool:
    """Nothing said: null, white space, invisible characters or a stand-in such as ``N/A``."""
    if text is None:
        return True
    t = compatible(text).strip().lower()
    return not t or t in PLACEHOLDERS or t.strip(" .!'\"`*_()[]<>{}") in PLACEHOLDERS or not re.search(r"\w", t)


def is_refusal(text: str) -> bool:
    """Whether sentences that refuse make up most of the text, counted in words."""
    refused = total = 0
    for s in _SENTENCE.split(compatible(text).strip()):
        n = len(_WORDS.findall(s))
        total += n
        refused += n * bool(_REFUSAL.search(s))
    return total > 0 and refused > 0.6 * total


def residue(text: str, question: str) -> int:
    """Bytes left of ``text`` when compressed with ``question`` as the dictionary, frame excluded."""
    data = zstandard.ZstdCompressionDict(question.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress(text.encode()))


def is_copy(text: str, question: str) -> bool:
    """Whether the answer is only the question given back: what compression leaves of it is small, most
    of the question is there in order, and no word is new but such as introduce a question."""
    q, a = _WORDS.findall(compatible(question).lower()), _WORDS.findall(compatible(text).lower())
    if not q or not a:
        return False
    plain_q, plain_a = " ".join(q), " ".join(a)
    if residue(plain_a, plain_q) > 12 + 0.25 * len(plain_q.encode()):
        return False
    known = set(q)
    if any(w not in known and w not in ECHO for w in a):
        return False
    it = iter(a)
    return sum(any(w == x for x in it) for w in q) >= 0.9 * len(q)


@F.pandas_udf(T.StringType())
def _defect(answers: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, questions, answerable in answers:
        out = []
        for t, q, yes in zip(texts, questions, answerable):
            if is_empty(t):
                out.append("empty")
                continue
            q = q if isinstance(q, str) else ""
            if q and is_copy(t, q):
                out.append("copy")
            elif is_refusal(t):
                out.append("refusal" if yes else "none")
            else:
                a = language(t) if q else None
                out.append("language" if a and (b := language(q)) and a != b else None)
        yield pd.Series(out, dtype=object)


def answers(api: DataFrame, outputs: DataFrame, examples: DataFrame) -> DataFrame:
    """``gen_id, answer, question, flat, answerable`` of every delivered pair: flat texts of calls that
    succeeded, under the record's label, and structured answers, under their own."""
    q = examples.select("rec_id", "question", clean_label(F.col("answerability_label")).alias("label"))
    flat = api.where("ok and prompt_style = 'flat'").select("gen_id", "rec_id", F.col("text").alias("answer"), F.lit(None).cast("string").alias("own"), F.lit(True).alias("flat"))
    parsed = outputs.select("gen_id", "rec_id", "answer", clean_label(F.col("answerability")).alias("own"), F.lit(False).alias("flat"))
    both = flat.unionByName(parsed).join(q, "rec_id", "left")
    label = F.when(F.col("flat"), F.col("label")).otherwise(F.col("own"))
    return both.select("gen_id", "answer", "question", "flat", F.coalesce(label == "answerable", F.lit(False)).alias("answerable"))


def defects(api: DataFrame, outputs: DataFrame, examples: DataFrame) -> DataFrame:
    """``gen_id, defect`` of every defective pair, one defect each: empty, copy, refusal, language or
    truncated, the first that applies.

    A refusal of what can't be answered is no defect, nor are refusals checked for language. Pairs of
    unknown records have no question to be copied from or compared with. Repeated deliveries count
    once; should they differ, the first defect by name stands."""
    pairs = cut_off(answers(api, outputs, examples), "answer", "flat").drop("ending")
    judged = pairs.withColumn("d", _defect("answer", "question", "answerable"))
    defect = F.when(F.col("d") == "none", F.when(F.col("cut"), "truncated")).when(F.col("d").isNotNull(), F.col("d")).when(F.col("cut"), "truncated")
    return judged.select("gen_id", defect.alias("defect")).where("defect is not null").groupBy("gen_id").agg(F.min("defect").alias("defect"))


def defect_counts(found: DataFrame) -> DataFrame:
    """``defect, n`` over all pairs found."""
    return found.groupBy("defect").agg(F.count("*").alias("n"))

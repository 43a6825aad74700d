"""Problem 10: personal information inside free text, by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, call and identity cues, street words, titles) in
one pass over each text; a deterministic local parser per kind expands every anchor to the exact
boundaries of the piece and validates it. Names also stand where no cue announces them: which words are given
and family names is counted over the whole corpus, from the names that titles and salutations do announce,
against all capitalised pairs; the counts sit in hashed counters, so what is broadcast is bounded. Besides
that pass over the texts the operator is one projection: no state, whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "identity", "phone", "address", "name")
#: Found on request: card and bank account numbers whose check digits hold.
ACCOUNT = "account"
#: Counters of name words by hash, and the least share of a word's capitalised pairs in which it is announced.
COUNTERS, ANNOUNCED = 1 << 20, 0.1
FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("pii", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))

# Cues, by kind.
EMAIL_ANCHORS = ("@", "(at)", "[at]", "{at}", " dot ", "[dot]", "(dot)")
PHONE_CUES = (
    "call", "ring", "mobile", "phone", "telephone", "tel", "tel.", "fax", "text me", "answers on", "reach me on", "dial", "sms", "whatsapp", "cell",
    "téléphone", "tél", "tél.", "portable", "appelez", "telefon", "handy", "mobil", "rufen sie", "anrufen", "teléfono", "tfno", "móvil", "llame", "телефон", "тел",
)
IDENTITY_CUES = (
    "passport", "social security", "identity card", "id card", "national id", "national insurance", "driving licence", "driving license", "driver's license", "driver licence", "licence no", "license no", "tax id", "tax number", "taxpayer", "ssn",
    "ausweisnummer", "ausweis", "personalausweis", "reisepass", "führerschein", "steuernummer", "steuer-id", "sozialversicherung", "carte d'identité", "passeport", "permis de conduire", "sécurité sociale", "numéro fiscal",
    "pasaporte", "dni", "nif", "nie", "seguridad social", "carné de conducir", "паспорт", "снилс", "инн",
)
ACCOUNT_CUES = ("iban", "card", "credit card", "debit card", "account", "konto", "kontonummer", "karte", "kreditkarte", "carte bancaire", "compte", "tarjeta", "cuenta", "карта", "счёт")
STREET_WORDS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "square", "sq", "court", "ct", "terrace", "way", "close", "row", "blvd", "boulevard", "drive", "dr", "place", "pl", "crescent", "gardens", "grove", "hill", "mews", "parade", "walk",
)
STREET_STEMS = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer", "damm", "ring")
STREET_LEADS = ("rue", "impasse", "chemin", "quai", "allée", "calle", "avenida", "plaza", "paseo", "camino", "via", "ulitsa", "улица", "ул.")
NAME_CUES = (
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "dr", "dr.", "prof", "prof.", "sir", "herr", "herrn", "frau", "señor", "señora", "sr.", "sra.", "don", "doña", "monsieur", "madame", "mme", "mlle", "m.",
    "dear", "sincerely", "regards", "yours", "cher", "chère", "liebe", "lieber", "estimado", "estimada", "contact", "contact person", "ansprechpartner", "ansprechpartnerin", "ansprechpartner ist", "ansprechpartnerin ist", "name", "name is", "je m'appelle", "me llamo", "ich heiße", "signed", "signed by", "gezeichnet", "signé", "firmado",
    "господин", "госпожа",
)
# Words that open no name, for pieces written in small letters or capitals.
NO_NAME = frozenset(
    "the a an this that these those my your his her its our their me you him us them it i we he she they who whom which what all any some no not sir madam madame editor editors friend friends reader readers team customer colleague colleagues "
    "of in on at to for from by with about and or but if as is are was were be been do does did have has had will would can could may please local old new der die das den dem des ein eine einer einem und ist war von mit für le la les un une des du de et est por para el los las una y es con more help details information advice permission directions "
    "both each every other another one two three several many few most such here there then now today people person porter manager office desk reception staff service support sales press".split()
)
# Width, space and dash variants, one character each, so that offsets hold.
_FLAT = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x9], 0x20) | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2212], 0x2D) | {0x2019: 0x27}
_ODD = re.compile("[" + "".join(map(chr, _FLAT)).replace("-", r"\-") + "]")

_SEP = r"(?: ?@ ?| ?[\[({]at[\])}] ?)"
_DOT = r"(?:\.| ?[\[({]dot[\])}] ?| dot )"
_EMAIL = re.compile(rf"[a-z0-9_%+-]+(?:\.[a-z0-9_%+-]+)*(?:{_SEP}(?:[a-z0-9-]+{_DOT})+[a-z]{{2,}}| at (?:[a-z0-9-]+(?: dot | ?[\[({{]dot[\])}}] ?))+[a-z]{{2,}})", re.I)
_DOMAIN = re.compile(r"[a-z0-9.-]*", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+.-")
_PHONES = [
    re.compile(p)
    for p in (
        r"(?:\+|00) ?49 ?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,6}(?:[ -]\d{2,5})?",
        r"(?:\+|00) ?33 ?(?:\(0\) ?)?\d(?:[ .-]?\d{2}){4}",
        r"(?:(?:\+|00) ?44 ?(?:\(0\) ?)?|0)\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}",
        r"(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}",
        r"(?:\+|00)\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}",
        r"\(?\d{2,5}\)?(?:[ ./-]?\d{2,5}){2,5}",
    )
]
_AFTER_PHONE = re.compile(r"(?:[ :.,-]|\b(?:me|us|at|on|under|is|no|number|nr|nummer|numéro|now|al|au|unter)\b){0,8}", re.I)
_IDS = [
    re.compile(p)
    for p in (
        r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]",
        r"\d{3}([ -])\d{2}\1\d{4}",
        r"\d{2} \d{3} \d{3} \d{3}",
        r"\d{8}-?[A-Z]",
        r"[A-Z]{1,3}-\d{2,4}-\d{3,5}-\d{2,4}",
        r"[A-Z]{1,3}\d{5,10}[A-Z]?",
        r"[A-Z0-9]+(?:[ ./-](?=[A-Z]*\d)[A-Z0-9]+)*(?:-[A-Z])?",
    )
]
_AFTER_ID = re.compile(r"(?:[ :.,#'-]|\b(?:card|number|numbers|no|nr|nummer|reads|is|was|id|licence|license|insurance|num|numéro|número|ist|lautet|es|est)\b){0,10}", re.I)
_WORD = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_]+)*"
_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĖĘĚĞĠĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŜŞŠŢŤŪŮŰŲŴŶŸŹŻŽА-ЯЁ]"
_NAME = re.compile(
    rf"(?:{_CAP}\.[ -]?(?:{_CAP}\. ?)?(?P<s1>{_CAP}{_WORD[len('[^\\W\\d_]'):]})|(?P<up>{_CAP}[^\W\d_a-zà-öø-ÿ'’-]+(?:-{_CAP}[^\W\d_a-zà-öø-ÿ]+)*), (?P<g2>{_CAP}{_WORD[len('[^\\W\\d_]'):]}|{_CAP}\.)|(?P<g3>{_CAP}{_WORD[len('[^\\W\\d_]'):]}) (?:{_CAP}\. ){{0,2}}(?P<s3>{_CAP}{_WORD[len('[^\\W\\d_]'):]}))"
)
_SMALL = re.compile(rf"(?P<g>{_WORD}|[^\W\d_]\.) (?:[^\W\d_]\. ){{0,2}}(?P<s>{_WORD})(?=[.,;:!?]|\s|$)")
_AFTER_NAME = re.compile(r"(?: ?:)? ?(?:(?:dr|prof|mr|mrs|ms|herr|frau|sir|don)\.? )?", re.I)
_NUMBER_FIRST = re.compile(rf"(?<![\w.,/-])\d{{1,4}}[a-zA-Z]? (?:{_CAP}[\w'’.-]* ){{1,3}}\Z")
_NUMBER_LAST = re.compile(r",? ?(?:n[o°º]\.? ?)?\d{1,4}(?:[ ]?[a-zA-Z](?![\w'’]))?(?![\w]|[.,]\d)")
_CARD = re.compile(r"\d(?:[ -]?\d){11,18}(?!\d)")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_AFTER_ACCOUNT = re.compile(r"(?:[ :.,#'-]|\b(?:number|numbers|no|nr|nummer|is|was|ist|lautet|num|numéro|número|es|est|card)\b){0,8}", re.I)
_ANY = re.compile(_WORD)
_BARE = re.compile(r"^[^\w]+|[^\w]+$")
# roles of blank-separated words: 1 given, 2 family, 3 either, 4 one letter
_TOGETHER = re.compile(rb"[\x01\x03]\x04{0,2}[\x02\x03]|\x04[\x02\x03]|[\x02\x03][\x01\x03]")
_FRENCH = re.compile(rf"(?<![\w.,/-])(\d{{1,4}}(?: ?(?:bis|ter)|[a-zA-Z])?,? )\Z")
_STREET_NAME = re.compile(rf" (?:(?:de la|de los|de las|de l['’]|del|de|des|du|d['’]|la|las|los|el) ?)?{_CAP}[\w'’-]*(?: {_CAP}[\w'’-]*)?")


def flat(text: str) -> str:
    """``text`` with width, space and dash variants made plain, character by character."""
    return text if text.isascii() and "\t" not in text else _ODD.sub(lambda m: chr(_FLAT[ord(m[0])]), text)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=1)
def announcing() -> ahocorasick.Automaton:
    """The cues of names alone."""
    a = ahocorasick.Automaton()
    for w in NAME_CUES:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors to (kind, length, whole word on the left, on the right)."""
    a = ahocorasick.Automaton()
    rows: dict[str, list] = {}

    def put(word: str, kind: str, left: bool, right: bool) -> None:
        rows.setdefault(word, []).append((kind, len(word), left, right))

    for w in EMAIL_ANCHORS:
        put(w, "email", False, False)
    for w in PHONE_CUES:
        put(w, "phone", True, True)
    put("+", "plus", False, False)
    for w in IDENTITY_CUES:
        put(w, "identity", True, True)
    for w in ACCOUNT_CUES:
        put(w, ACCOUNT, True, True)
    for w in STREET_WORDS:
        put(w, "street", True, True)
    for w in STREET_STEMS:
        put(w, "stem", False, True)
    for w in STREET_LEADS:
        put(w, "lead", True, True)
    for w in NAME_CUES:
        put(w, "name", True, True)
    for w, x in rows.items():
        a.add_word(w, x)
    a.make_automaton()
    return a


def _phone_at(text: str, at: int) -> tuple[int, int] | None:
    for p in _PHONES:
        m = p.match(text, at)
        if m and 7 <= sum(c.isdigit() for c in m[0]) <= 15 and not text[m.end() : m.end() + 1].isalnum():
            return m.start(), m.end()
    return None


def _identity_at(text: str, at: int) -> tuple[int, int] | None:
    for p in _IDS:
        m = p.match(text, at)
        if m and sum(c.isdigit() for c in m[0]) >= 5 and not text[m.end() : m.end() + 1].isalnum():
            return m.start(), m.end()
    return None


class Roles(dict):
    """Words as they stand, with the marks around them, to what they may be in a name."""

    def __init__(self, flags: np.ndarray) -> None:
        self.flags = flags

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = _BARE.sub("", word)
        made = self[word] = 4 if len(bare) == 1 and bare.isalpha() else int(self.flags[crc32(bare.lower().encode()) % len(self.flags)])
        return made


class Names:
    """Which words are given and family names: a flag per counter, from :func:`name_words`."""

    def __init__(self, given: np.ndarray, family: np.ndarray) -> None:
        self.roles = Roles(given.astype(np.uint8) + 2 * family.astype(np.uint8))

    def role(self, word: str) -> int:
        """1: given name, 2: family name, 3: either, 4: one letter, 0: neither."""
        return self.roles[word]

    def unannounced(self, text: str) -> list[tuple[int, int]]:
        """Spans of given and family name, initials and family name, or family name, given name."""
        known = self.roles
        if not _TOGETHER.search(bytes([known[w] for w in text.split()])):
            return []
        out = []
        words = list(_ANY.finditer(text))
        roles = [known[m[0]] for m in words]
        for k in range(len(words) - 1):
            a, b = words[k], words[k + 1]
            gap = text[a.end() : b.start()]
            if roles[k] & 1 and gap == " ":
                at = k + 1  # initials may stand between
                while at + 1 < len(words) and at < k + 3 and roles[at] == 4 and text[words[at].end() : words[at + 1].start()] == ". ":
                    at += 1
                if roles[at] & 2:
                    out.append((a.start(), words[at].end()))
            elif roles[k] == 4 and roles[k + 1] & 2 and gap in (". ", ".") and a[0].isupper() == b[0][0].isupper():
                out.append((a.start(), b.end()))
            elif roles[k] & 2 and a[0].isupper() and gap == ", " and roles[k + 1] & 1 and b[0][0].isupper():
                out.append((a.start(), b.end()))
        return out


def _name_at(text: str, at: int, names: Names | None = None) -> tuple[int, int] | None:
    m = _NAME.match(text, at)
    if m:
        words = [w for w in (m["s1"], m["up"], m["g2"], m["g3"], m["s3"]) if w]
        if not any(w.lower() in NO_NAME for w in words):
            return m.start(), m.end()
        return None
    m = _SMALL.match(text, at)
    if m and names and m["g"].islower() and m["s"].islower() and m["s"] not in NO_NAME:
        if names.role(m["g"]) & 1 or names.role(m["s"]) & 2:
            return m.start(), m.end()
    return None


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban(code: str) -> bool:
    """Whether the check digits of an international account number hold."""
    c = code.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _account_at(text: str, at: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, at)
    if m and iban(m[0]):
        return m.span()
    m = _CARD.match(text, at)
    return m.span() if m and luhn(re.sub(r"\D", "", m[0])) else None


def _local_start(text: str, at: int) -> int:
    """Start of the run of characters of a local part that ends before ``at``."""
    while at and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _words_back(text: str, at: int, n: int) -> int:
    """Where the ``n``-th space before ``at`` stands, or 0."""
    for _ in range(n):
        at = text.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def announced(text: str) -> list[tuple[str, str]]:
    """Given and family name (lower case; initials empty) of every capitalised name that a cue announces."""
    out = []
    low = _lower(text)
    for end, size in announcing().iter(low):
        start, stop = end - size + 1, end + 1
        if start and low[start - 1].isalnum() or stop < len(low) and low[stop].isalnum():
            continue
        m = _NAME.match(text, _AFTER_NAME.match(text, stop).end())
        if m and not any(w.lower() in NO_NAME for w in m.groups() if w):
            out.append(((m["g2"] or m["g3"] or "").lower().rstrip("."), (m["s1"] or m["up"] or m["s3"]).lower()))
    return out


def find(text: str | None, names: Names | None = None, accounts: bool = False) -> list[tuple[str, str, int, int]]:
    """``(kind, piece, start, stop)`` of every piece of personal data, in order, never overlapping.

    Without ``names`` only capitalised names that a cue announces are found. ``accounts``: also card and
    account numbers. Where pieces of different kinds overlap, the earlier kind of :data:`KINDS` wins, then
    the longer. Null and empty texts hold none."""
    if not text:
        return []
    t = flat(text)
    hits: list[tuple[int, int, str]] = []
    for end, rows in automaton().iter(low := _lower(t)):
        for kind, size, left, right in rows:
            start, stop = end - size + 1, end + 1
            if left and start and low[start - 1].isalnum() or right and stop < len(low) and low[stop].isalnum():
                continue
            span = None
            if kind == "email":
                lo, hi = _local_start(t, max(0, start - 80)), _DOMAIN.match(t, min(len(t), stop + 80)).end()
                for m in _EMAIL.finditer(t, lo, hi):
                    if m.start() < stop and m.end() > start:
                        span = _EMAIL.match(t, m.start()).span()  # as far as it goes
                        break
            elif kind == "phone":
                span = _phone_at(t, _AFTER_PHONE.match(t, stop).end())
            elif kind == "plus":
                span = _phone_at(t, start)
                kind = "phone"
            elif kind == "identity":
                span = _identity_at(t, _AFTER_ID.match(t, stop).end())
            elif kind == "name":
                after = _AFTER_NAME.match(t, stop)
                if after.end() > stop:
                    span = _name_at(t, after.end(), names)
            elif kind == ACCOUNT:
                span = _account_at(t, _AFTER_ACCOUNT.match(t, stop).end()) if accounts else None
            elif kind == "street":
                m = _NUMBER_FIRST.search(t, min(max(0, start - 60), _words_back(t, start, 5)), start)
                if m and low[max(0, m.start() - 3) : m.start()] not in ("in ", "of ", "by "):
                    span = m.start(), stop
                kind = "address"
            elif kind == "stem":
                head = start
                while head and t[head - 1].isalpha():
                    head -= 1
                m = _NUMBER_LAST.match(t, stop)
                if m and t[head].isupper() and head < start:
                    span = head, m.end()
                kind = "address"
            else:
                name = _STREET_NAME.match(t, stop)
                if name and name[0].strip()[-1:].isalnum():
                    before = _FRENCH.search(t, max(0, start - 12), start)
                    after = _NUMBER_LAST.match(t, name.end())
                    if before and not after and not low[: before.start()].endswith((" in ", " en ", "flat ", "apt ", "apartment ", "unit ", "piso ", "appt ")):
                        one = re.match(rf" (?:(?:de la|de los|de las|de l['’]|del|des|du|de|d['’]) ?)?{_CAP}[\w'’-]*", t[stop : name.end()])
                        span = before.start(), stop + (one.end() if one else name.end() - stop)
                    elif after:
                        span = start, after.end()
                kind = "address"
            if span:
                hits.append((*span, kind))
    if names:
        hits += [(a, b, "name") for a, b in names.unannounced(t)]
    if not hits:
        return []
    rank = (ACCOUNT, *KINDS).index
    hits.sort(key=lambda h: (rank(h[2]), h[0] - h[1], h[0]))
    kept: list[tuple[int, int, str]] = []
    for h in hits:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return [(kind, text[a:b], a, b) for a, b, kind in sorted(kept)]


def redact(text: str | None, found: list[tuple[str, str, int, int]]) -> str | None:
    """``text`` with each piece replaced by ``[EMAIL]``, ``[PHONE]``, ...; all else unchanged."""
    if not found:
        return text
    out, at = [], 0
    for kind, _, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


class Pairing(dict):
    """Words as they stand to a code: the counter of the bare word, times four, plus 1 if it is capitalised and
    longer than a letter, plus 2 if no mark follows."""

    def __missing__(self, word: str) -> int:
        bare = _BARE.sub("", word)
        made = self[word] = crc32(bare.lower().encode()) % COUNTERS * 4 + (len(bare) > 1 and bare[0].isupper()) + 2 * (word[-1:].isalnum())
        return made

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counters of the first and second words of all capitalised pairs."""
        codes = np.array([self[w] for t in texts for w in [*t.split(), "."]], dtype=np.int64)
        both = np.nonzero((codes[:-1] & 3 == 3) & (codes[1:] & 1 == 1))[0] if len(codes) else codes
        return codes[both] >> 2, codes[both + 1] >> 2


def name_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Flags per counter of given and family names, counted over all texts: a word counts as one where titles
    and salutations announce it in at least :data:`ANNOUNCED` of the capitalised pairs it opens (or closes).
    Each task sends a row per counter it saw; only flagged counters reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said, pairs = np.zeros((2, COUNTERS), dtype=np.int64), np.zeros((2, COUNTERS), dtype=np.int64)
        words = Pairing()
        for pdf in batches:
            words = words if len(words) < 500_000 else Pairing()
            texts = [flat(t) for t in pdf["text"] if isinstance(t, str)]
            for given, family in (x for t in texts for x in announced(t)):
                if len(given) > 1:
                    said[0, crc32(given.encode()) % COUNTERS] += 1
                said[1, crc32(family.encode()) % COUNTERS] += 1
                pairs[1, crc32(family.encode()) % COUNTERS] += 1
            first, second = words.pairs(texts)
            np.add.at(pairs[0], first, 1)
            np.add.at(pairs[1], second, 1)
        for role in (0, 1):
            c = np.nonzero(said[role] + pairs[role])[0]
            yield pd.DataFrame({"role": role, "c": c, "said": said[role, c], "pairs": pairs[role, c]})

    counts = docs.select("text").mapInPandas(run, "role int, c int, said bigint, pairs bigint").groupBy("role", "c").agg(F.sum("said").alias("said"), F.sum("pairs").alias("pairs"))
    rows = counts.where((F.col("said") > 0) & (F.col("said") >= ANNOUNCED * F.col("pairs"))).select("role", "c").toPandas()  # at most two per counter
    flags = np.zeros((2, COUNTERS), dtype=bool)
    flags[rows["role"].to_numpy(dtype=np.int64), rows["c"].to_numpy(dtype=np.int64)] = True
    return flags[0], flags[1]


def finder(docs: DataFrame, names: bool = True, accounts: bool = False):
    """A function from a text column to its ``redacted`` text and what was ``found``, by the name words of
    ``docs`` (counted now)."""
    shared = docs.sparkSession.sparkContext.broadcast(name_words(docs) if names else None)
    made: list[Names | None] = []

    @F.pandas_udf(T.StructType([T.StructField("redacted", T.StringType()), T.StructField("found", FOUND)]))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Names(*shared.value) if shared.value else None)
        for texts in batches:
            rows = [(redact(t, f), [{"kind": k, "pii": p, "start": a, "stop": b} for k, p, a, b in f]) for t in texts for f in (find(t, made[0], accounts),)]
            yield pd.DataFrame(rows, columns=["redacted", "found"])

    return found


def personal_data(docs: DataFrame, accounts: bool = False) -> DataFrame:
    """``doc_id, kind, pii`` of every distinct piece, exactly as it stands in ``text``. Empty and null texts
    hold none; an empty table gives an empty result; other columns are not read."""
    return docs.select("doc_id", F.explode(finder(docs, accounts=accounts)("text")["found"]).alias("f")).select("doc_id", "f.kind", "f.pii").distinct()


def redacted(docs: DataFrame, accounts: bool = False) -> DataFrame:
    """``doc_id, text, n_found``: the texts with typed placeholders; a null text stays null.
    Repeated rows and an empty table need no care, as each row is treated alone."""
    return docs.select("doc_id", finder(docs, accounts=accounts)("text").alias("r")).select("doc_id", F.col("r.redacted").alias("text"), F.size("r.found").alias("n_found"))

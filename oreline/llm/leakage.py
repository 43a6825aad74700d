"""Problem 8: evaluation texts leaking into training text, by template canonicalisation.

Every text is typed word by word from its own form: numbers, names (a run of them is one) and units
become typed placeholders, whose values are their slots. Windows of five template symbols are
hash-joined by the template alone; so are windows of five words as they stand, the template in which
nothing is a slot, which holds where letter case hides the names. Joined windows near one diagonal make
a candidate, which is aligned token by token: where the slots keep their values the passage is carried,
where they are consistently renamed it is re-parameterised. Light edits (typos, split words, other
character forms) stay inside a passage, while re-used phrases don't add up to one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .charform import Speller

#: Held-out characters up to which the window index is broadcast (some 40 bytes a character); beyond,
#: both sides' windows are joined as tables, with the same result.
BROADCAST_CHARS = 8_000_000
WINDOW = 5
#: Least part of the passage in running words.
LEAST = 1 / 3
#: Largest gaps in a chain of common blocks, in the passage and in the text.
_GAPS = 7, 12
_SAME, _SAME_SLOT, _OTHER, _OTHER_SLOT = 1.0, 1.5, -1.5, -3.0
#: Least likeness of two spellings of one word.
_ALIKE = 0.6
#: Part of ``LEAST`` that joined windows near one diagonal must cover before a pair is aligned, and the
#: most places between two of them: of windows as they stand, and of windows whose slots may differ.
_ANCHORED, _TEMPLATE = (0.4, 10), (1.0, 0)
_BAND = 24
#: Bits of a key that are looked up before the key itself.
_FILTER = 22
_PLAIN, _NUMBER, _NAME, _UNIT, _MARK = range(5)

_TOKEN = re.compile(r"[^\W_]+|[.!?…:»”\"]")
# Units of measure, and numbers as words.
UNITS = frozenset("metres meters feet miles kilometres km m cm barrels crates tons tonnes kg grams pounds litres gallons hours minutes days weeks months years percent euros dollars crowns meter stunden jahre tonnen mètres heures ans tonnes metros horas años".split())
NUMERALS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dos tres cuatro cinco seis siete ocho nueve diez deux trois quatre cinq sept huit neuf dix".split())
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


class Words(dict):
    """Words, as written, to their places in ``code`` (hash of the lower case; 0 for a mark that opens a
    sentence or quotation) and ``kind``."""

    def __init__(self) -> None:
        self.code: list[int] = []
        self.kind: list[int] = []

    def __missing__(self, word: str) -> int:
        low = word.lower()
        kind = _MARK if not word[0].isalnum() else _NUMBER if word[0].isdigit() or low in NUMERALS else _UNIT if low in UNITS else _NAME if word[0].isupper() and not (len(word) > 1 and word.isupper()) else _PLAIN
        made = self[word] = len(self.code)
        self.code.append(xxhash.xxh64_intdigest(low) if kind != _MARK else 0)
        self.kind.append(kind)
        return made

    def trimmed(self) -> Words:
        """Itself, or an empty one once it has grown large."""
        return self if len(self) < 500_000 else Words()


class Typed:
    """Texts as flat arrays: ``code`` and ``kind`` by token, ``text`` (its row), and the template's
    ``symbol`` with the first and last token (``first``, ``last``) of each."""

    def __init__(self, texts: Sequence[str | None], speller: Speller, known: Words) -> None:
        self.found = [_TOKEN.findall(t if t.isascii() else speller.canonical(t)) if t else [] for t in texts]
        ids = np.fromiter((known[w] for found in self.found for w in found), dtype=np.int64, count=sum(map(len, self.found)))
        text = np.repeat(np.arange(len(self.found)), [len(f) for f in self.found])
        kind = np.array(known.kind, dtype=np.int8)[ids]
        opens = np.append(True, (text[1:] != text[:-1]) | (kind[:-1] == _MARK))[: len(ids)]
        kind[opens & (kind == _NAME)] = _PLAIN
        word = kind != _MARK
        self.code, self.kind, self.text = np.array(known.code, dtype=np.uint64)[ids][word], kind[word], text[word]
        self.starts = np.searchsorted(self.text, np.arange(len(self.found) + 1))
        name = self.kind == _NAME
        goes_on = np.zeros(len(name), dtype=bool)
        goes_on[1:] = name[1:] & name[:-1] & (self.text[1:] == self.text[:-1])
        self.first = np.nonzero(~goes_on)[0]
        self.last = np.append(self.first[1:], len(name)) - 1 if len(name) else self.first
        self.symbol = np.where(self.kind == _PLAIN, self.code, self.kind.astype(np.uint64))[self.first]
        self.made: dict[int, list[str]] = {}

    def words(self, row: int) -> list[str]:
        """Lower-case words of one text."""
        if row not in self.made:
            self.made[row] = [w.lower() for w in self.found[row] if w[0].isalnum()]
        return self.made[row]

    def windows(self, template: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``key, text, at``: hash of each window, its row, and its first token's (symbol's) place there."""
        code, text = (self.symbol, self.text[self.first]) if template else (self.code, self.text)
        n = len(code) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key = np.full(n, 1 if template else 0, dtype=np.uint64)
        for k in range(WINDOW):
            key += code[k : k + n] * _MULT[k]
            key ^= key >> np.uint64(29)
        inside = text[:n] == text[WINDOW - 1 :]
        start = np.searchsorted(text, np.arange(len(self.found)))
        return key[inside], text[:n][inside], (np.arange(n) - start[text[:n]])[inside]

    def template(self, row: int) -> tuple[list[int], list[str], np.ndarray]:
        """Symbols of one text, their values (the words), and which are slots."""
        lo, hi = np.searchsorted(self.first, self.starts[row : row + 2])
        first, last = self.first[lo:hi] - self.starts[row], self.last[lo:hi] - self.starts[row]
        words = self.words(row)
        return self.symbol[lo:hi].tolist(), [" ".join(words[a : b + 1]) for a, b in zip(first, last)], self.kind[self.first[lo:hi]] != _PLAIN


def _run(item: list[str], doc: list[str], at: dict[int, int], slots: np.ndarray) -> int:
    """Length of the best-scoring run of a chain; ``at`` holds the places matched and where."""
    best, total, start, top = 0, 0.0, min(at), 0.0
    places = sorted(at)
    other = set()  # places whose word stands replaced by one that is not spelled alike
    for p, q in zip(places, places[1:]):
        if q - p > 1 and at[q] - at[p] == q - p:
            other.update(k for k in range(p + 1, q) if SequenceMatcher(None, item[k], doc[at[p] + k - p]).ratio() < _ALIKE)
    for k in range(places[0], places[-1] + 1):
        if total <= 0:
            total, start, top = 0.0, k, 0.0
        total += (_SAME_SLOT if slots[k] else _SAME) if k in at else (_OTHER_SLOT if slots[k] or k in other else _OTHER)
        if total > top:
            top = total
            best = max(best, k + 1 - start)
    return best


def _chains(item: list[str], doc: list[str]) -> Iterator[dict[int, int]]:
    """Places of ``item`` to places of ``doc``, per chain of common blocks over small gaps on both sides."""
    chain: dict[int, int] = {}
    last = None
    for m in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks():
        if last and (m.a - last.a - last.size > _GAPS[0] or m.b - last.b - last.size > _GAPS[1]):
            if chain:
                yield chain
            chain = {}
        if m.size:
            chain.update((m.a + k, m.b + k) for k in range(m.size))
            last = m
    if chain:
        yield chain


def running_part(item: list[str], slots: np.ndarray, doc: list[str]) -> float:
    """Part of ``item`` (``slots``: which of its tokens are numbers or names) that runs through ``doc``.

    In each chain of common blocks the best-scoring run counts, where common words gain, differing ones
    lose and differing slots and words replaced by others lose most. So a sentence of the same template with
    other names, numbers and things ends a run, and a typo doesn't."""
    return max((_run(item, doc, c, slots) for c in _chains(item, doc)), default=0) / max(1, len(item))


def renamed_part(item: tuple[list[int], list[str], np.ndarray], doc: tuple[list[int], list[str], np.ndarray]) -> float:
    """Part of the item's template that runs through the document's unbroken, with its slots consistently
    renamed: within a run each value of the item stands for one value of the document."""
    symbols, values, slots = item
    best = 0
    for m in SequenceMatcher(None, symbols, doc[0], autojunk=False).get_matching_blocks():
        means: dict[str, str] = {}
        since: dict[str, int] = {}
        start = 0
        for k in range(m.size):
            v, w = values[m.a + k], doc[1][m.b + k]
            if slots[m.a + k]:
                if means.get(v, w) != w:
                    start = max(start, since[v] + 1)
                means[v], since[v] = w, k
            best = max(best, k + 1 - start)
    return best / max(1, len(symbols))


class Passages:
    """Held-out passages with the sorted keys of their windows, as they stand and as templates."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        typed = Typed([t for _, t in rows], Speller(), Words())
        self.words = [typed.words(n) for n in range(len(rows))]
        self.templates = [typed.template(n) for n in range(len(rows))]
        self.slots = []
        for n in range(len(rows)):
            kind = typed.kind[typed.starts[n] : typed.starts[n + 1]]
            named = {w for w, k in zip(self.words[n], kind) if k in (_NUMBER, _NAME)}
            self.slots.append(np.array([w in named for w in self.words[n]], dtype=bool))
        self.index = []
        for template in (False, True):
            key, item, at = typed.windows(template)
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << _FILTER, dtype=bool)
            some[key >> np.uint64(64 - _FILTER)] = True
            self.index.append((key[order], item[order], at[order], some))
        self.sizes = [np.array([len(w) for w in self.words], dtype=np.int64), np.array([len(t[0]) for t in self.templates], dtype=np.int64)]


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``values`` and the place of each among them (by sorting: much faster here than by hash)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    code = np.empty(len(values), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return ordered[new], code


def _covering(row: np.ndarray, item: np.ndarray, at: np.ndarray, pos: np.ndarray, need: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """``(row, item, band)`` of the diagonal bands (each half over the next) in which the joined windows
    cover at least ``need[item]`` places of the passage with no more than ``gap`` left out between two."""
    if not len(row):
        return []
    pair, code = _codes(row * np.int64(len(need)) + item)
    band = (pos - at) // _BAND
    low = int(band.min())
    span = int(band.max()) - low + 2
    width = int(at.max()) + 1
    keys, _ = _codes(np.concatenate([((code * span + band - low + k) * width + at) for k in (0, 1)]))
    group, place = keys // width, keys % width
    new = np.append(True, (group[1:] != group[:-1]) | (np.diff(place) > (WINDOW + gap if gap else 1)))
    gain = np.where(new, WINDOW, np.minimum(WINDOW, np.diff(place, prepend=0)))
    heads = np.nonzero(new)[0]
    covered, group = np.add.reduceat(gain, heads), group[heads]
    pairs = pair[group // span]
    good = covered >= need[pairs % len(need)]
    return sorted(set(zip((pairs[good] // len(need)).tolist(), (pairs[good] % len(need)).tolist(), (group[good] % span + low).tolist())))


def _region(band: int, size: int) -> slice:
    return slice(max(0, (band - 1) * _BAND - 12), max(0, (band + 1) * _BAND + size + 12))


def judge(passages: Passages, docs: Typed, candidates: list[list[tuple[int, int, int]]], least: float) -> list[tuple[int, int, float, float]]:
    """``(row, item, part, renamed)`` of the candidates (as they stand, by template) that reach ``least``
    in either."""
    part: dict[tuple[int, int], float] = defaultdict(float)
    for r, n, band in candidates[0]:
        part[r, n] = max(part[r, n], running_part(passages.words[n], passages.slots[n], docs.words(r)[_region(band, len(passages.words[n]))]))
    renamed: dict[tuple[int, int], float] = defaultdict(float)
    for r, n, band in candidates[1]:
        if part.get((r, n), 0.0) < least:
            symbols, values, slots = docs.template(r)
            cut = _region(band, len(passages.templates[n][0]))
            renamed[r, n] = max(renamed[r, n], renamed_part(passages.templates[n], (symbols[cut], values[cut], slots[cut])))
    return [(r, n, part.get((r, n), 0.0), renamed.get((r, n), 0.0)) for r, n in sorted({*part, *renamed}) if max(part.get((r, n), 0.0), renamed.get((r, n), 0.0)) >= least]


def _needs(sizes: list[np.ndarray], least: float) -> list[np.ndarray]:
    return [np.maximum(1.0, part * least * s) for (part, _), s in zip((_ANCHORED, _TEMPLATE), sizes)]


def scan(passages: Passages, texts: Sequence[str | None], least: float = LEAST, speller: Speller | None = None, known: Words | None = None) -> list[tuple[int, int, float, float]]:
    """``(row, item, part, renamed)`` for the texts that carry at least ``least`` of an item's passage."""
    docs = Typed(texts, speller or Speller(), known if known is not None else Words())
    candidates = []
    for template, need in zip((False, True), _needs(passages.sizes, least)):
        keys, items, places, some = passages.index[template]
        key, row, pos = docs.windows(template)
        maybe = np.nonzero(some[key >> np.uint64(64 - _FILTER)])[0]
        key, row, pos = key[maybe], row[maybe], pos[maybe]
        lo = np.searchsorted(keys, key, side="left")
        hit = np.nonzero(keys[np.minimum(lo, len(keys) - 1)] == key)[0] if len(keys) else np.zeros(0, dtype=np.int64)
        if template and len(hit):  # an unbroken run of the least cover needs as many joined windows in a row
            run = np.cumsum(np.append(True, (np.diff(pos[hit]) != 1) | (np.diff(row[hit]) != 0))) - 1
            hit = hit[np.bincount(run)[run] >= need.min() - WINDOW + 1]
        n = np.searchsorted(keys, key[hit], side="right") - lo[hit]
        each = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        candidates.append(_covering(np.repeat(row[hit], n), items[each], places[each], np.repeat(pos[hit], n), need, (_ANCHORED, _TEMPLATE)[template][1]))
    return judge(passages, docs, candidates, least)


FOUND = "doc_id bigint, item_id bigint, part double, renamed double"


def _scanned(docs: DataFrame, rows: list[tuple[int, str]], least: float) -> DataFrame:
    """The documents beside the broadcast index: one pass over each text, no shuffle of either side."""
    shared = docs.sparkSession.sparkContext.broadcast(Passages(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller, known = Speller(), Words()
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                some = pdf.iloc[k : k + 500]
                ids = some["doc_id"].to_numpy()
                known = known.trimmed()
                found = scan(shared.value, [t if isinstance(t, str) else None for t in some["text"]], least, speller, known)
                yield pd.DataFrame([(ids[r], shared.value.ids[n], p, q) for r, n, p, q in found], columns=["doc_id", "item_id", "part", "renamed"])

    return docs.select("doc_id", "text").mapInPandas(run, FOUND)


def _window_table(df: DataFrame, row: str, text: str) -> DataFrame:
    """``row, template, key, at, size`` of all windows of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller, known = Speller(), Words()
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                some = pdf.iloc[k : k + 500]
                known = known.trimmed()
                typed = Typed([t if isinstance(t, str) else None for t in some[text]], speller, known)
                for template in (False, True):
                    key, at_row, at = typed.windows(template)
                    sizes = np.bincount(typed.text[typed.first] if template else typed.text, minlength=len(some))
                    yield pd.DataFrame({row: some[row].to_numpy()[at_row], "template": template, "key": key.astype(np.int64), "at": at, "size": sizes[at_row]})

    return df.select(row, text).mapInPandas(run, f"{row} bigint, template boolean, key bigint, at bigint, size bigint")


@F.pandas_udf(T.StructType([T.StructField("part", T.DoubleType()), T.StructField("renamed", T.DoubleType())]))
def _judged(texts: pd.Series, passages: pd.Series, plain: pd.Series, template: pd.Series, least: pd.Series) -> pd.DataFrame:
    out = []
    speller, known = Speller(), Words()
    for text, passage, a, b, x in zip(texts, passages, plain, template, least):
        docs = Typed([text], speller, known)
        found = judge(Passages([(0, passage)]), docs, [[(0, 0, int(k)) for k in bands] for bands in (a, b)], x)
        out.append(found[0][2:] if found else (0.0, 0.0))
    return pd.DataFrame(out, columns=["part", "renamed"])


def _joined(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The same with both sides as tables: windows are joined by hash, bands that cover enough of a passage
    make candidates, and only these meet their texts again. A band holds no more rows than its passage has
    windows; AQE splits keys that many documents share."""
    keyed = docs.where("text is not null").select("doc_id", "text").distinct().withColumn("row", F.xxhash64("doc_id", "text"))
    windows = _window_table(keyed, "row", "text").select("row", "template", "key", F.col("at").alias("pos"))
    held = _window_table(items, "item_id", "passage")
    band = F.floor((F.col("pos") - F.col("at")) / _BAND)
    met = windows.join(held, ["template", "key"]).select("row", "item_id", "template", "size", "at", F.explode(F.array(band, band + 1)).alias("band"))
    places = F.array_sort(F.collect_set("at"))
    zero = F.lit(0).cast("bigint")

    def covered(s: Column, x: Column) -> Column:
        n = F.when(x - s["last"] > F.when(F.col("template"), 1).otherwise(WINDOW + _ANCHORED[1]), zero).otherwise(s["n"]) + F.least(F.lit(WINDOW), x - s["last"])
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

    cover = F.aggregate(F.col("p"), F.struct(F.lit(-WINDOW).cast("bigint").alias("last"), zero.alias("n"), zero.alias("best")), covered)["best"]
    need = F.greatest(F.lit(1.0), F.when(F.col("template"), _TEMPLATE[0]).otherwise(_ANCHORED[0]) * least * F.col("size"))
    bands = met.groupBy("row", "item_id", "template", "band").agg(places.alias("p"), F.first("size").alias("size")).where(cover >= need)
    pairs = bands.groupBy("row", "item_id").agg(F.collect_list(F.when(~F.col("template"), F.col("band"))).alias("plain"), F.collect_list(F.when(F.col("template"), F.col("band"))).alias("renamed"))
    both = pairs.join(keyed, "row").join(items, "item_id")
    return both.select("doc_id", "item_id", _judged("text", "passage", "plain", "renamed", F.lit(float(least))).alias("x")).select("doc_id", "item_id", "x.*").where(F.greatest("part", "renamed") >= least)


def carried(docs: DataFrame, items: DataFrame, least: float = LEAST, most: int = BROADCAST_CHARS) -> DataFrame:
    """``doc_id, item_id, part, renamed, kind`` of every document that carries at least ``least`` of a
    passage in running words, give or take light edits (``kind`` ``carried``), or of its template with
    consistently other numbers, names and units (``renamed``).

    Null or empty texts and passages carry nothing, nor do rows without an id; passages under five words have
    no window; repeated rows count once; extra columns on either side are not read. An empty side gives an
    empty result."""
    held = cut_lineage(items.select("item_id", "passage").where("passage is not null and item_id is not null").distinct())
    docs = docs.where("doc_id is not null")
    size = held.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first().n
    if size <= most:
        rows = [(r.item_id, r.passage) for r in held.orderBy("item_id", "passage").collect()]  # at most ``most`` characters
        found = _scanned(docs, rows, least)
    else:
        found = _joined(docs, held, least)
    best = found.groupBy("doc_id", "item_id").agg(F.max("part").alias("part"), F.max("renamed").alias("renamed"))
    return best.withColumn("kind", F.when(F.col("part") >= least, "carried").otherwise("renamed"))


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, n_docs, n_renamed, most`` for every item: how many documents carry it, how many its
    template with other slots, and the largest part carried."""
    counts = found.groupBy("item_id").agg(F.count_if(F.col("kind") == "carried").alias("n_docs"), F.count_if(F.col("kind") == "renamed").alias("n_renamed"), F.max("part").alias("most"))
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", zero("n_docs", 0), zero("n_renamed", 0), zero("most", 0.0))

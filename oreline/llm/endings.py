"""How texts end: the terminal-context model shared by problems 3 and 7.

An ending is closed (terminal punctuation), marked as cut (an ellipsis, a broken character, an open
connector) or open. Open endings are judged by their segment, the words since the last sentence or
line end, and by the terminality of the closing word: how often, over the whole corpus, it closes a
segment where a segment really ends. How many of a source's open endings are complete is estimated from
the same rates, so that a source that leaves out its full stops is not judged by those of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Longest short answer or list item in words; longer segments are sentences.
SHORT_WORDS, ITEM_WORDS = 5, 8
#: A closing word that closes segments more rarely than this ends nothing.
RARELY = 0.02
#: Weight, in occurrences, of the corpus in the rate of a word and in the estimate for a source.
WORD_PRIOR, SOURCE_PRIOR = 5.0, 20.0

_IGNORABLE = r"[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
_CLOSERS = r"[)\]\"'”’»“›]*"


def bare(text: Column) -> Column:
    """Text without ignorable characters and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, _IGNORABLE, ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def with_ending(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``ending``: struct of ``state`` (blank, marked, closed, open; null for null),
    ``words`` of the last segment, ``whole`` (the segment is the whole text), ``item`` (the last line is
    a list item) and the closing ``word`` in lower case."""
    t = bare(F.col(text))
    line = F.regexp_extract(t, r"([^\n]*)$", 1)
    segment = F.regexp_extract(line, rf"^(?:.*[.!?。！？]{_CLOSERS}[\s\p{{Z}}]+)?(.*)$", 1)
    state = (
        F.when(t.isNull(), None)
        .when(~t.rlike(r"[\p{L}\p{N}]"), "blank")
        .when(t.rlike(r"(?:…|\.\.\.|\x{fffd})[)\]]?$|[,;:(\[{/&–—]$|(?<=[\p{L}\p{N}])[ -]*-$"), "marked")
        .when(t.rlike(rf"[.!?。！？؟]{_CLOSERS}$|[)\]\"”’»]$"), "closed")
        .otherwise("open")
    )
    return df.withColumn(
        "ending",
        F.struct(
            state.alias("state"),
            F.size(F.regexp_extract_all(segment, F.lit(r"([^\s\p{Z}]+)"), 1)).alias("words"),
            (segment == t).alias("whole"),
            (t.contains("\n") & line.rlike(r"^\s*(?:[-*•–]|\d+[.)])\s")).alias("item"),
            F.lower(F.regexp_extract(t, r"([\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’-]*)[^\p{L}\p{N}]*$", 1)).alias("word"),
        ),
    )


def terminality(texts: DataFrame, text: str) -> DataFrame:
    """``word, seen, closing`` counted over all of ``texts``: how often a word occurs, and how often it
    closes a segment (before terminal punctuation, at the end of a line that others follow, or of a short
    text). Partial aggregation before the only shuffle."""
    t = F.lower(bare(F.col(text)))
    # the last segment counts as an ending only if it is closed or is a short text of its own
    marked = F.concat(t, F.when(t.rlike(rf"[.!?。！？]{_CLOSERS}$"), F.lit("")).when(F.size(F.split(t, r"\s+")) <= SHORT_WORDS, F.lit("\n")).otherwise(F.lit("")))
    parts = texts.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(marked, F.lit(rf"([\p{{L}}\p{{M}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}'’-]*(?:(?=[.!?。！？]+{_CLOSERS}(?:\s|$))|(?=\s*\n))?[.\n]?)"), 1)).alias("w"))
    return parts.groupBy(F.regexp_replace("w", r"[.\n]$", "").alias("word")).agg(F.count("*").alias("seen"), F.count_if(F.col("w").rlike(r"[.\n]$")).alias("closing"))


def cut_off(texts: DataFrame, text: str = "text", source: str | None = None) -> DataFrame:
    """``texts`` with ``cut``: whether the value ends before its end, by its ending alone.

    Marked endings are cut. Open endings: a short text or list item is cut only if its closing word hardly
    ever closes anything. A sentence is cut if that is likelier than that it is complete: the share of
    complete ones among the open endings of its ``source`` (null is one too; none: all are one) lies where
    their closing words' rates lie between those of any words and of closed endings, and a word speaks for
    completeness as far as it closes segments more often than words do. Rates and shares are smoothed
    towards the corpus, so that they move with the evidence and not at a count. Null and blank texts are
    not cut. Counts cover every row; repeated rows weigh as often as they occur."""
    src = F.coalesce(F.col(source).cast("string"), F.lit("\0")) if source else F.lit("")
    ended = cut_lineage(with_ending(texts, text).withColumn("_src", src))  # read again for the words, the shares and the result
    counts = cut_lineage(terminality(ended, text))
    whole = counts.agg(F.sum("closing").alias("c"), F.sum("seen").alias("n"), F.sum(F.col("closing") * F.col("closing") / F.col("seen")).alias("s")).first()
    p = (whole.c + 1.0) / (whole.n + 2.0) if whole.n else 0.1
    anywhere = (whole.s + p) / (whole.n + 1.0) if whole.n else p  # mean rate of the words at any place
    rate = (F.coalesce("closing", F.lit(0)) + WORD_PRIOR * p) / (F.coalesce("seen", F.lit(0)) + WORD_PRIOR)
    long = ((F.col("ending.words") > SHORT_WORDS) | ~F.col("ending.whole")) & ~F.col("ending.item")
    judged = ended.where(F.col("ending.state").isin("open", "closed") & long)
    endings = judged.groupBy("_src", (F.col("ending.state") == "open").alias("open"), F.col("ending.word").alias("word")).agg(F.count("*").alias("n")).join(counts, "word", "left")
    sums = endings.groupBy("_src").agg(*(F.sum(F.when(F.col("open") == side, x)).alias(name) for side, name, x in ((True, "no", F.col("n")), (True, "ro", F.col("n") * rate), (False, "nc", F.col("n")), (False, "rc", F.col("n") * rate)))).na.fill(0)
    total = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("no", "ro", "nc", "rc"))).first()
    closed = total.rc / total.nc if total.nc else 1.0
    share = lambda mean: min(1.0, max(0.0, (mean - anywhere) / max(closed - anywhere, 1e-6)))
    common = share(total.ro / total.no) if total.no else 0.5
    own = F.when(F.col("no") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ro") / F.col("no") - anywhere) / max(closed - anywhere, 1e-6)))).otherwise(0.0)
    complete = F.greatest(F.lit(0.02), F.least(F.lit(0.98), (own * F.col("no") + SOURCE_PRIOR * common) / (F.col("no") + SOURCE_PRIOR)))
    shares = sums.select("_src", complete.alias("_complete"))
    words = counts.select(F.col("word").alias("_w"), rate.alias("_rate"))
    open_ = ended.where("ending.state = 'open'").join(words, F.col("ending.word") == F.col("_w"), "left").join(shares, "_src", "left").withColumns({"_rate": F.coalesce("_rate", F.lit(p)), "_complete": F.coalesce("_complete", F.lit(common))})
    short = F.col("ending.whole") & (F.col("ending.words") <= SHORT_WORDS) | F.col("ending.item") & (F.col("ending.words") <= ITEM_WORDS)
    cut = F.when(short, (F.col("_rate") < RARELY) & (F.col("ending.words") > 1)).otherwise((1 - F.col("_complete")) * p > F.col("_complete") * F.col("_rate"))
    rest = ended.where("not (ending.state <=> 'open')").withColumn("cut", F.coalesce(F.col("ending.state") == "marked", F.lit(False)))
    return rest.unionByName(open_.withColumn("cut", cut).drop("_w", "_rate", "_complete")).drop("_src")

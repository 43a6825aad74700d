"""Pluggable scorers with deterministic offline defaults.

A scorer is a function from string columns to a column, so a model can be put in as an Arrow UDF
(loaded once per worker in an iterator UDF) without touching a plan; the defaults are expressions.
"""

from __future__ import annotations

import asyncio
import inspect
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .coerce import let
from .text import answer_tokens, token_f1, word_count

ERROR_TEXT = "__API_GENERATION_ERROR__"


def lexical_nli(premise: Column, hypothesis: Column) -> Column:
    """``entail, neutral, contradict`` from the share of the hypothesis' distinct words found in the
    premise; a hypothesis without words is neutral."""
    share = let(F.array_distinct(answer_tokens(hypothesis)), lambda h: F.when(F.size(h) > 0, F.size(F.array_intersect(h, answer_tokens(premise))) / F.size(h)).otherwise(F.lit(0.0)))
    return let(share, lambda s: F.struct(s.alias("entail"), ((1 - s) * 0.75).alias("neutral"), ((1 - s) * 0.25).alias("contradict")))


def lexical_match(question: Column, reference: Column, answer: Column) -> Column:
    return token_f1(answer, reference)


# What tells kinds of entities apart, as patterns that need no lookaround.
ENTITIES = {
    "PERSON": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sir|Dame|Lord|Lady|King|Queen|Herr|Frau)\.? \p{Lu}|\b\p{Lu}\p{Ll}+ (?:\p{Lu}\. ?)?\p{Lu}\p{Ll}+",
    "ORG": r"\p{Lu}\p{L}+ (?:Guild|Company|Council|Society|Union|League|Trust|Bank|Press|Institute|Foundation|Brothers|Railway|Works|University|College|Academy|Corporation|Party|Club|Inc|Ltd|Group|Association|Agency|Ministry)\b",
    "GPE": r"\b(?:in|at|near|from|to|of|through|bei|von|aus|en|de|cerca de|près de) \p{Lu}\p{L}+",
    "LOC": r"\b(?:Lake|Mount|Port|River|Cape|Upper|Lower|Saint|San|New|North|South|East|West) ?-?\p{Lu}\p{L}+",
    "DATE": r"\b\d{4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b",
}


def rule_entities(text: Column) -> Column:
    """Entity labels whose pattern the text matches."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in ENTITIES.items()])).cast("array<string>")


@dataclass(frozen=True)
class Scorers:
    nli: Callable[[Column, Column], Column] = lexical_nli
    match: Callable[[Column, Column, Column], Column] = lexical_match
    entities: Callable[[Column], Column] = rule_entities
    tokens: Callable[[Column], Column] = word_count


DEFAULT = Scorers()


@dataclass(frozen=True)
class Attempt:
    """One call's outcome; ``usage``: prompt and completion tokens where the provider counts them."""

    ok: bool
    text: str
    error_type: str | None = None
    error_message: str | None = None
    usage: tuple[int, int] | None = None


@dataclass(frozen=True)
class Retry:
    """How calls are made: how many at a time, how long each may take, and how often one that fails in passing
    (a listed status, a time-out or a network error) is made again, after pauses that grow and vary."""

    retries: int = 3
    base_seconds: float = 0.5
    max_seconds: float = 8.0
    jitter: tuple[float, float] = (0.8, 1.2)
    timeout_seconds: float = 90.0
    concurrency: int = 64
    statuses: frozenset = field(default_factory=lambda: frozenset({408, 429, *range(500, 600)}))

    def passing(self, error: Exception) -> bool:
        names = {c.__name__ for c in type(error).__mro__}
        return getattr(error, "status", None) in self.statuses or isinstance(error, TimeoutError | ConnectionError) or bool(names & {"TimeoutException", "NetworkError", "Timeout"})

    def pause(self, attempt: int, draw: float) -> float:
        low, high = self.jitter
        return min(self.max_seconds, self.base_seconds * 2 ** (attempt - 1)) * (low + (high - low) * draw)


GENERATED = "ok boolean, text string, error_type string, error_message string, usage_prompt_tokens int, usage_completion_tokens int, usage_source string, attempt_count int"


async def _called(call: Callable, prompt: str, seed: int, retry: Retry, pool, draw: Callable[[], float]) -> tuple[Attempt, int]:
    for attempt in range(1, retry.retries + 2):
        try:
            if inspect.iscoroutinefunction(call):
                made = call(prompt, seed)
            else:
                made = asyncio.get_running_loop().run_in_executor(pool, call, prompt, seed)
            out = await asyncio.wait_for(made, retry.timeout_seconds)
            return (out if isinstance(out, Attempt) else Attempt(True, out)), attempt
        except Exception as e:  # noqa: BLE001
            if attempt > retry.retries or not retry.passing(e):
                return Attempt(False, ERROR_TEXT, type(e).__name__, str(e)), attempt
            await asyncio.sleep(retry.pause(attempt, draw()))
    raise AssertionError("unreachable")


async def _call_all(call: Callable, prompts: list[str], seeds: list[int], retry: Retry) -> list[tuple[Attempt, int]]:
    gate = asyncio.Semaphore(max(1, retry.concurrency))
    draw = random.Random(seeds[0] if seeds else 0).random
    pool = ThreadPoolExecutor(max(1, retry.concurrency))

    async def one(prompt: str, seed: int) -> tuple[Attempt, int]:
        async with gate:
            return await _called(call, prompt, seed, retry, pool, draw)

    try:
        return await asyncio.gather(*[one(p, s) for p, s in zip(prompts, seeds)])
    finally:
        pool.shutdown(wait=False)


def _usage(prompt: str | None, out: Attempt) -> tuple[int, int, str]:
    if out.usage:
        return *out.usage, "provider"
    return len((prompt or "").split()), len((out.text or "").split()) if out.ok else 0, "estimated"


def generate(df: DataFrame, call: Callable, prompt: str = "prompt", retry: Retry = Retry(), seed: int = 0, index: str | None = None) -> DataFrame:
    """``df`` with the columns of :data:`GENERATED`: ``call(prompt, seed + index)``, plain or async, for every
    row, ``retry.concurrency`` at a time in each partition. A row that fails for good carries its error and
    :data:`ERROR_TEXT`, and never fails the job. ``index`` numbers the rows of the whole table (without one,
    a hash of the prompt does), so that no two share a seed by their place in a batch."""
    df = df.drop(*StructType.fromDDL(GENERATED).names)
    number = F.pmod(F.xxhash64(prompt), F.lit(1 << 30)) if index is None else F.col(index)
    df = df.withColumn("_seed", number.cast("bigint") + seed)
    schema = StructType([f for f in df.schema.fields if f.name != "_seed"] + StructType.fromDDL(GENERATED).fields)
    added = [f.name for f in StructType.fromDDL(GENERATED).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = list(pdf[prompt])
            done = asyncio.run(_call_all(call, prompts, [int(x) for x in pdf["_seed"]], retry))
            rows = [(o.ok, o.text, o.error_type, o.error_message, *_usage(p, o), n) for p, (o, n) in zip(prompts, done)]
            yield pd.concat([pdf.drop(columns="_seed").reset_index(drop=True), pd.DataFrame(rows, columns=added)], axis=1)

    return df.mapInPandas(run, schema)


def generate_batches(df: DataFrame, load: Callable[[str], Callable[[list[str]], list]], model: str = "model_path", prompt: str = "prompt", batch: int = 32, parts: int = 0) -> DataFrame:
    """``df`` with the columns of :data:`GENERATED` from local models: ``load(path)`` gives a function from a
    list of prompts to texts (or :class:`Attempt`). Rows are spread by model and hash, so a model is loaded
    once a task and decodes batches of ``batch``; a batch that raises is decoded row by row, and a row that
    raises carries its error."""
    df = df.drop(*StructType.fromDDL(GENERATED).names)
    schema = StructType(df.schema.fields + StructType.fromDDL(GENERATED).fields)
    added = [f.name for f in StructType.fromDDL(GENERATED).fields]
    spread = [F.col(model), F.pmod(F.xxhash64(prompt), F.lit(64))]
    placed = (df.repartition(parts, *spread) if parts > 0 else df.repartition(*spread)).sortWithinPartitions(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, decode = None, None

        def attempts(prompts: list[str]) -> list[Attempt]:
            try:
                return [o if isinstance(o, Attempt) else Attempt(True, o) for o in decode(prompts)]
            except Exception as e:  # noqa: BLE001
                if len(prompts) == 1:
                    return [Attempt(False, ERROR_TEXT, type(e).__name__, str(e))]
                return [a for p in prompts for a in attempts([p])]

        for pdf in batches:
            for name, group in pdf.groupby(model, sort=False, dropna=False):
                if decode is None or name != path:
                    path, decode = name, load(name)
                prompts = list(group[prompt])
                out = [a for at in range(0, len(prompts), batch) for a in attempts(prompts[at : at + batch])]
                rows = [(o.ok, o.text, o.error_type, o.error_message, *_usage(p, o), 1) for p, o in zip(prompts, out)]
                yield pd.concat([group.reset_index(drop=True), pd.DataFrame(rows, columns=added)], axis=1)

    return placed.mapInPandas(run, schema)


def retry_failed(df: DataFrame, once: Callable[[DataFrame], DataFrame], ok: str, attempts: int = 2) -> DataFrame:
    """Run ``once`` over all rows, then again over those whose ``ok`` isn't true, up to ``attempts``."""
    keep = df.columns
    done, left = None, df
    for k in range(1, attempts + 1):
        out = cut_lineage(once(left.select(*keep)).withColumn("extraction_attempt_count", F.lit(k)))  # a call isn't repeated to be read twice
        part = out if k == attempts else out.where(F.coalesce(F.col(ok), F.lit(False)))
        done = part if done is None else done.unionByName(part)
        left = out.where(~F.coalesce(F.col(ok), F.lit(False)))
    return done


def score_batches(df: DataFrame, score: Callable[[list[dict]], list[tuple[float, bool]]], columns: list[str], chunk: int = 64) -> DataFrame:
    """``df`` with ``score, success, error``: rows are scored in chunks inside each partition; a chunk
    that raises is scored row by row, and a row that raises keeps its error and null results. A
    ``chunk`` of 0 or less takes each Arrow batch as one."""
    schema = StructType(df.schema.fields + StructType.fromDDL("score double, success boolean, error string").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf[columns].to_dict("records")
            out: list[tuple] = []
            size = chunk if chunk > 0 else max(1, len(rows))
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                try:
                    out += [(float(a), bool(b), None) for a, b in score(part)]
                except Exception:  # noqa: BLE001
                    for one in part:
                        try:
                            (a, b), = score([one])
                            out.append((float(a), bool(b), None))
                        except Exception as e:  # noqa: BLE001
                            out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["score", "success", "error"]).astype({"score": "float64", "success": "object"})], axis=1)

    return df.mapInPandas(run, schema)


def jobs(items: DataFrame, specs: list[dict]) -> DataFrame:
    """Every item once for every model of ``specs`` (``model_tag, model_step, model_path``): the specs are
    a literal array, so no join is needed."""
    if not specs:
        raise ValueError("no model given")
    spec = F.explode(F.array(*[F.struct(F.lit(x["model_tag"]).alias("model_tag"), F.lit(int(x["model_step"])).alias("model_step"), F.lit(x["model_path"]).alias("model_path")) for x in specs]))
    return items.withColumn("_m", spec).select(*items.columns, "_m.*")

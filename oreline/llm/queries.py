"""Queries of the training-data operators, over whole tables, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import charform, defects, leakage, mixing, overlap, pii, quotas, splits, truncation

SHARES = {"train_sft_raw": 0.7, "validation": 0.15, "test": 0.15}
#: Curriculum of ``p9_mixture``: almanacs rise and forum letters fall over the training.
TILT = {"almanacs": 0.8, "letters_forum": -0.8}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.straddling(table(spark, sf, "qa_examples"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with the split its group is assigned to."""
    return splits.assign_splits(table(spark, sf, "qa_examples"), SHARES)


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_shares(p1_splits(spark, sf), SHARES)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_generations(table(spark, sf, "api_generations"), table(spark, sf, "local_generations"), table(spark, sf, "qa_examples"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf, "api_generations"), table(spark, sf, "local_generations"), table(spark, sf, "qa_examples"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return charform.lookalike_quotes(table(spark, sf, "structured_outputs"), table(spark, sf, "qa_examples"))


def p4_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Every quote in its consistent form, and whether a reader would see it in the knowledge."""
    return charform.matched_quotes(table(spark, sf, "structured_outputs"), table(spark, sf, "qa_examples"))


def p4_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """The knowledge of every record in the form that its quotes are looked for in."""
    return charform.canonical_records(table(spark, sf, "structured_outputs"), table(spark, sf, "qa_examples"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return quotas.short_cells(table(spark, sf, "qa_examples"), table(spark, sf, "sample_targets"))


def p5_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return quotas.allocate(table(spark, sf, "qa_examples"), table(spark, sf, "sample_targets"))


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return quotas.draw(table(spark, sf, "qa_examples"), table(spark, sf, "sample_targets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlapping(table(spark, sf, "qa_examples")).select("rec_id_a", "rec_id_b")


def p6_by_source(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "qa_examples")
    return overlap.overlaps_by_source(records, overlap.overlapping(records))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.defects(table(spark, sf, "api_generations"), table(spark, sf, "structured_outputs"), table(spark, sf, "qa_examples"))


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return defects.defect_counts(p7_found(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.carried(table(spark, sf, "documents"), table(spark, sf, "eval_passages")).where("kind = 'carried'").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_passages")
    return leakage.leaked_items(leakage.carried(table(spark, sf, "documents"), items), items)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.unreachable(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), TILT)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.reached_shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), TILT)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_shares, p3_found, p3_rates, p4_found, p4_quotes, p4_knowledge, p5_found, p5_allocation, p5_sample,
        p6_found, p6_by_source, p7_found, p7_counts, p8_found, p8_items, p9_found, p9_mixture, p9_shares, p10_found, p10_redacted,
    )
}

_NAME = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), '[\s\p{{Z}}_\p{{Pd}}\p{{Cc}}]+', '-', 'g'), '^-+|-+$', '', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"
_CLEAN = "nullif(lower(trim({0}, chr(32) || chr(9) || chr(10) || chr(13))), '')"

# Cyrillic and Greek letters that read as Latin ones, and these, place by place; then dashes and quotation marks.
_FOREIGN = "аαсϲԁеһіιјкκӏпηоοрρԛѕυѵνԝωхχуγАΑВΒСϹЕΕНΗІΙЈКΚМΜΝОΟРΡЅТΤХΧУΥΖ"
_LATIN = "aaccdehiijkklnnooppqsuvvwwxxyyAABBCCEEHHIIJKKMMNOOPPSTTXXYYZ"
_MARKS, _PLAIN = "‐‑‒−⁃ʹʼ‘’‛“”‟ˮ", """-----'''''""\"\""""


def _form(x: str) -> str:
    """The consistent form in SQL, for text whose words are Latin (as the records' are)."""
    x = rf"regexp_replace({x}, '[\x{{ad}}\x{{34f}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{206f}}\x{{feff}}]', '', 'g')"
    x = f"translate({x}, '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "')"
    for one, two in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        x = f"replace({x}, '{one}', '{two}')"
    x = f"translate(nfc_normalize({x}), '{_MARKS}', '" + _PLAIN.replace("'", "''") + "')"
    return rf"translate(regexp_replace({x}, '[\s\p{{Z}}]', ' ', 'g'), '{_FOREIGN}', '{_LATIN}')"


SQL: dict[str, str] = {
    "p4_found": f"""
        WITH s AS (SELECT DISTINCT gen_id, rec_id, evidence FROM structured_outputs WHERE len(evidence) > 0),
        e AS (SELECT gen_id, rec_id, evidence, unnest(generate_series(1, len(evidence))) AS k FROM s),
        j AS (SELECT gen_id, (k - 1)::INT AS pos, evidence[k].quote AS q, knowledge AS t FROM e JOIN qa_examples USING (rec_id) WHERE evidence[k].quote IS NOT NULL AND knowledge IS NOT NULL AND NOT contains(knowledge, evidence[k].quote)),
        f AS (SELECT gen_id, pos, {_form('q')} AS q, {_form('t')} AS t FROM j)
        SELECT DISTINCT gen_id, pos FROM f WHERE trim(q) <> '' AND contains(t, q)""",
    "p1_found": f"""
        WITH RECURSIVE named AS (
            SELECT rec_id, coalesce(nullif({_NAME.format('source_id')}, ''), nullif({_NAME.format("split_part(id, ':', 1)")}, '')) AS own,
                   nullif({_NAME.format('metadata.raw_source_id')}, '') AS raw, {_CLEAN.format('data_split')} AS split
            FROM qa_examples),
        rec AS (SELECT rec_id, coalesce(own, raw, 'rec ' || rec_id) AS own, coalesce(raw, own, 'rec ' || rec_id) AS raw, split FROM named),
        edge AS (SELECT DISTINCT own AS a, raw AS b FROM rec WHERE own <> raw UNION SELECT DISTINCT raw, own FROM rec WHERE own <> raw),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
        label AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
        grouped AS (SELECT rec_id, split, coalesce(component, own) AS g FROM rec LEFT JOIN label ON own = a WHERE split IS NOT NULL),
        mixed AS (SELECT g FROM grouped GROUP BY g HAVING count(DISTINCT split) > 1)
        SELECT DISTINCT rec_id FROM grouped WHERE g IN (SELECT g FROM mixed)""",
    "p5_found": f"""
        WITH r AS (SELECT DISTINCT id, {_CLEAN.format('data_split')} AS s, {_CLEAN.format('answerability_label')} AS a, {_CLEAN.format('difficulty')} AS d FROM qa_examples),
        full_rows AS (SELECT * FROM r WHERE s IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL AND id IS NOT NULL),
        n AS (SELECT floor(count(DISTINCT id) / 4)::BIGINT AS n FROM full_rows)
        SELECT t.cell_id FROM sample_targets t CROSS JOIN n
        LEFT JOIN full_rows f ON f.s = lower(trim(t.data_split)) AND f.a = lower(trim(t.answerability_label)) AND f.d = lower(trim(t.difficulty))
        GROUP BY t.cell_id, t.min_rows, t.target_permille, n.n
        HAVING count(DISTINCT f.id) < greatest(t.min_rows, n.n * t.target_permille // 1000)""",
    "p5_allocation": f"""
        WITH RECURSIVE r AS (SELECT DISTINCT id, {_CLEAN.format('data_split')} AS s, {_CLEAN.format('answerability_label')} AS a, {_CLEAN.format('difficulty')} AS d FROM qa_examples),
        full_rows AS (SELECT * FROM r WHERE s IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL AND id IS NOT NULL),
        n AS (SELECT floor(count(DISTINCT id) / 4)::BIGINT AS n FROM full_rows),
        celled AS (SELECT f.id, t.cell_id FROM full_rows f JOIN sample_targets t ON f.s = lower(trim(t.data_split)) AND f.a = lower(trim(t.answerability_label)) AND f.d = lower(trim(t.difficulty))),
        own AS (SELECT cell_id, count(*) AS own FROM (SELECT id, min(cell_id) AS cell_id FROM celled GROUP BY 1) GROUP BY 1),
        cells AS (
            SELECT t.cell_id, t.target_permille, t.min_rows, (SELECT count(DISTINCT id) FROM celled c WHERE c.cell_id = t.cell_id) AS available, least(t.min_rows, coalesce(own, 0)) AS low, CASE WHEN t.target_permille > 0 THEN coalesce(own, 0) ELSE least(t.min_rows, coalesce(own, 0)) END AS high
            FROM sample_targets t LEFT JOIN own USING (cell_id)),
        level(i, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, (SELECT max(high / target_permille) FROM cells WHERE target_permille > 0)::DOUBLE
            UNION ALL SELECT i + 1, CASE WHEN s < n THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s < n THEN hi ELSE (lo + hi) / 2 END
            FROM (SELECT i, lo, hi, (SELECT sum(least(greatest((lo + hi) / 2 * target_permille, low), high)) FROM cells) AS s, (SELECT n FROM n) AS n FROM level WHERE i < 100)),
        shares AS (SELECT *, least(greatest((SELECT hi FROM level WHERE i = 100) * target_permille, low), high) AS share FROM cells),
        whole AS (SELECT *, greatest(low, floor(share + 1e-9))::BIGINT AS base FROM shares),
        placed AS (SELECT *, row_number() OVER (ORDER BY base >= high, CASE WHEN share > base + 1e-9 THEN base - share ELSE 0.0 END, cell_id) AS place FROM whole)
        SELECT cell_id, target_permille, min_rows, available, (base + (base < high AND place <= (SELECT n FROM n) - (SELECT sum(base) FROM whole))::INT)::BIGINT AS quota, greatest(min_rows, (SELECT n FROM n) * target_permille // 1000)::BIGINT AS needed,
               greatest(0, greatest(min_rows, (SELECT n FROM n) * target_permille // 1000) - available)::BIGINT AS shortfall FROM placed""",
    # by characters: no source is near the boundary, whatever the tokenizer
    "p9_found": """
        WITH size AS (SELECT trim(source) AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
        SELECT t.source FROM mix_targets t LEFT JOIN size s ON s.source = t.source
        WHERE coalesce(s.n, 0) * t.max_repeats < t.target_permille * (SELECT sum(n) FROM size) / 1000""",
}

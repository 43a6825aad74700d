"""Problem 2: deeply nested records as flat related tables, by Dewey labelling.

Every node below a record gets an ordinal path: per level the ordinal of the field in its struct
and, for array elements, the position from 0, as ``2.0/1.3`` (field 2, element 0, below it field 1,
element 3). The parent is the label cut at its last ``/``, and is derived from it; the root's label is the
empty string.
Nodes with the same schema path form one table. All of it is projection and generation; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_node(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.StructType))


def _label(parent: Column, ordinal: int, pos: Column | None = None) -> Column:
    step = F.lit(str(ordinal)) if pos is None else F.concat(F.lit(f"{ordinal}."), pos.cast("string"))
    return F.when(parent == "", step).otherwise(F.concat(parent, F.lit("/"), step))


def _size(array: Column) -> Column:
    return F.when(array.isNotNull(), F.size(array))


def parent_of(label: Column) -> Column:
    """The parent's label: everything before the last ``/`` (the root's label if there is none)."""
    return F.when(F.instr(label, "/") > 0, F.regexp_extract(label, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def shred(df: DataFrame, key: str, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables by schema path (``metadata.negative_strategy.replaced_supports``).

    Each holds ``key``, ``node`` (the Dewey label), ``parent``, ``pos`` (position in its array from 0;
    null for a struct that isn't an element), the scalar fields and, as ``n_<field>``, the length of
    each array field; nested structs have tables of their own. Arrays of scalars and of arrays hold ``value``. Field names that clash with
    ``key``, ``node``, ``parent`` or ``pos`` get a trailing underscore. Null structs and null or empty
    arrays have no row, null elements have a row of nulls, an empty input gives empty tables; other
    columns of ``df``, whatever their names, are not read.
    """
    out: dict[str, DataFrame] = {}
    reserved = {key, "node", "parent", "pos"}

    def emit(path: str, rows: DataFrame, kind: T.DataType) -> None:
        """rows: key, node, pos, v."""
        rows = rows.withColumn("parent", parent_of(F.col("node")))
        if isinstance(kind, T.StructType):
            scalars = [f for f in kind.fields if not _is_node(f.dataType)]
            arrays = [f for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
            out[path] = rows.select(
                key, "node", "parent", "pos",
                *(F.col("v").getField(f.name).alias(f.name + "_" if f.name in reserved else f.name) for f in scalars),
                *(_size(F.col("v").getField(f.name)).alias(f"n_{f.name}") for f in arrays),
            )
            for ordinal, field in enumerate(kind.fields):
                if _is_node(field.dataType):
                    below(f"{path}.{field.name}", rows.select(key, F.col("node").alias("up"), F.col("v").getField(field.name).alias("c")), ordinal, field.dataType)
        elif isinstance(kind, T.ArrayType):
            out[path] = rows.select(key, "node", "parent", "pos")
            below(f"{path}.value", rows.select(key, F.col("node").alias("up"), F.col("v").alias("c")), 0, kind)
        else:
            out[path] = rows.select(key, "node", "parent", "pos", F.col("v").alias("value"))

    def below(path: str, rows: DataFrame, ordinal: int, kind: T.DataType) -> None:
        """rows: key, up (the parent's label), c (the child itself)."""
        if isinstance(kind, T.ArrayType):
            each = rows.select(key, "up", F.posexplode("c").alias("pos", "v"))
            emit(path, each.select(key, _label(F.col("up"), ordinal, F.col("pos")).alias("node"), "pos", "v"), kind.elementType)
        else:
            some = rows.where("c is not null")
            emit(path, some.select(key, _label(F.col("up"), ordinal).alias("node"), F.lit(None).cast("int").alias("pos"), F.col("c").alias("v")), kind)

    fields = {f.name: (i, f.dataType) for i, f in enumerate(df.schema.fields)}
    for name in columns or [n for n, (_, k) in fields.items() if _is_node(k)]:
        ordinal, kind = fields[name]
        below(name, df.select(df[key].alias(key), F.lit("").alias("up"), df[name].alias("c")), ordinal, kind)
    return out


def unlabel(pos_table: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Inverse for one array: ``key, parent`` and the array ``items`` in its order."""
    return pos_table.groupBy(key, "parent").agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("x")).select(key, "parent", F.transform("x", lambda e: e[value]).alias("items"))


#: Link name and schema path of the three kinds of references to a context sentence.
LINKS = {
    "supporting": "supporting_sentences",
    "replaced": "metadata.negative_strategy.replaced_supports",
    "replacement": "metadata.negative_strategy.replacement_sentences",
}


def sentence_links(records: DataFrame) -> DataFrame:
    """Every reference with the context sentence it leads to, or null where it leads nowhere:
    ``rec_id, link, pos, node, title, sent_id, context_node, sentence_node``.

    ``context_node`` is the label of the first document of the same record with exactly that title
    and more than ``sent_id`` sentences, ``sentence_node`` that of the sentence below it. A null title, a null
    or a negative ``sent_id`` leads nowhere. Both sides are flat tables keyed by record, so a record is all
    that ever comes together."""
    tables = shred(records, "rec_id", ["supporting_sentences", "context_documents", "metadata"])
    refs = None
    for link, path in LINKS.items():
        t = tables[path].select("rec_id", F.lit(link).alias("link"), "pos", "node", "title", "sent_id")
        refs = t if refs is None else refs.unionByName(t)
    where = records.schema.names.index("context_documents")
    below = records.schema["context_documents"].dataType.elementType.names.index("sentences")
    document = _label(F.lit(""), where, F.col("at"))
    docs = tables["context_documents"].where("title is not null and n_sentences > 0").select("rec_id", F.col("title").alias("t"), F.col("n_sentences").alias("n"), F.col("pos").alias("at"))
    hit = (F.col("sent_id") >= 0) & (F.col("n") > F.col("sent_id"))
    joined = refs.alias("r").join(docs.alias("d"), (F.col("r.rec_id") == F.col("d.rec_id")) & (F.col("r.title") == F.col("d.t")), "left")
    return (
        joined.groupBy("r.rec_id", "r.link", "r.pos", "r.node", "r.title", "r.sent_id").agg(F.min(F.when(hit, F.col("at"))).alias("at"))
        .select("rec_id", "link", "pos", "node", "title", "sent_id", document.alias("context_node"), _label(document, below, F.col("sent_id")).alias("sentence_node"))
    )


def dead_links(records: DataFrame) -> DataFrame:
    """``rec_id, link, pos`` of every reference that leads nowhere."""
    return sentence_links(records).where("context_node is null").select("rec_id", "link", "pos").distinct()

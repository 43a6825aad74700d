"""Readers with explicit schemas: JSON lines, JSON documents, CSV, dataset folders, checkpoints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import fs


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, provenance: bool = False) -> DataFrame:
    """JSON lines under a superset schema (fields a row lacks are null); a bad line fails the job.
    ``provenance`` adds ``input_source_path``."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))
    return df.withColumn("input_source_path", F.input_file_name()) if provenance else df


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document, or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text, quotes doubled."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def load_split(spark: SparkSession, path: str, split: str, schema: StructType | str, list_only: bool = False) -> DataFrame:
    """Rows of a split: a folder partitioned by ``split`` (or plain parquet, the split ignored), JSON
    lines, or a JSON document that is a list, has the split or ``data`` as a list, or is one row."""
    if fs.is_folder(spark, path):
        have = fs.names(spark, path, folders=True)
        if f"split={split}" in have:
            return spark.read.parquet(fs.join(path, f"split={split}"))
        if any(d.startswith("split=") for d in have):
            raise ValueError(f"no split {split!r} in {path}")
        return spark.read.parquet(path)
    if path.lower().endswith(".json"):
        row = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        kind = F.schema_of_variant("v")
        array = lambda p: F.try_variant_get("v", p, "array<variant>")
        items = F.when(kind.startswith("ARRAY"), array("$"))
        if not list_only:
            items = F.coalesce(items, array(f"$.{split}"), array("$.data"), F.array("v"))
        rows = text.select(F.explode(items).alias("i")).where(F.schema_of_variant("i").startswith("OBJECT"))
        return rows.select(F.from_json(F.to_json("i"), row).alias("r")).select("r.*")
    return read_jsonl(spark, path, schema)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """``step, path`` sorted by step: the ``checkpoint-N`` folders below ``path``, or the lines of a list
    file (relative to it; a missing folder raises; the step is the folder's number or the line's)."""
    found = []
    if fs.is_folder(spark, path):
        for name in fs.names(spark, path, folders=True):
            if m := re.fullmatch(r"checkpoint-(\d+)", name):
                found.append((int(m[1]), fs.join(path, name)))
    else:
        for k, line in enumerate(fs.lines(spark, path)):
            full = fs.join(fs.parent(path), line)
            if not fs.is_folder(spark, full):
                raise FileNotFoundError(full)
            m = re.search(r"checkpoint-(\d+)", line)
            found.append((int(m[1]) if m else k, full))
    return spark.createDataFrame(sorted(found) or [], "step int, path string")


def model_specs(spark: SparkSession, base: str | None = None, adapters: str | None = None, adapter_list: str | None = None) -> DataFrame:
    """``model_tag, model_step, model_path`` of the base model and of a folder or list of adapters."""
    if adapters and adapter_list:
        raise ValueError("give a folder of adapters or a list, not both")
    rows = [("base", 0, base)] if base else []
    if adapters or adapter_list:
        rows += [(f"checkpoint-{r.step}", r.step, r.path) for r in checkpoints(spark, adapters or adapter_list).collect()]
    if not rows:
        raise ValueError("no model given")
    return spark.createDataFrame(rows, "model_tag string, model_step int, model_path string")


def with_position(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Rows numbered from 0 in file order: offsets per partition from counts, no single-task window."""
    pid, row = F.spark_partition_id(), F.monotonically_increasing_id()
    marked = df.withColumns({"_p": pid, "_m": row})
    counts = {r["_p"]: r["n"] for r in marked.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per input split
    start, table = 0, []
    for p in sorted(counts):
        table.append((p, start))
        start += counts[p]
    offsets = df.sparkSession.createDataFrame(table or [], "_p int, _start bigint")
    return marked.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_start")

"""Writers: JSON lines, CSV with a union header, partitioned and split folders, manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import opt_str
from ..session import cut_lineage


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(path: str, *tables: DataFrame, one_file: bool = False) -> None:
    """All rows under the union of the columns in order of appearance; missing values empty.
    ``one_file`` is for reports of a few rows."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    flat = [F.to_json(c).alias(c) if out.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in out.columns]
    out = out.select(*flat)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small metrics table as one indented JSON file; more than ``most`` rows are refused."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a JSON document")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows[0] if len(rows) == 1 else rows, f, indent=2, ensure_ascii=False, default=str)


def write_partitioned(df: DataFrame, path: str, by: str = "data_split") -> DataFrame:
    """One folder per value, rows without one dropped; returns the counts."""
    kept = df.where(opt_str(F.col(by)) != "")
    kept.write.mode("overwrite").partitionBy(by).option("ignoreNullFields", False).json(path)
    return partition_counts(df, by)


def partition_counts(df: DataFrame, by: str = "data_split") -> DataFrame:
    return df.where(opt_str(F.col(by)) != "").groupBy(opt_str(F.col(by)).alias(by)).agg(F.count("*").alias("n"))


def write_splits(df: DataFrame, path: str, split: str = "split", overwrite: bool = False) -> None:
    """A folder by split; an existing one is only replaced on request, and train and validation must
    have rows (an empty test split is left out)."""
    have = {r[0] for r in df.select(split).distinct().collect()}
    if missing := {"train", "validation"} - have:
        raise ValueError(f"empty splits: {sorted(missing)}")
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(split).parquet(path)


def write_both(df: DataFrame, csv: str | None = None, jsonl: str | None = None) -> None:
    """Both forms of one table, computed once."""
    if csv and jsonl:
        df = cut_lineage(df)
    if csv:
        write_csv(csv, df)
    if jsonl:
        write_jsonl(df, jsonl)


def manifest(path: str, **entries) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(entries, f, indent=2, ensure_ascii=False, default=str)

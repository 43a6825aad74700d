"""Folders and small text files on whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """Names in a folder (``folders``: of folders only), sorted."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not folders or s.isDirectory())


def join(path: str, name: str) -> str:
    return name if name.startswith("/") or "://" in name else f"{path.rstrip('/')}/{name}"


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or "."


def lines(spark: SparkSession, path: str, most: int = 1_000_000) -> list[str]:
    """Stripped non-empty lines of a list file in order; more than ``most`` bytes are refused."""
    fs, p = _at(spark, path)
    if fs.getFileStatus(p).getLen() > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    stream = fs.open(p)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()
    return [x.strip() for x in text.split("\n") if x.strip()]

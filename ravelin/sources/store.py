"""Stored tables: where operators keep what outlives one plan, and how an index is found again or rebuilt when it is stale."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def store_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of its own in the shared folder: what is made there runs once and survives lost executors."""
    path = f"{store_dir(df.sparkSession)}/ravelin-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _status(spark: SparkSession, path: str):
    """Status of a file or folder, None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def signature(spark: SparkSession, files: Iterable[str], config: dict) -> str:
    """SHA-256 of the configuration and of every file's path and time of change; a missing file counts as such."""
    lines = [f"{k}={config[k]}" for k in sorted(config)]
    for f in sorted(files):
        s = _status(spark, f)
        lines.append(f"{f}|{s.getModificationTime() if s else '-'}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def kept(spark: SparkSession, name: str, source: DataFrame, config: dict, build: Callable[[], dict[str, DataFrame]], rebuild: bool = True) -> dict[str, DataFrame]:
    """The tables of an index over source, built once for its files and configuration.

    An index under another signature is stale and never read. Without rebuild, a missing or stale
    index is an error. The table that is written last marks the index as whole.
    """
    folder = f"{store_dir(spark)}/{name}-{signature(spark, source.inputFiles(), config)}"
    tables = build()
    for part, df in tables.items():
        path = f"{folder}/{part}"
        if _status(spark, f"{path}/_SUCCESS") is None:
            if not rebuild:
                raise FileNotFoundError(f"no index of the present files at {folder}")
            df.write.mode("overwrite").parquet(path)
    return {part: spark.read.schema(df.schema).parquet(f"{folder}/{part}") for part, df in tables.items()}

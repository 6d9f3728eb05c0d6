"""Helpers shared by the training-data operators: input view, shared storage, Arrow limits."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word and white-space classes that all operators share (ASCII white space only).
SPACE = r"\x20\x09-\x0D"
WORD_SPLIT = f"[{SPACE}]+"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string), then the columns keep: null texts become empty, other columns are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: What this driver has written, for sweep().
_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/ravelin-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def sweep(spark: SparkSession) -> int:
    """Delete all tables and model files that this driver's operators have written, once their results have been consumed; how many there were."""
    n = 0
    while _written:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a stored() table that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more deleted now, not at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 32) -> None:
    """Arrow batches small enough for long texts in a worker of a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all lowest bytes first; leading bytes that are zero in all are left out."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    """The numbers of planes(), as signed ones."""
    width = raw[0]
    n = (len(raw) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, n).T
    return out.view("<u8").ravel().view(np.int64)

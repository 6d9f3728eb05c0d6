"""JSON documents in, JSON and Parquet out, and file selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.flags import flagged, together

CHUNKS = "source_file string, chunks array<struct<chunk_id:string,chunk_type:string,text:string,token_count:int,metadata:map<string,string>>>"
FAQ = "metadata struct<source:string>, entries array<struct<id:string,question:string,answer:string,source:string>>"
QUESTIONS = "questions array<struct<id:string,question:string,reference_answer:string,category:string,relevant_chunks:array<string>,expected_abstention:boolean>>"
LIST_KEYS = ("questions", "faqs", "items", "entries", "data")


def _exploded(spark: SparkSession, path, schema: str, field: str, *keep) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).select(*keep, F.posexplode(field).alias("pos", "x")).select(*keep, "pos", "x.*")


def load_chunks(spark: SparkSession, path) -> DataFrame:
    return _exploded(spark, path, CHUNKS, "chunks")


def load_faq(spark: SparkSession, path) -> DataFrame:
    read = spark.read.schema(FAQ).json(path, multiLine=True)
    rows = read.select(F.coalesce("metadata.source", F.lit("")).alias("faq_source"), F.posexplode("entries").alias("pos", "x")).where("x is not null")
    return rows.select("faq_source", "pos", *[F.coalesce(F.trim(f"x.{c}"), F.lit("")).alias(c) for c in ("id", "question", "answer", "source")])


def load_questions(spark: SparkSession, path) -> DataFrame:
    return _exploded(spark, path, QUESTIONS, "questions")


def faq_payload(text) -> object:
    """The entry list of a JSON text: the bare list, or the first of LIST_KEYS; an error otherwise."""
    v = F.try_parse_json(text)
    lists = [F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in LIST_KEYS]]
    return F.coalesce(*lists, F.raise_error(F.lit("no list of entries")).cast("array<variant>"))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "json", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)
    return path


def newest(spark: SparkSession, path: str, pattern: str = "*.json", name_contains: str = "") -> DataFrame:
    """(path, modified) of the newest file of each folder whose name holds a text, case aside."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"))
    named = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).contains(name_contains.lower()))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return named.withColumn("_n", F.row_number().over(Window.partitionBy(folder).orderBy(F.desc("modified"), "path"))).where("_n = 1").drop("_n")


# ---- files by folder and name ---------------------------------------------------------------------


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, folder, modified) of the files below a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string, name string, folder string, modified timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "modified")


def resolved(spark: SparkSession, wanted: str | None, roots: list[str], pattern: str = "*.json", by_name: bool = False) -> str:
    """The wanted file in the first root that has it; without one, the newest file of the first root that has any (by_name: the first by name)."""
    for root in roots:
        files = listing(spark, root, pattern if wanted is None else "*")
        if wanted is not None:
            files = files.where(F.col("path").endswith(f"/{wanted.lstrip('/')}"))
        found = files.orderBy(*(["name"] if by_name or wanted is not None else [F.desc("modified"), "name"])).first()
        if found:
            return found.path
    raise FileNotFoundError(f"no file {wanted or pattern} in {roots}")


def newest_of_sources(spark: SparkSession, root: str, document_id: str, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, flags): for each source type, a folder of the root, its newest JSON file that names the document; a source without one gives a flag."""
    files = listing(spark, root, "*.json").where(F.lower("name").contains(document_id.lower())).withColumn("source_type", F.element_at(F.split("folder", "/"), -1))
    best = files.withColumn("_n", F.row_number().over(Window.partitionBy("source_type").orderBy(F.desc("modified"), "path"))).where("_n = 1")
    every = spark.createDataFrame([(x,) for x in sources], "source_type string")
    found = every.join(best.select("source_type", "path", "modified"), "source_type", "left")
    return found.where("path is not null"), flagged(found.where("path is null"), "retrieval", "SOURCE_FILE_MISSING", "source_type")


def marked_file(files: DataFrame, markers: list[str], opposite: list[str]) -> DataFrame:
    """The file of listing() to take for a source: named by its markers first, then by none, never by the opposite ones; the newest of them."""
    has = lambda words: F.exists(F.lit(words), lambda w: F.lower(F.col("name")).contains(F.lower(w)))
    rank = F.when(has(markers), 0).when(~has(opposite), 1)
    return files.withColumn("_r", rank).where("_r is not null").orderBy("_r", F.desc("modified"), "path").limit(1).drop("_r")


def catalogue(spark: SparkSession, root: str, stages: tuple[str, ...] = ("raw", "chunks")) -> DataFrame:
    """(document_id, has_<stage>..., is_default): folders of documents below the root that have files of any stage; the first by name is the default."""
    inside = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = listing(spark, root).select(F.split(inside, "/").alias("p")).where(F.size("p") >= 3).select(F.get("p", F.lit(0)).alias("document_id"), F.get("p", F.lit(1)).alias("stage")).where(F.col("stage").isin(*stages))
    found = parts.groupBy("document_id").agg(*[F.coalesce(F.max(F.col("stage") == s), F.lit(False)).alias(f"has_{s}") for s in stages])
    return found.withColumn("is_default", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("document_id")) == 1)  # a row for each document of a catalogue


def persist(df: DataFrame, root: str, name: str, run: str, keep: int = 1, fmt: str = "json") -> str:
    """Write a run's result below root/name and remove all but the newest keep runs; run names sort by time."""
    spark = df.sparkSession
    path = save(df, f"{root}/{name}/{run}", fmt=fmt)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = sorted(s.getPath().getName() for s in fs.listStatus(base))
    for old in runs[: max(0, len(runs) - keep)]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{old}"), True)
    return path


def scanned_chunks(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, flags) of files(source_type, path): raw chunk records (source_type, pos, chunk_id, text), and what is wrong with files and records.

    A file that is no JSON, or has no list of chunks, gives no rows and one flag; a record that is no object one each.
    """
    paths = [r.path for r in files.select("path").collect()]  # a file for each source type
    if not paths:
        return spark.createDataFrame([], "source_type string, pos int, chunk_id string, text string"), flagged(files, "retrieval", "SOURCE_FILE_READ_ERROR", "source_type").limit(0)
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("_p"), "value")
    tail = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    read = files.join(raw.withColumn("_k", tail(F.col("_p"))), tail(F.col("path")) == F.col("_k"), "left").withColumn("v", F.try_parse_json("value"))
    listed = read.withColumn("chunks", F.try_variant_get("v", "$.chunks", "array<variant>"))
    each = listed.select("source_type", F.posexplode("chunks").alias("pos", "x"))
    is_object = F.schema_of_variant("x").startswith("OBJECT")
    field = lambda c: F.try_variant_get("x", f"$.{c}", "string")
    rows = each.where(is_object).select("source_type", "pos", field("chunk_id").alias("chunk_id"), field("text").alias("text"))
    flags = together(
        flagged(listed.where("v is null"), "retrieval", "SOURCE_FILE_READ_ERROR", "source_type", "path"),
        flagged(listed.where("v is not null and chunks is null"), "retrieval", "SOURCE_CHUNKS_INVALID", "source_type", "path"),
        flagged(each.where(~is_object | F.col("x").isNull()), "retrieval", "CHUNK_RECORD_INVALID", "source_type", "pos"),
    )
    return rows, flags


def empty_sources(files: DataFrame, accepted: DataFrame) -> DataFrame:
    """A flag for every source of files(source_type) without an accepted chunk."""
    return flagged(files.join(accepted.select("source_type").distinct(), "source_type", "left_anti"), "retrieval", "SOURCE_HAS_NO_VALID_CHUNKS", "source_type")

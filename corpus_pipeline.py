"""Corpus pipeline over documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import line_dedup, mixing, sentencepiece_codec, simhash, toxicity
from ravelin.llm.common import stored, table
from ravelin.llm.queries import piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's slot in the mixing schedule and its place in the slot's block; sorted by both, documents are in the order of the mix.
PLACE = ("mix_slot", "mix_place")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), chain).where(~F.col("is_toxic")).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of any length that stand on many sites; n_chars follows the text."""
    cleaned = line_dedup.apply(docs.select(*COLUMNS), min_words=1)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    gone = stored(simhash.near_duplicates(docs).select("doc_id"), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule, with their places in it: files are not read back in order.

    The target weights are the square roots of the numbers of rows.
    """
    return mixing.mix(docs.select(*COLUMNS)).orderBy("mix_slot", "mix_place").select(*COLUMNS, *PLACE)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and of the decoded text; the order of the mix is that of PLACE."""
    return sentencepiece_codec.apply(docs, piece_model(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=PLACE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: Classifiers, fingerprints and tokenisation are beyond SQL; a test compares run() with a version by hand on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

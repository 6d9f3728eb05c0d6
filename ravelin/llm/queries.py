"""The contract queries of this subpackage: opN_<name>(spark, sf_dir) and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_sentencepiece(spark, sf_dir):
    from ravelin.llm import sentencepiece_codec

    return sentencepiece_codec.apply(table(spark, sf_dir, "documents"), piece_model(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op10_simhash(spark, sf_dir):
    from ravelin.llm import simhash

    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_suffix_dedup(spark, sf_dir):
    from ravelin.llm import suffix_dedup

    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark, sf_dir):
    from ravelin.llm import line_dedup

    found = line_dedup.apply(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op6_mixing(spark, sf_dir):
    from ravelin.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


@query
def op7_quality(spark, sf_dir):
    from ravelin.llm import quality

    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op2_hamming_topk(spark, sf_dir):
    from ravelin.llm import hamming_topk as h

    rows = h.codes(table(spark, sf_dir, "embeddings"))
    return h.search(rows, rows.where(F.col("id") % h.QUERY_EVERY == 0)).withColumnRenamed("id", "vec_id")


@query
def op3_pii(spark, sf_dir):
    from ravelin.llm import pii

    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


@query
def op8_toxicity(spark, sf_dir):
    from ravelin.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *[f"p_{c}" for c in toxicity.CATEGORIES], "is_toxic")


@query
def op9_ngram_lm(spark, sf_dir):
    from ravelin.llm import ngram_lm

    model, numbers = ngram_lm.trained(ngram_lm.folded(table(spark, sf_dir, "documents")))
    return ngram_lm.scored(numbers, model)


@query
def op11_minhash(spark, sf_dir):
    from ravelin.llm import minhash

    return minhash.groups(table(spark, sf_dir, "documents"))


@query
def op12_spelling(spark, sf_dir):
    from ravelin.llm import spelling

    return spelling.group(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_fim(spark, sf_dir):
    from ravelin.llm import fim

    return fim.apply(table(spark, sf_dir, "documents"), ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


def _sql():
    from ravelin.llm import hamming_topk, line_dedup

    return {"op2_hamming_topk": hamming_topk.SQL, "op5_line_dedup": line_dedup.SQL}


SQL |= _sql()

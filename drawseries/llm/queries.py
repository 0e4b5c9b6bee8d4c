"""The dealt queries opN_<name>: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, embed_join, fingerprint, langid, mixing, ngram_join, quality, repeats, sharding, simple8b, toxicity,
               whitening)
from .common import documents, remainder, short_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            short_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return run
    return add


@query()
def op1_jump_shards(spark, sf_dir):
    out = sharding.shard_rows(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query(mixing.oracle())
def op2_poisson_mix(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"),
                      F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(chat.ORACLE)
def op9_perspectives(spark, sf_dir):
    return chat.perspectives(documents(spark, sf_dir, "conversations"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op7_simple8b_tokens(spark, sf_dir):
    encode = simple8b.library_encoder(tokenizer_path("word_bpe_49k.json"))
    path = simple8b.write_tokens(documents(spark, sf_dir), encode, end_id=2)
    back = simple8b.decode_tokens(simple8b.read_blocks(spark, path), as_u32=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op6_lz_fingerprint(spark, sf_dir):
    out = fingerprint.edited_fingerprints(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query()
def op4_centroid_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, remainder(F.col("doc_id")) != 0)
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "rejected")


@query()
def op5_noisy_or_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marks = documents(spark, sf_dir, "labels")
    model = toxicity.fit(docs, marks, lambda i: remainder(i) != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                      "score", "predicted", "worst_sentence", F.size("offending").alias("n_offending"))


@query()
def op10_pivot_range_join(spark, sf_dir):
    return embed_join.near_vectors(documents(spark, sf_dir, "embeddings"))


@query()
def op3_prefix_tree_join(spark, sf_dir):
    return ngram_join.near_duplicates(documents(spark, sf_dir))


@query()
def op11_recompression_runs(spark, sf_dir):
    found = repeats.find_runs(documents(spark, sf_dir).select("doc_id", "text"), key="doc_id", edited=True)
    return repeats.digests(found)


@query()
def op12_spectrum_whitening(spark, sf_dir):
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


@query(quality.oracle())
def op13_adaptive_quality(spark, sf_dir):
    out = quality.judged(documents(spark, sf_dir), "text", "lang", "source", "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")

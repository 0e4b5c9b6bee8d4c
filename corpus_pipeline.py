"""A corpus pipeline of five operators, each stage over all that its predecessor kept.

``run`` writes every stage's result as Parquet in the shared folder and reads it
back for the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawseries.llm import bpe, langid, mixing, ngram_join, toxicity
from drawseries.llm.common import documents, id_filter, remainder, staged
from drawseries.llm.queries import tokenizer_path

#: Word shingles and least similarity (per cent) of near copies.
SHINGLE, SIMILAR = 5, 80


def wrapped(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` columns beside the rest of the row as one struct, so that no extra column's name can clash."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*[docs[c] for c in own], F.struct(*[docs[c] for c in rest]).alias("rest_of_row"))


def unwrapped(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    return df.select(*[F.col(c) if c in own else F.col("rest_of_row")[c].alias(c) for c in columns])


KEY = ("doc_id", "text")
ROW = "row_of_stage"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose noisy-or score reaches the threshold."""
    marks = documents(spark, sf_dir, "labels")
    model = toxicity.fit(docs, marks, lambda i: remainder(i) != 0)
    return unwrapped(toxicity.score(wrapped(docs, *KEY), model).where("predicted = 0"), docs.columns, *KEY)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter or too far from every language's centroids."""
    model = langid.fit(docs, remainder(docs["doc_id"]) != 0)
    return unwrapped(langid.identify(wrapped(docs, *KEY), model).where("not rejected"), docs.columns, *KEY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of alike texts the row of the least id (no id before all).

    A row is known by a 64-bit hash of its id and text, so rows that share an id or
    have none are compared as rows of their own: unlike ones all stay.  Documents
    without words are in no group and all stay.
    """
    known = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    found = ngram_join.near_duplicates(known.select(ROW, "text"), SHINGLE, SIMILAR, key=ROW)
    found = staged(found.where("n_shingles > 0"), "near")
    # rows in groups of several: few, so the others need no shuffle
    by_row = found.groupBy(F.col(ROW).alias("t_row")).agg(F.count("*").alias("rows"), F.min("component_id").alias("c"))
    groups = by_row.groupBy("c").agg(F.sum("rows").alias("n")).where("n > 1").select("c")
    touched = staged(by_row.join(groups, "c"), "touched")
    maybe = id_filter(touched, "t_row")
    least = (known.select("doc_id", ROW).where(maybe(F.col(ROW))).join(touched, F.col(ROW) == F.col("t_row"))
             .groupBy("c").agg(F.min(F.struct("doc_id", ROW)).alias("least")))
    t = staged(touched.join(least, "c").select("t_row", "rows", (F.col("t_row") == F.col("least")[ROW]).alias("stays")), "stays")
    flagged = wrapped(docs, *KEY).withColumn(ROW, F.xxhash64("doc_id", "text"))
    flagged = flagged.withColumn("maybe", maybe(F.col(ROW)))
    asked = flagged.where("maybe").join(t, F.col(ROW) == F.col("t_row"), "left")
    own = [*KEY, "rest_of_row"]
    kept = flagged.where("not maybe").select(*own).unionByName(
        asked.where("t_row is null or (stays and rows = 1)").select(*own))
    # of repeated rows one, the same one whenever the stage is run again
    repeated = asked.where("stays and rows > 1").groupBy(ROW).agg(F.min(F.struct(*own)).alias("one"))
    kept = kept.unionByName(repeated.select("one.*"))
    return unwrapped(kept, docs.columns, *KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights; shuffles all."""
    own = (*KEY, "source")
    return unwrapped(mixing.mix(wrapped(docs, *own)), docs.columns, *own)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the checksum of what they decode to."""
    import public_tokenizers
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
                        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", tokenize),
]

#: Trained classifiers and the trie join have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Language identification by nearest centroid.

A text's vector holds its hashed byte bigrams and trigrams (lower case, anything
but letters as one space), weighted by (1 + ln tf) * idf and scaled to length 1.
Each language has several centroids, found by spherical k-means over a sample of
its labelled texts; a text takes the language of the centroid of greatest cosine.

Learning: document frequencies come from all labelled rows that may be learnt
from; centroids from at most about ``SAMPLE`` rows of each language, chosen by a
hash of the document's id.  Each language is fitted in a task of its own.

Rejection: a text is rejected if it is null or has no letter (language ``und``,
score 0), or if its cosine is under ``SLACK`` times the cosine that all but ``ODD``
of that language's sampled texts reach with their own centroid.

Defined cases: repeated rows get equal results; ties go to the first language in
alphabetical order; without any labelled row every text is ``und`` and rejected;
texts of any length are used whole; other columns pass through, and one named
like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import short_batches

DIMS = 4096
CLUSTERS = 4
SAMPLE = 400
SLACK = 0.5
#: Least share of a language's sample in a cluster; share of the sample that may lie under the cosine the floor is taken from.
LEAST, ODD = 0.03, 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")                      # as Spark's own pattern in fit
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    bits = np.uint32(32 - DIMS.bit_length() + 1)
    both = np.concatenate([(two + np.uint32(0x5BD1E995)) * np.uint32(2246822519), three * np.uint32(2654435761)])
    return np.bincount(both >> bits, minlength=DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, t in enumerate(texts):
        c = counts(t)
        at = np.nonzero(c)[0]
        v = (1 + np.log(c[at])) * idf[at]
        norm = np.sqrt((v * v).sum())
        out[i, at] = v / norm if norm else v
    return out


@dataclass
class Model:
    languages: list[str]          # of each centroid
    centroids: np.ndarray
    floors: np.ndarray            # least cosine that is not rejected, by centroid
    idf: np.ndarray


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts each dimension occurs, and how many texts there are (dimension -1)."""
    df, n = np.zeros(DIMS, dtype=np.int64), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            df += counts(t) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()),
                                          pa.array(np.concatenate([[n], df]), pa.int64())], names=["dim", "n"])


def k_means(x: np.ndarray, k: int, rounds: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, each row's cosine with its own, rows of each): spherical k-means.

    Seeds are rows at even steps of the cosine with the mean.  A cluster that holds under
    ``LEAST`` of the rows is seeded anew inside the largest one, and left out if it is
    still so small in the end: odd texts are no language's centroid.
    """
    order = np.argsort(x @ x.mean(0), kind="stable")
    k = max(1, min(k, len(x)))
    c = x[order[((2 * np.arange(k) + 1) * len(x)) // (2 * k)]].copy()
    small = LEAST * len(x)
    for turn in range(rounds):
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        size = np.bincount(own, minlength=len(c))
        for j in range(len(c)):
            if size[j] and size[j] >= small:
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
            elif turn < rounds // 2:                     # a row of the largest cluster that lies rather far out
                rows = np.nonzero(own == np.argmax(size))[0]
                rows = rows[np.argsort(cos[rows, np.argmax(size)], kind="stable")]
                c[j] = x[rows[len(rows) // 4]]
    for _ in range(2):
        size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        c = c[(size >= small) & (size > 0)]
    cos = x @ c.T
    return c, cos.max(1), np.bincount(np.argmax(cos, axis=1), minlength=len(c))


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", key: str = "doc_id",
        clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` where ``learn`` holds, lang is given and the text has a letter."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = (docs.where(learn).select(docs[text].alias("text"), docs[lang].alias("lang"), docs[key].alias("k"))
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    got = {r.dim: r.n for r in rows.select("text").mapInArrow(_document_counts, "dim int, n long")
           .groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + got.get(d, 0))) + 1 for d in range(DIMS)], dtype=np.float32)
    sizes = rows.groupBy("lang").count()
    share = (rows.select("text", "lang", (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
             .join(F.broadcast(sizes), "lang")         # one row a language
             .where(F.col("u") < F.lit(float(sample)) / F.col("count")))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        x = vectors(group["text"].tolist(), idf)
        c, cos, _ = k_means(x, clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "c": [v.astype(np.float32).tobytes() for v in c],
                             "least": float(np.quantile(cos, ODD))})

    fitted = sorted((r.lang, bytes(r.c), r.least) for r in
                    share.groupBy("lang").applyInPandas(centroids, "lang string, c binary, least double").collect())
    c = np.array([np.frombuffer(v, dtype=np.float32) for _, v, _ in fitted]).reshape(-1, DIMS)
    return Model([g for g, _, _ in fitted], c, np.array([SLACK * least for _, _, least in fitted]), idf)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (cosine) and rejected, from the text alone."""
    short_batches(docs.sparkSession)
    new = ("lang_pred", "score", "rejected")
    base = docs.select(*[docs[c] for c in docs.columns if c not in new])
    names = [*base.columns, *new]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            pred, score, gone = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for part in range(0, len(known), 256):
                rows = known[part:part + 256]
                cos = vectors([texts[i] for i in rows], model.idf) @ model.centroids.T
                best = np.argmax(cos, axis=1)
                for i, j, c in zip(rows, best.tolist(), cos[np.arange(len(rows)), best].tolist()):
                    pred[i], score[i], gone[i] = model.languages[j], min(1.0, max(0.0, c)), c < model.floors[j]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())],
                names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("lang_pred", StringType()),
                                            StructField("score", DoubleType()), StructField("rejected", BooleanType())]))

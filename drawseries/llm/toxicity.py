"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A sentence's score is a logistic function of its features (words of up to 24
letters and the first 4 and 5 letters of words); a document's is the noisy-or of
its sentences, 1 - prod(1 - p).  Weights are trained from document labels alone,
so the sentences that make a document toxic are found without being labelled.

A noisy-or rises with length, so weights are trained on long clean bags too: for
each sampled clean text one bag of ``LONG`` sentences, joined from sampled clean
texts, and one of as many sentences without features.  A clean bag's loss is the
sum of its sentences' losses, so the bags are counted as weights of the texts in
them and no sentence is copied.

Learning: from at most about ``SAMPLE`` rows of label 1 and ``CLEAN`` times as many
of label 0, chosen by a hash of the document's id, one of each text; the ``FEATURES`` features that differ most
between labels are kept.  Only their places in the sampled texts reach the driver.
All texts are scored, whole.

Defined cases: null and empty texts, or texts without a word, are one sentence
without features; repeated rows get equal scores; without rows of both labels all
scores are 0; other columns pass through, and one named like an output column is
replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import short_batches, staged

SAMPLE = 3000
CLEAN = 4
FEATURES = 300
LEAST_DOCS = 5
LONG = 1000
#: Weight of a toxic text against a clean one without bags; the bags weigh far more than that.
POSITIVE = 20.0
THRESHOLD = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Features of a lower-case word; prefixes end in ``*``."""
    out = [word] if len(word) <= 24 else []
    if len(word) >= 4:
        out.append(word[:4] + "*")
    if len(word) >= 5:
        out.append(word[:5] + "*")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        # the first letters of words that can have a feature at all
        self.heads = {f[:4].rstrip("*") if len(f) < 5 else f[:4] for f in self.weights}

    def sentence(self, words: list[str]) -> float:
        seen = {f for w in words if w[:4] in self.heads for f in features(w)}
        return self.bias + math.fsum(self.weights.get(f, 0.0) for f in seen)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        """(document score, (start, end, score) of its offending sentences, the worst's place or -1)."""
        if not self.weights:
            return 0.0, [], -1
        text = text or ""
        base = softplus(self.bias)
        low = text.lower()
        if len(low) != len(text):                      # some letters grow in lower case: keep places right
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        heads = self.heads
        found = [m for m in _WORD.finditer(low) if m.group()[:4] in heads]
        spans = [m.span() for m in _SENTENCE.finditer(low)] or [(0, 0)]
        total, bad, worst, most = 0.0, [], -1, -math.inf
        if not found:
            worded = sum(1 for a, b in spans if _WORD.search(low, a, b)) or 1
            return 1 - math.exp(-base * worded), [], -1
        k, worded = 0, 0
        for i, (a, b) in enumerate(spans):
            words = []
            while k < len(found) and found[k].start() < b:
                words.append(found[k].group())
                k += 1
            if words:
                z = self.sentence(words)
                total += softplus(z)
                if z > most:
                    most, worst = z, i
                if z >= 0:
                    bad.append((a, b, 1 / (1 + math.exp(-z))))
            elif _WORD.search(low, a, b) is None:
                continue
            else:
                total += base
            worded += 1
        return 1 - math.exp(-total), bad, worst


def softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def _sentences(text: str) -> list[set[str]]:
    got = [set(_WORD.findall(s)) for s in _SENTENCE.findall(text.lower())]
    got = [{f for w in s for f in features(w)} for s in got if s]
    return got or [set()]


def _doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = sorted(set().union(*_sentences(t)))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([y] * len(seen), pa.int32())],
                                             names=["f", "y"])


def _placed(vocabulary: list[str]):
    place = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [[place[f] for f in s if f in place] for s in _sentences(t)]
                rows.append((y, sum(not s for s in found), [sorted(s) for s in found if s]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], names=["y", "plain", "found"])
    return run


def train(y: np.ndarray, plain: np.ndarray, found: list[list[list[int]]], n: int, rounds: int = 400,
          rate: float = 0.1, l2: float = 3e-5, long: int = LONG) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam, falling rate) on the noisy-or likelihood of the documents
    and of clean bags of ``long`` sentences (for each clean document one joined and one without features)."""
    doc = np.array([d for d, ss in enumerate(found) for _ in ss], dtype=np.int64)
    sent = np.array([i for i, s in enumerate([s for ss in found for s in ss]) for _ in s], dtype=np.int64)
    feat = np.array([f for ss in found for s in ss for f in s], dtype=np.int64)
    size = plain + np.array([len(ss) for ss in found])
    bags = long / max(1.0, float(size[y == 0].mean())) if (y == 0).any() else 0.0   # bags that a clean document is in
    w = np.zeros(n + 1)
    w[n] = -math.log(max(long, 55))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    weight = np.where(y == 1, POSITIVE, 1.0 + bags) / max(1, len(y))
    bare = long * float((y == 0).sum()) / max(1, len(y))       # sentences of the bags without features, a document
    for t in range(1, rounds + 1):
        z = w[n] + np.bincount(sent, w[feat], minlength=len(doc))
        s = np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, w[n])
        slope = weight * np.where(y == 1, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        per = slope[doc] / (1 + np.exp(-z))
        grad = np.zeros(n + 1)
        grad[:n] = np.bincount(feat, per[sent], minlength=n) + l2 * w[:n]
        grad[n] = per.sum() + ((slope * plain).sum() + bare) / (1 + np.exp(-w[n]))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * min(1.0, 2 * (1 - t / rounds) + 0.02) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column] | None = None, text: str = "text",
        label: str = "toxic", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the texts whose id has a 0/1 label (other labels are left out) and satisfies ``learn``.

    Rows are sampled among the labels, which are light; the sample's ids are bounded,
    so they are broadcast to the texts and no text is shuffled.
    """
    spark = docs.sparkSession
    short_batches(spark)
    marks = (labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).where("y in (0, 1)")
             .groupBy("k").agg(F.max("y").alias("y")))
    if learn is not None:
        marks = marks.where(learn(F.col("k")))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, 0.0)
    u = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(CLEAN * sample / sizes[0]))
    ids = staged(marks.where(u < share), "toxic-sample")
    rows = docs.select(docs[key].alias("d"), F.coalesce(docs[text], F.lit("")).alias("text")).join(
        F.broadcast(ids), F.col("d") == F.col("k"))
    chosen = staged(rows.groupBy("text").agg(F.max("y").alias("y")), "toxic-texts")
    n = {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    stats = (chosen.mapInArrow(_doc_features, "f string, y int").groupBy("f")
             .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
             .where(F.col("pos") + F.col("neg") >= LEAST_DOCS))
    odds = F.log((F.col("pos") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (n.get(0, 0) + 1))
    top = stats.withColumn("s", F.abs(odds) * F.sqrt(F.col("pos") + F.col("neg"))).orderBy(F.desc("s"), "f")
    vocabulary = sorted(r.f for r in top.limit(FEATURES).collect())
    got = chosen.mapInArrow(_placed(vocabulary), "y int, plain int, found array<array<int>>").collect()
    w, bias = train(np.array([r.y for r in got]), np.array([r.plain for r in got], dtype=float),
                    [r.found for r in got], len(vocabulary))
    return Model({f: float(x) for f, x in zip(vocabulary, w) if abs(x) > 1e-4}, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted, worst_sentence and offending ((start, end, score) of sentences, code points)."""
    short_batches(docs.sparkSession)
    new = ("score", "predicted", "worst_sentence", "offending")
    base = docs.select(*[docs[c] for c in docs.columns if c not in new])
    names = [*base.columns, *new]
    at = names.index(text)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.float64()),
                 pa.array([int(g[0] >= THRESHOLD) for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()),
                 pa.array([[{"start": a, "end": e, "score": p} for a, e, p in g[1]] for g in got], pa.list_(span))],
                names=names)

    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                                  StructField("score", DoubleType())]))
    return base.mapInArrow(run, StructType([
        *base.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType()),
        StructField("worst_sentence", IntegerType()), StructField("offending", spans)]))

import math

import numpy as np
from pyspark.sql import functions as F

from drawseries.llm.queries import QUERIES
from drawseries.llm.toxicity import Model, features, fit, score, softplus, train

from ..conftest import SF_MID
from .conftest import ODD


def brute(model, text):
    """Noisy-or of the sentences by its definition."""
    import re
    keep, probs = 1.0, []
    for s in re.findall(r"[^.!?\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", s)
        if words:
            seen = {f for w in words for f in features(w)}
            probs.append(1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0) for f in seen)))))
    for p in probs or [1 / (1 + math.exp(-model.bias))]:
        keep *= 1 - p
    return 1 - keep, sum(p >= 0.5 for p in probs)


def test_gradient_descends_to_the_bad_feature():
    # feature 0 marks toxic documents, feature 1 is in all, feature 2 in clean ones
    y = np.array([1, 0] * 40)
    found = [[[0, 1], [1]] if t else [[1, 2]] for t in y]
    w, bias = train(y, np.full(80, 3.0), found, 3)
    assert w[0] > 3 and w[0] > w[1] and w[2] < -1 and bias < -2


def test_scores_match_brute_force_and_locate(docs_of):
    model = Model({"idiot": 9.0, "lowe*": 8.0, "fine": -2.0}, -5.0)
    rows = ODD + [(50, "All is well. You IDIOT! Fine, lowenzahn fine.\n..  \nLast"), (51, "İ. idiot fine")]
    docs = docs_of(rows).withColumn("offending", F.lit(1))
    for r in score(docs, model).collect():
        want, bad = brute(model, r.text)
        assert abs(r.score - want) < 1e-9 and len(r.offending) == bad and r.predicted == int(want >= 0.5)
        if r.doc_id == 50:
            assert [r.text[s.start:s.end].strip() for s in r.offending] == ["You IDIOT", "Fine, lowenzahn fine"]
            assert r.worst_sentence == 1
    assert score(docs_of([]), model).count() == 0


def test_learns_from_documents_and_finds_sentences(spark, docs_of):
    rng = np.random.default_rng(5)
    words = [f"w{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(200)]
    rows, marks = [], []
    for i in range(1600):
        sents = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 4 == 0:
            sents[i % 6] += " scum"
        rows.append((i, ". ".join(sents)))
        marks.append((i, "x", int(i % 4 == 0)))
    texts = docs_of(rows).join(spark.createDataFrame(marks, "doc_id long, source string, toxic int").select("doc_id", "toxic"), "doc_id")
    model = fit(texts, texts)
    got = score(texts, model).collect()
    assert all(r.predicted == r.toxic for r in got)
    placed = [r.worst_sentence == r.doc_id % 6 for r in got if r.toxic]
    assert sum(placed) >= 0.95 * len(placed)
    assert fit(texts, texts.where("toxic = 1")).weights == {}
    assert softplus(0) == math.log(2)


def test_long_clean_texts_stay_clean(spark, docs_of):
    rng = np.random.default_rng(6)
    words = [f"w{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(200)]

    def sentences(n):
        return [" ".join(s) for s in rng.choice(words, (n, 8))]
    rows, marks = [], []
    for i in range(1600):
        sents = sentences(6)
        if i % 8 == 0:
            sents[i % 6] += " scum"
        rows.append((i, ". ".join(sents)))
        marks.append((i, int(i % 8 == 0)))
    model = fit(docs_of(rows), spark.createDataFrame(marks, "doc_id long, toxic int"))
    for n in (2000, 6000, 10000):
        for k in range(3):
            sents = sentences(n)
            got, bad, _ = model.score(". ".join(sents))
            assert got < 0.5 and not bad, (n, got)
            sents[n // 2] += " scum"
            got, bad, worst = model.score(". ".join(sents))
            assert got >= 0.5 and len(bad) == 1 and worst == n // 2
    plain = model.score(". ".join(["zzz zzz"] * 10000))
    assert plain[0] < 0.5


def test_query_held_out(spark):
    got = QUERIES["op5_noisy_or_toxicity"](spark, SF_MID)
    assert got.count() == 1000
    marks = spark.read.parquet(f"{SF_MID}/labels.parquet")
    n = {(r.toxic, r.predicted): r.n for r in got.where("held_out").join(marks, "doc_id").groupBy("toxic", "predicted")
         .agg(F.count("*").alias("n")).collect()}
    assert n.get((1, 1), 0) >= 0.6 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.05 * (n.get((0, 1), 0) + n.get((0, 0), 0))

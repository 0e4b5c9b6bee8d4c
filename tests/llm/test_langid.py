import numpy as np
from pyspark.sql import functions as F

from drawseries.llm.common import remainder
from drawseries.llm.langid import Model, counts, fit, has_letter, identify, k_means, vectors
from drawseries.llm.queries import QUERIES

from ..conftest import SF_MID
from .conftest import ODD


def test_k_means_separates_groups():
    rng = np.random.default_rng(1)
    centres = np.eye(4)
    x = np.concatenate([c + 0.05 * rng.standard_normal((50, 4)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, cos, _ = k_means(x, 4)
    assert len({int(np.argmax(v)) for v in c}) == 4 and cos.min() > 0.9


def test_vector_is_normalised_tf_idf():
    c = counts("Ab ab!")
    assert c.sum() == 6 + 5                           # " ab ab " has 6 pairs and 5 triples
    v = vectors(["Ab ab!", ""], np.ones(len(c), np.float32))
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6
    want = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0)
    assert np.allclose(v[0], want / np.linalg.norm(want), atol=1e-6)


def test_nearest_centroid_against_brute_force(spark, docs_of):
    rows = [(i, " ".join((["the", "and", "of", "with"] if i % 2 else ["der", "und", "das", "nicht"])[j % 4] for j in range(i % 9 + 1)),
             "en" if i % 2 else "de", "s") for i in range(120)]
    model = fit(docs_of(rows), remainder(F.col("doc_id")) != 0)
    assert set(model.languages) == {"en", "de"}
    odd = docs_of(ODD).withColumn("score", F.lit("clash")).withColumn("rejected", F.lit(1))
    for r in identify(odd, model).collect():
        if r.text is None or not any(ch.isalpha() for ch in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            cos = vectors([r.text], model.idf) @ model.centroids.T
            j = int(np.argmax(cos))
            assert r.lang_pred == model.languages[j] and abs(r.score - max(0, cos[0, j])) < 1e-5
            assert r.rejected == bool(cos[0, j] < model.floors[j])
    assert all(r.lang_pred == r.lang and not r.rejected for r in identify(docs_of(rows), model).collect())


def test_nothing_to_learn_and_empty(docs_of):
    model = fit(docs_of([(1, "a")]), F.lit(True))
    assert isinstance(model, Model) and model.languages == []
    assert identify(docs_of([(1, "abc")]), model).first().lang_pred == "und"
    assert identify(docs_of([]), model).count() == 0


def test_query_held_out_accuracy(spark):
    got = QUERIES["op4_centroid_language"](spark, SF_MID)
    both = got.join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = both.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert got.count() == 1000 and r.n > 150 and r.acc > 0.95
    assert got.where("rejected and lang_pred <> 'und'").count() <= 3


def test_odd_texts_are_no_centroids():
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:3]
    x = np.concatenate([c + 0.05 * rng.standard_normal((130, 8)) for c in centres] + [np.eye(8)[5:8] + 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in (3, 4, 6):
        c, cos, size = k_means(x, k)
        assert len(c) >= 3 and size.min() >= 0.03 * len(x) and size.sum() == len(x)
        assert {int(np.argmax(v)) for v in c} == {0, 1, 2}
    assert k_means(x[:1], 4)[2].tolist() == [1]


def test_one_meaning_of_letter():
    for t, want in (("½", False), ("²", False), ("①", False), ("Ⅷ", False), ("_1", False), ("é", True), ("試", True), ("ª", True), (None, False)):
        assert has_letter(t) is want


def test_clusters_hold_a_real_share_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").where(remainder(F.col("doc_id")) != 0)
    for lang in ("en", "de"):
        texts = [r.text for r in docs.where(F.col("lang") == lang).select("text").limit(200).collect()]
        c, _, size = k_means(vectors(texts, np.ones(4096, np.float32)), 4)
        assert len(c) >= 2 and size.min() >= 0.03 * len(texts)

import hashlib

import corpus_pipeline as cp
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from drawseries.llm import toxicity
from drawseries.llm.bpe import read_ranks
from drawseries.llm.common import id_filter, short_batches

from ..conftest import SF_SMALL
from .conftest import ODD
from .test_mixing import POWER, SEED, inverse, u_of
from .test_ngram_join import brute, corpus


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output on the small tables, as (columns, rows)."""
    short_batches(spark)
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        got = stage(spark, docs, SF_SMALL)
        out[name] = (docs.collect(), got.collect(), got.columns)
        docs = spark.createDataFrame(out[name][1], got.schema)
    return out


def test_columns_and_order(spark, stages):
    cols = spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "near_copies", "mix", "bpe"]
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == cols


def test_toxic_go_and_clean_stay(spark, stages):
    before, after, _ = stages["toxicity"]
    kept = {r.doc_id for r in after}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    gone = [r.doc_id for r in before if r.doc_id not in kept]
    assert set(after) <= set(before) and gone
    clean = [d for d, y in marks.items() if y == 0]
    assert sum(d not in kept for d in clean) <= 0.03 * len(clean)


def test_language_keeps_clean(stages):
    before, after, _ = stages["language"]
    kept = {r.doc_id for r in after}
    assert sum(r.doc_id not in kept for r in before if r.text and len(r.text) > 50) <= 0.01 * len(before)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_copies"]
    want = sorted(d for d, n, c in brute([(r.doc_id, r.text) for r in before], cp.SHINGLE, cp.SIMILAR) if d == c or n == 0)
    assert sorted(r.doc_id for r in after) == want


def test_mix_counts(stages):
    before, after, _ = stages["mix"]
    size = {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode()) + 1
    w = {s: b ** POWER for s, b in size.items()}
    want = sorted(r.doc_id for r in before for _ in range(inverse(
        w[r.source] / sum(w.values()) * sum(size.values()) / size[r.source], u_of(SEED, r.doc_id))))
    assert sorted(r.doc_id for r in after) == want


def test_tokens(stages):
    before, after, _ = stages["bpe"]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text or "" for r in before}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    for r in after:
        ids = lib.encode_ordinary(text[r.doc_id])
        assert (r.ids, r.n_tokens) == (" ".join(map(str, ids)), len(ids))
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_near_copies_with_odd_and_repeated_rows(spark, docs_of):
    rows = corpus(3, groups=8) + [(9000 + (i or 0), t) for i, t in ODD if i is not None] + [(9100, "same row twice over and over")] * 3
    got = [r.doc_id for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()]
    found = brute(rows, cp.SHINGLE, cp.SIMILAR)
    assert sorted(set(got)) == sorted({d for d, n, c in found if d == c or n == 0})
    worded = [d for d, n, _ in found if n]
    assert all(got.count(d) == 1 for d in got if d in worded)


def test_unlike_rows_that_share_an_id_or_have_none_stay(spark, docs_of):
    base = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(12)]
    near = base[9] + " tail"
    rows = [(None, base[0]), (None, base[1]), (None, base[1]), (None, base[2]), (7, base[3]), (7, base[4]), (7, base[4]),
            (8, base[4]), (9, base[2]), (None, ""), (None, None), (5, base[9]), (5, base[10]), (6, near), (3, base[10]), (4, base[11])]
    got = sorted([(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs_of(rows), "").collect()], key=str)
    want = [(None, base[0]), (None, base[1]), (None, base[2]), (None, ""), (None, None), (7, base[3]), (7, base[4]),
            (5, base[9]), (3, base[10]), (4, base[11])]
    assert got == sorted(want, key=str)


def test_stages_take_empty_tables_and_odd_rows(spark, docs_of):
    clash = {c: F.lit("own") for c in ("score", "predicted", "rejected", "gone", "maybe", "mix_copy", "rest_of_row", "rows")}
    for docs in (docs_of([]), docs_of(ODD).withColumns(clash)):
        for name, stage in cp.STAGES:
            got = stage(spark, docs, SF_SMALL)
            got.collect()
            if name != "bpe":
                assert got.columns == docs.columns
                assert all(r.score == "own" and r.mix_copy == "own" for r in got.collect() if "score" in docs.columns)


def test_fit_without_labels(docs_of):
    docs = docs_of([(1, "abc")]).withColumn("toxic", F.lit(None).cast("int"))
    assert toxicity.fit(docs, docs).weights == {}


def test_id_filter_never_drops_members(spark):
    ids = spark.range(0, 3000, 3)
    maybe = id_filter(ids, "id")
    kept = {r.id for r in spark.range(3000).where(maybe(F.col("id"))).collect()}
    assert {*range(0, 3000, 3)} <= kept and len(kept) < 1100

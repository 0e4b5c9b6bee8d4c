import base64
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawseries.llm.bpe import Encoder, decode, encode, encode_decode, read_ranks

from ..conftest import SF_SMALL
from .conftest import ODD

PATH = P.path("byte_bpe_50k.tiktoken")


class Listed(Encoder):
    def encode(self, text):
        return list(array("i", super().encode(text)))


@pytest.fixture(scope="module")
def pair():
    ranks = read_ranks(PATH)
    return Listed(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces_match_library(pair):
    enc, lib = pair
    rng = random.Random(3)
    words = [lib.decode([rng.randrange(50000)]) for _ in range(3000)]
    for n in range(1, 9):
        for _ in range(400):
            t = "".join(rng.choice(words) for _ in range(n)).replace("�", "é")
            assert enc.encode(t) == lib.encode_ordinary(t), t
    for _ in range(1500):
        t = "".join(rng.choice("aeinorstlh") for _ in range(rng.randrange(1, 60)))
        assert enc.encode(t) == lib.encode_ordinary(t), t


@settings(max_examples=400, deadline=None)
@given(t=st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t \x1c'sle.,ab1é試🙂")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_matches_library(pair, t):
    enc, lib = pair
    assert enc.encode(t) == lib.encode_ordinary(t)


def test_other_patterns_are_not_cut_at_spaces(pair):
    ranks = pair[0].ids
    pattern = r"[a-z ]+|[^a-z ]+"
    raw = {k.encode("latin-1"): v for k, v in ranks.items()}
    enc = Listed(raw, pattern)
    lib = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=raw, special_tokens={})
    assert not enc.shortcuts and pair[0].shortcuts
    for t in ("two words here, Yes", "a. b c\nd", " lead", "word."):
        assert enc.encode(t) == lib.encode_ordinary(t)


def test_both_ways_in_one_pass(docs_of, pair):
    docs = docs_of(ODD).withColumn("ids", F.lit("clash"))
    out = encode_decode(docs, PATH, P.PATTERN)
    assert "text" not in out.columns
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out.collect()), key=str)
    assert got == sorted(((i, pair[1].encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD), key=str)
    assert encode_decode(docs_of([]), PATH, P.PATTERN).count() == 0


def test_long_pieces_stay_linear(pair):
    enc, lib = pair
    for t in ("a" * 30000, "ab" * 9000, "qxzj" * 5000, "é" * 8000):
        assert enc.encode(t) == lib.encode_ordinary(t)


def test_table_round_trip(spark, docs_of, pair):
    lib = pair[1]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        docs_of(ODD).select("doc_id", "text")).withColumn("decoded", F.lit(1))
    got = decode(encode(docs, PATH, P.PATTERN), PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    for r in got.collect():
        assert r.ids == lib.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode(docs_of([]), PATH, P.PATTERN).count() == 0


def test_decoding_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "i int, ids array<int>")
    assert {r.i: bytes(r.decoded) for r in decode(df, PATH).collect()} == {1: b'!"', 2: b"", 3: b""}
    with pytest.raises(Exception, match="out of bounds|vocabulary"):
        decode(spark.createDataFrame([([60000],)], "ids array<int>"), PATH).collect()


def test_ranks_file():
    ranks = read_ranks(PATH)
    assert len(ranks) == 50256 and ranks[base64.b64decode("IQ==")] == 0

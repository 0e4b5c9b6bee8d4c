import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawseries.llm import simple8b
from drawseries.llm.queries import QUERIES
from drawseries.llm.simple8b import FRAME, pack, unpack

from ..conftest import SF_SMALL
from .conftest import ODD

PATH = P.path("word_bpe_49k.json")


def back(ids):
    words, frames, raw = pack(np.array(ids, dtype=np.uint64))
    return unpack(words, frames, raw, len(ids)).tolist(), len(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2 ** 64 - 1)), max_size=300))
def test_round_trip(ids):
    assert back(ids)[0] == ids


@pytest.mark.parametrize("n", [0, 1, FRAME - 1, FRAME, FRAME + 1, 5 * FRAME + 7])
def test_frames_and_density(n):
    rng = np.random.default_rng(n)
    for top, most in ((2, 60), (2 ** 15, 4), (2 ** 60, 1)):
        ids = rng.integers(0, top, n).tolist()
        got, words = back(ids)
        assert got == ids
        assert words <= -(-n // most) + n // FRAME + 1
    frames = pack(rng.integers(0, 2 ** 15, n).astype(np.uint64))[1]
    assert len(frames) == -(-n // FRAME)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def check(got, rows, tok):
    """Rows (doc_id, start, n_tokens, crc) against whole texts encoded by the library."""
    start = 0
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want = [np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts[r.doc_id]]
        assert r.ids_crc32 in [zlib.crc32(w) for w in want] and r.n_tokens in [len(w) // 4 for w in want]


def test_file_reads_back(spark, docs_of, tok):
    rows = ODD + [(100 + i, f"Words {i} don't STOP, ǰ J̌ Σας <|endoftext|> a b") for i in range(60)]
    docs = docs_of(rows).withColumn("block", F.lit(3)).withColumn("k", F.lit("c")).withColumn("h", F.lit(1))
    path = simple8b.write_tokens(docs, simple8b.library_encoder(PATH), end_id=2)
    got = simple8b.decode_tokens(simple8b.read_blocks(spark, path), as_u32=True)
    check(got.withColumn("ids_crc32", F.crc32("ids")).collect(), rows, tok)
    one = simple8b.decode_tokens(simple8b.read_blocks(spark, path)).where("doc_id = 3").first()
    assert one.ids == tok.encode("word", add_special_tokens=False).ids + [2]


def test_query_over_the_table(spark, tok):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op7_simple8b_tokens"](spark, SF_SMALL).collect(), rows, tok)


def test_empty(spark, docs_of):
    path = simple8b.write_tokens(docs_of([]), simple8b.library_encoder(PATH), end_id=2)
    assert simple8b.decode_tokens(simple8b.read_blocks(spark, path)).count() == 0


def test_shortcuts_equal_the_library_for_every_character(tok):
    encode = simple8b.library_encoder(PATH)()
    for i in [*range(0x21, 0x600), *range(0x600, 0x30000, 7)]:
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            for t in (f"Ab{c}cd", f"{c}", f"x{c}.", f"{c}'s{c}{c}"):
                assert encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, hex(i)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBéÑßſİΣς'\"$%.,;!?0½-_|<>~\u0301 \n\x1c日", max_size=14))
def test_marks_before_and_behind_words(tok, text):
    assert simple8b.library_encoder(PATH)()([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_the_librarys(tok):
    encode = simple8b.library_encoder(PATH)()
    texts = ["end <|endoftext|> here", "<|startoftext|>", "a<|endoftext|><|endoftext|>b", "< |endoftext|>", "<|ENDOFTEXT|> x",
             "plain", "<|endoftext|"]
    assert encode(texts)[0].tolist() == [806, 49407, 763]
    assert [e.tolist() for e in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(tok):
    encoder = simple8b.Parts(PATH, remembered=20)
    texts = [f"word{i} {'abc' * (i % 7)} Été, {i} don't." for i in range(50)]
    for k in range(0, 50, 5):
        got = encoder.encode(texts[k:k + 5])
        assert [e.tolist() for e in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts[k:k + 5]]
        assert len(encoder) <= 20


def test_other_files_of_the_library(tmp_path):
    from tokenizers import models, pre_tokenizers
    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[U]": 2}, unk_token="[U]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    other.save(path)
    assert simple8b.library_encoder(path)()(["a b,c  a", ""])[0].tolist() == [0, 1, 2, 2, 0]


def test_memory_is_bounded_within_a_batch_too(tok):
    encoder = simple8b.Parts(PATH, remembered=100)
    tokenize, most = encoder.tokenize, 0

    def spied(piece):
        nonlocal most
        most = max(most, len(encoder) + len(encoder.words))
        return tokenize(piece)
    encoder.tokenize = spied
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'e' * (i // 1000)}"
                    for i in range(5000))
    assert encoder.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert most <= 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'''stmdrevlA1²ªÉ×\xa0\x85\x1c\x00. \n€", max_size=12), max_size=5))
def test_pieces_of_many_texts_are_the_librarys(tok, texts):
    got = simple8b.library_encoder(PATH)()(texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_over_the_length_cut_at_a_time(tok, monkeypatch):
    monkeypatch.setattr(simple8b, "CUT_CHARS", 30)
    texts = ["a plain text of forty letters, it isn't short", "", "b", "it's", "日本 it's", "'re", " ", "c\n" * 20, "d"]
    got = simple8b.Parts(PATH).encode(texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_loads_the_file_once(spark):
    """A task gets the encoder pickled; each one made a tokenizer of its own."""
    from pyspark import cloudpickle
    sent = cloudpickle.dumps(simple8b.library_encoder(PATH))
    first, second = (cloudpickle.loads(sent)().__self__ for _ in range(2))
    assert first is second is simple8b._CODERS[PATH]

    encode = simple8b.library_encoder(PATH)

    def loaded(batches):
        import os

        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([id(encode().__self__)], pa.int64())],
                                             names=["worker", "coder"])
    rows = spark.range(12, numPartitions=12).mapInArrow(loaded, "worker long, coder long").collect()
    assert len({(r.worker, r.coder) for r in rows}) == len({r.worker for r in rows})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBé €’łΣİ日́ 　.'s \n\x85\x1c", max_size=16), max_size=4))
def test_texts_with_parts_outside_latin(tok, texts):
    got = simple8b.library_encoder(PATH)()(texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_character_outside_latin_leaves_the_other_words_in_arrays(tok):
    encoder = simple8b.Parts(PATH)
    text = "plain words and more — ‘quoted’ ones, and again words"
    assert encoder.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert sorted(k.decode() for k in encoder) == ["—", "‘quoted’"]

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawseries.llm import repeats as R
from drawseries.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .conftest import ODD


def brute_runs(w, least=12):
    """Every stretch of some period that cannot grow, with the smallest period of each."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted([(s, n, p) for (s, n), p in out.items()], key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for i, t in rows:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t or "").split(" ") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        runs = brute_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        out.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                    hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                    hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def columns(df):
    return sorted([tuple(r)[:8] for r in df.collect()], key=str)


words = st.lists(st.integers(0, 2).map(lambda i: b"abc"[i:i + 1]), max_size=120)
periodic = st.tuples(words, st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=9), st.integers(0, 12), words).map(
    lambda x: x[0][:20] + x[1] * x[2] + x[3][:20])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(words, periodic), max_size=5))
def test_runs_match_brute_force(docs):
    assert [[tuple(r) for r in x.tolist()] for x in R.runs(docs)] == [brute_runs(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(words, periodic), min_size=1, max_size=4), st.data())
def test_extensions(docs, data):
    seq = []
    for k, d in enumerate(docs):
        seq += [100 + k, *[w[0] - 97 for w in d]]
    seq = np.array([*seq, 100 + len(docs)], dtype=np.int64)
    pairs = data.draw(st.lists(st.tuples(st.integers(1, len(seq) - 1), st.integers(1, len(seq) - 1)), min_size=1, max_size=20))
    pairs = [(a, b) for a, b in pairs if a != b]
    g = R.Grammar(seq, 100)
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    for ahead in (True, False):
        for x, y, got in zip(a.tolist(), b.tolist(), g.extend(a, b, ahead).tolist()):
            n = 0
            while (seq[x + n] == seq[y + n]) if ahead else (seq[x - n - 1] == seq[y - n - 1]):
                n += 1
            assert got == n


def test_long_documents_of_few_words():
    a = [b"w"] * 30000
    b = [b"x%d" % (i % 7777) for i in range(30000)]
    one, two, three = R.runs([a, b, [b"%d" % i for i in range(500)]])
    assert one.tolist() == [[0, 30000, 1]] and two.tolist() == [[0, 30000, 7777]] and not len(three)
    assert R.kept_words(30000, two).sum() == 7777


def test_grammar_shrinks():
    g = R.Grammar(np.array([9, *np.random.default_rng(0).integers(0, 3, 5000), 10]), 9)
    assert len(g.levels[-1].sym) == 3 and sum(len(v.sym) for v in g.levels) < 8 * 5000


def test_odd_rows(docs_of):
    rows = ODD + [(i, "la la " * i + "end " + "a b c " * 5) for i in range(40)]
    docs = docs_of(rows).withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = columns(R.digests(R.find_runs(docs, key="doc_id", edited=True)))
    assert got == brute(rows)
    plain = {r.doc_id: r for r in R.find_runs(docs_of([(0, "x y " * 10 + "z"), (1, None)]).select("doc_id", "text")).collect()}
    assert plain[0].collapsed == "x y z" and plain[0].runs[0].length == 20 and plain[1].runs == [] and plain[1].n_words == 0
    assert R.digests(R.find_runs(docs_of([]), key="doc_id", edited=True)).count() == 0


def test_batches_are_cut(docs_of, monkeypatch):
    rows = [(i, "p q " * (i % 9) + f"w{i}") for i in range(60)]
    monkeypatch.setattr(R, "WORDS", 20)
    assert columns(R.digests(R.find_runs(docs_of(rows), key="doc_id", edited=True))) == brute(rows)


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert columns(QUERIES["op11_recompression_runs"](spark, SF_SMALL)) == brute(rows)

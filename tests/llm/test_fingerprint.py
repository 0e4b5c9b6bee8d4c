import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawseries.llm.fingerprint import BINS, Parse, edited_fingerprints, fingerprint, likeness, signature
from drawseries.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .conftest import ODD


def phrases(text):
    """The parse by its definition."""
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in seen:
            end += 1
        seen.add(text[at:end])
        at = end
    return seen


def parsed(text):
    p = Parse()
    p.feed(text)
    return p.hashes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé🙂", max_size=200), st.text(alphabet="abé🙂", max_size=80))
def test_parse_and_going_back(a, b):
    assert len(set(parsed(a).tolist())) == len(phrases(a))
    p = Parse()
    p.feed(a)
    mark = p.mark()
    p.feed(b)
    assert p.hashes().tolist() == parsed(a + b).tolist()
    p.back(mark)
    p.feed("bé")
    assert p.hashes().tolist() == parsed(a + "bé").tolist()


def test_likeness_estimates_shared_phrases():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    a = " ".join(rng.choice(words, 2000))
    b = a[:int(len(a) * .75)] + " ".join(rng.choice(words, 500))
    pa, pb = phrases(a), phrases(b)
    got = likeness(signature(parsed(a)), signature(parsed(b)))
    assert abs(got - len(pa & pb) / len(pa | pb)) < 0.15


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 4] + n[:len(t) // 4]
        sig = [signature(parsed(x)) for x in (t, e, n)]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e),
                    likeness(sig[0], sig[1]), likeness(sig[0], sig[2])))
    return out


def columns(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
            for r in df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).collect()]


def key(r):
    return str(r)


def test_odd_rows(docs_of):
    rows = [r for r in ODD if r[0] != 4] + [(i, f"text {i * 7919 % 101} " * (i % 5)) for i in range(50, 90)]
    docs = docs_of(rows).withColumn("block", F.lit("b")).withColumn("h", F.lit(0)).withColumn("after", F.lit(1))
    assert sorted(columns(edited_fingerprints(docs)), key=key) == sorted(brute(rows), key=key)


def test_repeated_rows_and_single_and_empty(docs_of):
    rows = [(1, "one one one")] * 6 + [(2, "two")]
    got = columns(edited_fingerprints(docs_of(rows)))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert columns(edited_fingerprints(docs_of([(1, "only text")]))) == brute([(1, "only text")])
    assert edited_fingerprints(docs_of([])).count() == 0
    assert fingerprint("") == "----" * BINS


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_lz_fingerprint"](spark, SF_SMALL).collect()
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute(rows), key=key)

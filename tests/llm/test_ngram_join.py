import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawseries.llm import ngram_join
from drawseries.llm.ngram_join import CELLS, Trie, join_block, keys, near_duplicates, needed, shingles
from drawseries.llm.queries import QUERIES

from ..conftest import SF_SMALL
from .conftest import ODD


def words_of(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def set_of(text, n):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=3, percent=90):
    """(doc_id, size, least linked id) by comparing all rows."""
    sets = [set_of(t, n) for _, t in rows]
    lead = {i: i for i in {d for d, _ in rows}}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    def order(d):
        return (d is not None, d or 0)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])), key=order)
                lead[y] = x
    return sorted(((d, len(s), root(d)) for (d, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def edited(rng, words, share, vocabulary):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = rng.choice(vocabulary)
    return out


def corpus(seed, groups=25, size=6, shares=(0.005, 0.02, 0.04)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 11, 20, 40, 80, 200, 500]))]
        if g % 3 == 0:
            base += passage
        for k in range(size):
            rows.append((len(rows) * 7 % 5000, " ".join(edited(rng, base, shares[k % len(shares)], vocabulary) if k else base)))
    return rows


def test_shingles_split_and_count():
    for t in ("A b C d", "one", "a a a a a", "é É x\x1cy z", "", None, " \t\n"):
        for n in (3, 5):
            assert len(shingles(t, n)) == len(set_of(t, n))
    assert (shingles("A B c D", 3) == shingles("a b C d", 3)).all()


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_always_share_a_key(percent):
    rng = np.random.default_rng(percent)
    classes = (rng.integers(0, 40, CELLS) == 0).astype(np.uint8) * 3
    for _ in range(4000):
        n = int(rng.integers(1, 120)) if rng.random() < .7 else int(rng.integers(120, 900))
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        most = len(a) * (100 - percent) // percent
        gone = int(rng.integers(0, most + 1))
        new = int(rng.integers(0, most - gone + 1))
        b = np.union1d(rng.permutation(a)[gone:], rng.integers(0, 2 ** 64, new, dtype=np.uint64))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= percent * len(np.union1d(a, b)):
            assert len(np.intersect1d(keys(a, classes, percent), keys(b, classes, percent)))


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_exactly_the_links(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(8)]
    seqs = []
    for i in range(90):
        s = set(base[i % 8].tolist())
        for _ in range(rng.integers(0, 8)):
            s ^= {int(rng.integers(0, 300))}
        seqs.append(np.array(sorted(s or {1}), dtype=np.int64))
    trie = Trie(seqs)
    mark = np.zeros(300, dtype=np.int64)
    for percent in (70, 80, 90):
        for s in seqs:
            mark[:] = 0
            mark[s] = 1
            want = {j for j, o in enumerate(seqs)
                    if 100 * len(np.intersect1d(s, o)) >= percent * len(np.union1d(s, o))}
            assert set(trie.links(mark, len(s), percent).tolist()) == want
    assert needed(10, 10, 90) == 10 and needed(20, 19, 90) == 19


def test_known_parts_are_kept():
    a, b, c = (np.array(x, dtype=np.uint64) for x in ([1, 2, 3], [7, 8], [1, 2, 3]))
    assert join_block([a, b, c], [0], 90) == [0, 1, 0]
    assert join_block([a, b, c], [], 90, [5, 5, 6]) == [0, 0, 2]


@pytest.mark.parametrize("n, percent, block", [(3, 90, 512), (3, 90, 3), (5, 80, 512), (5, 80, 4)])
def test_matches_brute_force(docs_of, n, percent, block):
    rows = corpus(n * percent)
    assert got(near_duplicates(docs_of(rows), n, percent, block=block)) == brute(rows, n, percent)


def test_odd_rows_and_clashing_columns(docs_of):
    rows = [r for r in ODD if r[0] != 2] + [(2, "word"), (60, "Word"), (61, "no id"), (62, "a b"), (62, "c d e f"), (63, "A\tB"),
                                            (64, "C d E f")]
    docs = docs_of(rows).withColumn("id", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("part", F.lit(2)).withColumn("n", F.lit(3))
    assert got(near_duplicates(docs)) == brute(rows)
    assert near_duplicates(docs_of([])).count() == 0
    assert got(near_duplicates(docs_of([(1, None), (2, None)]))) == [(1, 0, 1), (2, 0, 2)]


def test_one_large_group(docs_of, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(1000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.012, vocabulary))) for i in range(150)]
    assert got(near_duplicates(docs_of(rows), block=16)) == brute(rows)


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op3_prefix_tree_join"](spark, SF_SMALL)) == brute(rows)


def test_every_text_of_an_id_is_compared(docs_of):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(500)]
    s1, s2, s3 = ([rng.choice(vocabulary) for _ in range(200)] for _ in range(3))

    def near(s):
        return " ".join([*s[:-1], "other"])
    s1, near1, s2, near2, s3, near3 = " ".join(s1), near(s1), " ".join(s2), near(s2), " ".join(s3), near(s3)
    rows = [(5, s1), (5, s2), (3, s2), (9, near1)]
    assert {r[0]: r[2] for r in got(near_duplicates(docs_of(rows)))} == {5: 3, 3: 3, 9: 3}
    rows = [(7, s1), (7, s2), (7, s3), (2, s1), (4, s2), (6, s3), (20, near1), (21, near2), (22, near3), (30, "alone here now")]
    assert got(near_duplicates(docs_of(rows))) == brute(rows)
    assert {r[2] for r in got(near_duplicates(docs_of(rows)))} == {2, 30}

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawseries.llm import embed_join
from drawseries.llm.embed_join import near_vectors
from drawseries.llm.graph import components
from drawseries.llm.queries import QUERIES

from ..conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, rep int"


def brute(rows, t=0.98):
    """Links, components and survivors by comparing all."""
    def ok(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    n = len(rows)
    links, lead = [0] * n, list(range(n))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v, g) else None
            for _, v, g in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= t:
                    links[i] += 1
                    links[j] += 1
                    lead[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("per_pivot, own, other", [(512, 1024, 2048), (10, 16, 24)])
def test_matches_brute_force(spark, monkeypatch, per_pivot, own, other):
    monkeypatch.setattr(embed_join, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(embed_join, "OWN", own)
    monkeypatch.setattr(embed_join, "OTHER", other)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 8))
    rows = [(i, (base[i % 12] + 0.12 * rng.standard_normal(8)).tolist(), int(i % 12) // 5) for i in range(260)]
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(40)]          # exact copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [None] + [1.0] * 7, 1),
             (2004, [float("nan")] + [1.0] * 7, 1), (2005, base[0].tolist(), None), (2006, base[0].tolist(), None),
             (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(near_vectors(df)) == brute(rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got(QUERIES["op10_pivot_range_join"](spark, SF_SMALL)) == brute(rows)


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    edges = [(names[i], names[i + 1]) for i in range(120)]                            # a long path
    edges += [(names[200], names[i]) for i in range(201, 300)]                        # a star
    edges += [(names[300 + i], names[300 + (i + 1) % 50]) for i in range(50)] + [(5, 5)]
    want = {}
    for part in (names[:121], names[200:300], names[300:350]):
        want.update({v: min(part) for v in part})
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_nodes_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(near_vectors(df)) == [(5, 0, 5, True), (5, 0, 5, True)]
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 2), (3, [0.0, 1.0, 0.01], 1), (8, [1.0, 0.01, 0.0], 1),
            (8, [1.0, 0.01, 0.0], 1), (9, [0.0, 0.0, 1.0], 1), (5, [0.0, 0.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(near_vectors(df)) == brute(rows)

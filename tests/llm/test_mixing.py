import hashlib
import math

import pytest
from pyspark.sql import functions as F

from drawseries.llm.mixing import POWER, SEED, mix, poisson_cdf, source_rates

from .conftest import ODD


def u_of(seed, *parts):
    text = ":".join([str(seed), *["null" if p is None else str(p) for p in parts]])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2 ** 52


def inverse(rate, u):
    if rate <= 0:
        return 0
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_match_brute_force(docs_of):
    rows = [(i, "x" * (1 + i % 9), "en", f"s{i % 3}" if i % 4 else None) for i in range(800)]
    size = {}
    for i, t, _, s in rows:
        size[s] = size.get(s, 0) + len(t) + 1
    w = {s: b ** POWER for s, b in size.items()}
    rate = {s: w[s] / sum(w.values()) * sum(size.values()) / size[s] for s in size}
    want = {i: inverse(rate[s], u_of(SEED, i)) for i, _, _, s in rows}
    got = {}
    for r in mix(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append(r.mix_copy)
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(n)) for i, n in want.items() if n}


def test_order_is_global_and_rates_hit_targets(docs_of):
    rows = [(i, "abc", "en", "big" if i % 10 else "small") for i in range(4000)]
    docs = docs_of(rows)
    got = mix(docs, weights={"big": 0.5, "small": 0.5}).select("source", "mix_order").collect()
    order = [r.mix_order for r in got]
    assert order == sorted(order)
    small = sum(r.source == "small" for r in got)
    assert abs(small - 2000) < 250 and abs(len(got) - 4000) < 400
    assert {r.src: round(r.rate, 3) for r in source_rates(docs, {"big": 1.0}).collect()}["small"] == 0.0


@pytest.mark.parametrize("rate", [0.01, 1.0, 37.5, 900.0, 20000.0])
def test_cdf_reaches_one(rate):
    first, cdf = poisson_cdf(rate)
    assert abs(cdf[-1] - 1) < 1e-9
    mean = sum((first + i) * (c - p) for i, (c, p) in enumerate(zip(cdf, [0.0, *cdf])))
    assert abs(mean - rate) < 1e-6 * max(1, rate)


def test_odd_rows_and_empty(docs_of):
    docs = docs_of(ODD).withColumn("cdf", F.lit(1)).withColumn("first", F.lit("z")).withColumn("bytes", F.lit(2))
    got = mix(docs, power=1.0, size=3.0)
    assert got.columns == docs.columns + ["mix_copy", "mix_order"]
    assert got.count() == sum(inverse(3.0, u_of(SEED, i)) for i, _ in ODD)
    assert mix(docs_of([])).count() == 0

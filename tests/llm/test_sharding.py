import zlib

import numpy as np
from pyspark.sql import functions as F

from drawseries.llm.sharding import jump, shard_rows

from .conftest import ODD


def jump_one(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_scalar_form():
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 2000, dtype=np.int64)
    for n in (1, 2, 8, 9, 100):
        assert jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]


def test_rows_sizes_slots(spark, docs_of):
    rows = ODD + [(i, f"t{i % 7}") for i in range(100, 700)] + [(9, "same")] * 50
    docs = docs_of(rows)
    got = shard_rows(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    keys = {r.key: r.h for r in docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"))
            .distinct().withColumn("h", F.xxhash64("key")).collect()}
    slots = {}
    for r in got:
        h = keys[str(r.doc_id) if r.doc_id is not None else "null"]
        assert (r.shard, r.grown_shard) == (jump_one(h, 8), jump_one(h, 9))
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_empty_and_clashing_columns(spark, docs_of):
    assert shard_rows(docs_of([])).count() == 0
    docs = docs_of([(1, "a")]).withColumn("shard", F.lit(7)).withColumn("slot", F.lit("x")).withColumn("size", F.lit(0))
    r = shard_rows(docs).first()
    assert r["size"] == 2 and r.slot == 0

"""Features against a plain-Python restatement of their definitions, on edge
series (F10), plus metamorphic checks: block form = plain form, distributed
seq = row_number, appending future draws never changes earlier as-of rows."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from drawseries.operators.features import DOUBLE_FEATURES, FEATURE_COLUMNS, features
from drawseries.operators.sequence import add_seq, add_seq_plain

D0 = dt.date(2020, 1, 1)


def _std(xs):
    return statistics.stdev(xs) if len(xs) >= 2 else None


def _digits(v):
    return [(v // p) % 10 for p in (1000, 100, 10, 1)]


def python_features(results, dates):
    """Restated from the operator inventory, one row at a time."""
    rows, streak = [], 0
    for i, r in enumerate(results):
        lag = {k: (results[i - k] if i - k >= 0 else None) for k in (1, 2, 3, 5, 7)}
        f = {f"result_lag_{k}": lag[k] for k in (1, 2, 3, 5, 7)}
        for k in (1, 2, 3):
            v = lag[k] or 0
            for name, d in zip(("miles", "centenas", "decenas", "unidades"), _digits(v)):
                f[f"lag{k}_{name}"] = d
        d1 = r - lag[1] if lag[1] is not None else None
        f["diff_1"] = d1
        f["diff_2"] = lag[1] - lag[2] if lag[2] is not None else None
        f["diff_abs_1"] = abs(d1) if d1 is not None else None
        f["signo_diff_1"] = (d1 > 0) - (d1 < 0) if d1 is not None else None
        if i > 0:
            step = (d1 > 0) - (d1 < 0)
            streak = (streak + 1 if streak > 0 else 1) if step > 0 else \
                (streak - 1 if streak < 0 else -1) if step < 0 else 0
        f["racha"] = streak
        w7, w30 = results[max(0, i - 6):i + 1], results[max(0, i - 29):i + 1]
        f["rolling_mean_7"], f["rolling_std_7"] = sum(w7) / len(w7), _std(w7)
        f["rolling_mean_30"], f["rolling_std_30"] = sum(w30) / len(w30), _std(w30)
        f["rolling_max_7"], f["rolling_min_7"] = max(w7), min(w7)
        f["rolling_range_7"] = max(w7) - min(w7)
        l1 = lag[1] or 0
        p7, p30 = results[max(0, i - 7):i], results[max(0, i - 30):i]
        m7 = sum(p7) / len(p7) if p7 else 0
        m30 = sum(p30) / len(p30) if p30 else 0
        s30 = _std(p30)
        f["lag1_sobre_media_7"] = int(l1 > m7)
        f["lag1_sobre_media_30"] = int(l1 > m30)
        f["lag1_z_score_30"] = (l1 - m30) / (s30 if s30 else 1)
        f["tendencia_7"] = int(i >= 1 and r > results[max(0, i - 6)])
        f["tendencia_30"] = int(i >= 1 and r > results[max(0, i - 29)])
        s = sum(_digits(l1))
        f["lag1_suma_digitos"], f["lag1_suma_digitos_par"] = s, int(s % 2 == 0)
        f["lag1_unidades_par"] = int(l1 % 10 % 2 == 0)
        for n in (10, 30, 90):
            f[f"freq_{n}"] = sum(1 for x in results[max(0, i - n):i] if x == r)
        prev = [j for j in range(i) if results[j] == r]
        f["dias_desde_ultimo"] = (dates[i] - dates[prev[-1]]).days if prev else 0
        rows.append({k: (0 if v is None else v) for k, v in f.items()})
    return rows


def edge_series():
    rnd = random.Random(7)
    out = {}
    for n in (0, 1, 2, 6, 7, 8, 29, 30, 31, 89, 90, 91):
        out[f"rand_{n}"] = [rnd.randrange(10000) for _ in range(n)]
    out["constant"] = [4242] * 40
    out["rising"] = list(range(100, 400, 3))
    out["alternating"] = [1000 if i % 2 else 9000 for i in range(60)]
    for gap in (10, 11, 30, 31, 90, 91):
        s = [rnd.randrange(1, 9999) for _ in range(gap + 5)]
        s[2] = s[2 + gap] = 7
        out[f"repeat_{gap}"] = s
    return out


def _frame(spark, series):
    rows = []
    for name, vals in series.items():
        for i, v in enumerate(vals):
            rows.append((name, i + 1, D0 + dt.timedelta(days=2 * i + (i % 3)), v, "ARI"))
    return spark.createDataFrame(rows, "lottery string, seq bigint, fecha date, result int, series string")


def _close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("block_rows", [None, 97, 128])
def test_features_equal_python_restatement(spark, block_rows):
    series = edge_series()
    got = features(_frame(spark, series), block_rows=block_rows).collect()
    by = {(r["lottery"], r["seq"]): r for r in got}
    assert len(got) == sum(len(v) for v in series.values())
    for name, vals in series.items():
        dates = [D0 + dt.timedelta(days=2 * i + (i % 3)) for i in range(len(vals))]
        for i, exp in enumerate(python_features(vals, dates)):
            row = by[(name, i + 1)]
            for c in FEATURE_COLUMNS:
                assert _close(row[c], exp[c]), (name, i + 1, c, row[c], exp[c])


def test_feature_types(spark):
    df = features(_frame(spark, {"a": [1, 2, 3]}))
    types = dict(df.dtypes)
    for c in FEATURE_COLUMNS:
        assert types[c] == ("double" if c in DOUBLE_FEATURES else "int")


def test_block_form_equals_plain_on_events(spark):
    from drawseries.sources import testdata as td
    ev = td.event_series(spark, "/root/testdata/sf0.01")
    plain = features(ev, block_rows=None)
    block = features(ev, block_rows=300)
    cols = ["lottery", "seq"] + FEATURE_COLUMNS
    assert plain.select(cols).exceptAll(block.select(cols)).count() == 0
    assert block.select(cols).exceptAll(plain.select(cols)).count() == 0


def test_distributed_seq_equals_row_number(spark):
    from drawseries.sources import testdata as td
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_type", "ts", "event_id")
    a = add_seq(ev, "event_type", ["ts", "event_id"])
    b = add_seq_plain(ev, "event_type", ["ts", "event_id"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    d = td.draws(spark, "/root/testdata/sf0.001")
    assert d.groupBy("lottery").agg((F.max("seq") - F.count("*")).alias("gap")) \
        .filter("gap != 0").count() == 0


def test_as_of_rows_do_not_see_the_future(spark):
    vals = [random.Random(3).randrange(10000) for _ in range(200)]
    full = _frame(spark, {"s": vals})
    cut = full.filter(F.col("seq") <= 150)
    cols = ["seq"] + FEATURE_COLUMNS
    a = features(full, mode="as_of", block_rows=120).filter(F.col("seq") <= 150).select(cols)
    b = features(cut, mode="as_of", block_rows=120).select(cols)
    assert a.exceptAll(b).count() == 0
    last = features(cut, mode="as_of").filter(F.col("seq") == 150).collect()[0]
    assert last["target"] is None
    nxt = features(full, mode="as_of").filter(F.col("seq") == 150).collect()[0]
    assert nxt["target"] == vals[150]


def test_repartition_invariance(spark):
    series = edge_series()
    df = _frame(spark, series)
    a = features(df.repartition(7))
    b = features(df.coalesce(1))
    assert a.exceptAll(b).count() == 0


def test_range_seq_equals_row_number_with_hot_key(spark):
    from drawseries.operators.sequence import add_seq_range
    # one key holds most rows, many rows share an hour: the range variant splits it
    rows = [("hot", i // 1000, i) for i in range(6000)] + [("cold", i, 10_000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint")
    a = add_seq_range(df, "k", ["t", "id"], partitions=7)
    b = add_seq_plain(df, "k", ["t", "id"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_add_seq_splits_a_hot_value(spark):
    rows = [("hot", 0, i) for i in range(3000)] + [("cold", i, 10_000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint")
    a = add_seq(df, "k", ["t", "id"], partitions=5)
    b = add_seq_plain(df, "k", ["t", "id"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

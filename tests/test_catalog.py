"""Keyed writes and cleaning: idempotence, priority rules, rejection paths."""

import pytest
from pyspark.sql import functions as F

from drawseries.functions import clean as C
from drawseries.operators import catalog as CT
from drawseries.sources import testdata as td

from .conftest import SF_SMALL

KEY = ["fecha", "lottery"]


def test_upsert_idempotent(spark):
    old = CT.dedupe_last(td.raw_old(spark, SF_SMALL), KEY, ["k"])
    new = td.raw_new(spark, SF_SMALL)
    once = CT.upsert(old, new, KEY, ["k"])
    twice = CT.upsert(once, new, KEY, ["k"])
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_upsert_new_wins_and_insert_keeps_old(spark):
    t = spark.createDataFrame([("2020-01-01", "A", 1, "ARI", 5)], "fecha string, lottery string, result int, series string, k int")
    n = spark.createDataFrame([("2020-01-01", "A", 2, "TAU", 1), ("2020-01-01", "A", 3, "GEM", 2),
                               ("2020-01-02", "A", 4, "CAN", 3)],
                              "fecha string, lottery string, result int, series string, k int")
    up = {(r.fecha, r.result) for r in CT.upsert(t, n, KEY, ["k"]).collect()}
    assert up == {("2020-01-01", 3), ("2020-01-02", 4)}
    merged, inserted = CT.insert_if_absent(t, n, KEY, ["k"])
    assert {(r.fecha, r.result) for r in merged.collect()} == {("2020-01-01", 1), ("2020-01-02", 4)}
    assert inserted.count() == 1


def test_lookup_rejects_unknown_keys(spark):
    d = spark.createDataFrame([("2020-01-01", "1-URGENT", 1, "PIS"), ("2020-01-01", "1-URGENT", 1, "ARI"),
                               ("2020-01-01", "NOPE", 1, "ARI")], "fecha string, lottery string, result int, series string")
    ok, bad = CT.lookup_keys(d, td.loterias(spark, SF_SMALL), td.signos(spark, drop=("PIS",)))
    assert ok.count() == 1 and bad.count() == 2
    assert {r[0] for r in CT.unknown_codes(d, td.signos(spark, drop=("PIS",))).collect()} == {"PIS"}


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), None), (float("nan"), 2), (1.5, 3)],
                               "x double, y int")
    out = [tuple(r) for r in C.finite_or_zero(df).collect()]
    assert out == [(0.0, 1), (0.0, 0), (0.0, 2), (1.5, 3)]


def test_essential_columns_missing(spark):
    with pytest.raises(ValueError):
        C.essential_columns(spark.createDataFrame([(1,)], "fecha int"))


def test_normalise_and_parse(spark):
    df = spark.createDataFrame([(" géminis ", "2024-1-5", "01-23"), ("ari", "5/1/2024", "123"),
                                ("OFIUCO", "n/a", "9 9 9 9")], "s string, f string, n string")
    rows = df.select(C.normalise_sign("s").alias("p"), C.normalise_sign("s", "strict").alias("st"),
                     C.parse_fecha("f").alias("d"), C.parse_number("n").alias("n")).collect()
    assert [r.p for r in rows] == ["GEM", "ARI", "OFIUCO"]
    assert [r.st for r in rows] == ["GEM", None, None]
    assert [str(r.d) for r in rows] == ["2024-01-05", "2024-01-05", "None"]
    assert [r.n for r in rows] == [123, None, 9999]


def test_validate_reports_every_reason(spark):
    df = spark.createDataFrame([(None, "n/a", 12345, None), ("A", "2024-01-01", 5, "ARI")],
                               "lottery string, fecha string, result int, series string")
    good, bad = C.validate_draws(df)
    assert good.count() == 1
    assert bad.collect()[0].reasons == ["lottery: empty", "result: outside 0..9999",
                                         "fecha: unparseable", "series: required"]


def test_merge_snapshot_dedupes_always(spark):
    from drawseries.sources.tabular import merge_snapshot
    schema = "fecha string, lottery string, result int, series string, k int"
    new = spark.createDataFrame([("d1", "A", 1, "ARI", 1), ("d1", "A", 2, "ARI", 2)], schema)
    assert merge_snapshot(spark.createDataFrame([], schema), new).count() == 1
    old = spark.createDataFrame([("d0", "A", 9, "ARI", 0)], schema)
    out = {(r.fecha, r.result) for r in merge_snapshot(old, new).collect()}
    assert out == {("d0", 9), ("d1", 2)}


def test_extend_dimension_keeps_ids(spark):
    dim = spark.createDataFrame([(1, "B"), (2, "D")], "id int, nombre string")
    names = spark.createDataFrame([("C",), ("A",), ("B",), (None,)], "nombre string")
    out = {r.nombre: r.id for r in CT.extend_dimension(dim, names).collect()}
    assert out == {"B": 1, "D": 2, "A": 3, "C": 4}


def test_digits_roundtrip(spark):
    df = spark.range(0, 10000).select(F.col("id").cast("int").alias("n"))
    back = df.select("n", *C.digits("n")).select(
        "n", C.from_digits("miles", "centenas", "decenas", "unidades").alias("m"))
    assert back.filter(F.col("n") != F.col("m")).count() == 0
    assert df.select(C.zfill4("n").alias("z")).filter(~C.is_four_digits("z")).count() == 0


def test_new_rows_watermark_rules(spark):
    from drawseries.sources.tabular import new_rows
    schema = "fecha date, lottery string, result int"
    d = lambda s: __import__("datetime").date.fromisoformat(s)
    target = spark.createDataFrame([(d("2024-01-09"), "UP", 1), (d("2024-01-05"), "OLD", 2)], schema)
    feed = spark.createDataFrame(
        [(d("2024-01-10"), "UP", 3),                      # UP is current (max >= yesterday): nothing
         (d("2024-01-05"), "OLD", 4), (d("2024-01-06"), "OLD", 5), (d("2024-01-12"), "OLD", 6),
         (d("2024-01-01"), "NEW", 7), (d("2024-01-11"), "NEW", 8)], schema)   # NEW has no history: all
    got = {(r.lottery, r.result) for r in new_rows(feed, target, "2024-01-10").collect()}
    assert got == {("OLD", 5), ("OLD", 6), ("NEW", 7), ("NEW", 8)}
    closed = {(r.lottery, r.result) for r in new_rows(feed, target, "2024-01-10", upper_bound=True).collect()}
    assert closed == {("OLD", 5), ("NEW", 7)}            # closed at yesterday


def test_lookup_case_rules(spark):
    d = spark.createDataFrame([("2020-01-01", " 1-urgent ", 1, "ari")],
                              "fecha string, lottery string, result int, series string")
    lot, sig = td.loterias(spark, SF_SMALL), td.signos(spark)
    ok, bad = CT.lookup_keys(d, lot, sig, case_insensitive=True)
    assert ok.count() == 1 and bad.count() == 0
    ok, bad = CT.lookup_keys(d, lot, sig, case_insensitive=False)      # bulk-load rule: exact
    assert ok.count() == 0 and bad.count() == 1


def test_statistics_survive_constant_series(spark):
    from drawseries.operators.stats import acf, digit_corr, lag_corr
    df = spark.createDataFrame([("C", i, 4242) for i in range(1, 80)]
                               + [("V", i, (i * 7919) % 10000) for i in range(1, 80)],
                               "lottery string, seq bigint, result int")
    lc = {r.lottery: r for r in lag_corr(df).collect()}
    assert lc["C"].corr_result is None and lc["V"].corr_result is not None
    assert digit_corr(df).filter("lottery = 'C'").first().corr_miles_centenas is None
    a = acf(df, nlags=3, block_rows=100).filter("lottery = 'C'").collect()
    assert all(r.acf is None and r.is_peak is False for r in a)


def test_read_draws_tabular_parquet(spark):
    import uuid
    from drawseries.session import ensure_checkpoint_dir
    from drawseries.sources.tabular import read_draws_tabular
    path = f"{ensure_checkpoint_dir(spark)}/tab_{uuid.uuid4().hex}"
    spark.createDataFrame([("05/01/2024", " sol ", " 123 ", "ari", "x"), ("bad", "sol", "1", "ari", "y"),
                           ("2024-01-06", None, "7", "leo", "z"), ("2024-01-07", "sol", "n/a", "leo", "w")],
                          "fecha string, lottery string, result string, series string, extra string") \
        .write.parquet(path)
    rows = [tuple(r) for r in read_draws_tabular(spark, path, fmt="parquet").collect()]
    import datetime as dt
    assert rows == [(dt.date(2024, 1, 5), "SOL", 123, "ARI")]

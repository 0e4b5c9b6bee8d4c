"""The update chain and the counts of keyed writes, on small tables."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from drawseries.operators import catalog as CT
from drawseries.operators import update as U
from drawseries.session import ensure_checkpoint_dir, store
from drawseries.sources import testdata as td
from drawseries.sources.cow import CowTable

SCHEMA = "fecha date, lottery string, result int, series string, k long"


def _page(*rows):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr><th>h</th></tr>{body}</table><table><tr><th>h</th></tr>{body}</table>"


def _d(s):
    return dt.date.fromisoformat(s)


@pytest.fixture()
def table(spark):
    t = CowTable(spark, f"{ensure_checkpoint_dir(spark)}/t_update_{uuid.uuid4().hex}")
    t.start(spark.createDataFrame([(_d("2024-01-10"), "A", 1, "LEO", 0), (_d("2024-06-01"), "DONE", 1, "LEO", 0)], SCHEMA))
    return t


def test_lotteries_fail_alone_and_rows_are_kept_with_reasons(spark, table):
    pages = spark.createDataFrame([
        (1, "A", _page(("10/01/2024", "9999", "Leo"), ("11/01/2024", "0002", "Aries"), ("short", "1"))),
        (2, "A", _page(("11/01/2024", "00-03", "Virgo"), ("no date", "0001", "Leo"), ("12/01/2024", "12", "Leo"),
                       ("13/01/2024", "0004", "Ofiuco"))),
        (3, "A", "<table></table>"),                                    # one unreadable page is no failure
        (4, "DONE", _page(("02/06/2024", "0001", "Leo"))),
        (5, "NOWHERE", _page(("02/06/2024", "0001", "Leo"))),
        (6, "BROKEN", None), (7, "BROKEN", "<table></table>"),
        (8, "B LUNA", _page(("01/01/2024", "0007", "Leo"))),            # no history: everything is new
    ], "page_id long, lottery string, html string")
    names = spark.createDataFrame(enumerate(["a", " DONE", "BROKEN", "B LUNA"]), "id int, nombre string")
    report, rejected = U.update(table, pages, names, td.signos(spark), "2024-06-02", 0)
    got = {r.lottery: (r.status, r.pages, r.read, r.rejected, r.not_new, r.inserted, r.updated) for r in report.collect()}
    assert got == {
        "A": ("ok", 3, 6, 3, 1, 1, 0), "DONE": ("ok", 1, 1, 0, 1, 0, 0), "B LUNA": ("ok", 1, 1, 0, 0, 1, 0),
        "NOWHERE": ("unknown_lottery", 1, -1, -1, -1, -1, -1), "BROKEN": ("no_table", 2, -1, -1, -1, -1, -1),
        "TOTAL": ("", 5, 8, 3, 2, 2, 0)}
    assert sorted((r.fecha_text, r.reason) for r in rejected.collect()) == [
        ("12/01/2024", "bad_number"), ("13/01/2024", "unknown_sign"), ("no date", "bad_date")]
    stored = {(r.lottery, str(r.fecha)): r.result for r in table.read().collect()}
    assert stored == {("A", "2024-01-10"): 1, ("A", "2024-01-11"): 3, ("DONE", "2024-06-01"): 1, ("B LUNA", "2024-01-01"): 7}
    again, _ = U.update(table, pages, names, td.signos(spark), "2024-06-02", 0)       # a replay
    assert {r.lottery: r.inserted for r in again.collect()}["TOTAL"] == 0 and table.read().count() == 4


def test_no_pages(spark, table):
    pages = spark.createDataFrame([], "page_id long, lottery string, html string")
    report, rejected = U.update(table, pages, spark.createDataFrame([(1, "A")], "id int, nombre string"), td.signos(spark),
                                "2024-06-02", 0)
    assert [(r.lottery, r.read) for r in report.collect()] == [("TOTAL", 0)] and rejected.count() == 0
    assert table.read().count() == 2


def test_upsert_counts_are_observed_on_the_write(spark):
    old = spark.createDataFrame([(_d("2024-01-01"), "A", 1, "LEO", 1), (_d("2024-01-02"), "A", 2, "LEO", 2)], SCHEMA)
    new = spark.createDataFrame([(_d("2024-01-02"), "A", 3, "LEO", 3), (_d("2024-01-02"), "A", 4, "LEO", 4),
                                 (_d("2024-01-03"), "A", 5, "LEO", 5)], SCHEMA)
    merged, seen = CT.upsert_observed(old, new, ["fecha", "lottery"], ["k"])
    rows = store(merged, "t")
    assert seen.get == {"affected": 3, "inserted": 1, "replaced": 1}
    assert sorted(r.result for r in rows.collect()) == [1, 4, 5]
    plain = CT.upsert(old, new, ["fecha", "lottery"], ["k"])
    assert rows.exceptAll(plain).count() == 0 and plain.exceptAll(rows).count() == 0


def test_bulk_load_looks_each_row_up_once(spark):
    new = spark.createDataFrame([(_d("2024-01-01"), "A", 1, "LEO", 1), (None, "A", 1, "LEO", 2), (_d("2024-01-02"), "A", 1, "XXX", 3),
                                 (_d("2024-01-01"), "A", 2, "LEO", 4), (_d("2024-01-05"), "Z", 2, "LEO", 5)], SCHEMA)
    fact = spark.createDataFrame([(_d("2023-01-01"), 1, 1, 5)], "fecha date, loteria_id int, result int, signo_id int")
    lots = spark.createDataFrame([(1, "A")], "id int, nombre string")
    merged, report = CT.bulk_load(fact, new, lots, td.signos(spark))
    got = {r.lottery: (r.read, r.rejected, r.inserted, r.skipped) for r in report.collect()}
    assert got == {"A": (4, 1, 1, 2), "Z": (1, 1, 0, 0), "TOTAL": (5, 2, 1, 2)}
    assert merged.count() == 2
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "codigo" not in plan and "nombre" not in plan


def test_update_makes_the_draws_once(spark, monkeypatch):
    from drawseries.plans import q_catalog
    from drawseries.sources import testdata as td
    made = []
    real = td.draws
    monkeypatch.setattr(td, "draws", lambda *a: made.append(a) or real(*a))
    _report, _rejected, table = q_catalog._update(spark, "/root/testdata/sf0.001")
    assert table.read().count() > 0 and len(made) == 1

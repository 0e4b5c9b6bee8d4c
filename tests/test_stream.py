"""K1: any cut of the input into micro-batches gives the batch upsert result; the
copy-on-write table shares untouched files, survives crashes and replays."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from drawseries.operators.catalog import dedupe_last, upsert
from drawseries.session import ensure_checkpoint_dir
from drawseries.sources import testdata as td
from drawseries.sources.cow import CowTable
from drawseries.streaming.ingest import ingest_stream, start_table

from .conftest import SF_SMALL

COLS = ["fecha", "lottery", "result", "series", "k"]
SCHEMA = "fecha date, lottery string, result int, series string, k long"


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/t_stream_{uuid.uuid4().hex}"


@pytest.mark.parametrize("files,per_trigger", [(1, 1), (4, 1), (5, 2)])
def test_stream_equals_batch(spark, files, per_trigger):
    root = _root(spark)
    new = td.raw_new(spark, SF_SMALL)
    # shuffled cut: files hold arbitrary arrival ranges, so late rows occur
    new.repartition(files, F.xxhash64("k")).write.parquet(f"{root}/source")
    old = dedupe_last(td.raw_old(spark, SF_SMALL), ["fecha", "lottery"], ["k"])
    table = start_table(old, f"{root}/table")
    got = ingest_stream(spark, f"{root}/source", new.schema, table, f"{root}/_ckpt", max_files_per_trigger=per_trigger)
    want = upsert(old, new, ["fecha", "lottery"], ["k"])
    assert got.select(COLS).exceptAll(want.select(COLS)).count() == 0
    assert want.select(COLS).exceptAll(got.select(COLS)).count() == 0


def _row(day, lottery, result, k):
    return (dt.date.fromisoformat(day) if day else None, lottery, result, "LEO", k)


def _table(spark, rows, **kw):
    t = CowTable(spark, _root(spark), **kw)
    t.start(spark.createDataFrame(rows, SCHEMA))
    return t


def _rows(df):
    return sorted([tuple(r) for r in df.select(COLS).collect()], key=str)


OLD = [_row("2020-01-05", "A", 1, 1), _row("2021-01-05", "A", 2, 2), _row("2020-01-05", "B", 3, 3), _row(None, None, 4, 4)]


def test_untouched_parts_are_shared(spark):
    t = _table(spark, OLD)
    first = t.snapshot()
    counts = t.merge(spark.createDataFrame([_row("2021-01-05", "A", 9, 9), _row("2021-02-01", "A", 8, 8)], SCHEMA), 0)
    second = t.snapshot()
    changed = {p for p in second.parts if second.parts[p] != first.parts.get(p)}
    assert counts == {"read": 2, "inserted": 1, "updated": 1, "stale": 0, "affected": 2}
    assert changed == {"A".encode().hex() + "-2021"} and len(first.parts) == 4
    assert _rows(t.read()) == sorted([OLD[0], OLD[2], OLD[3], _row("2021-01-05", "A", 9, 9), _row("2021-02-01", "A", 8, 8)], key=str)
    assert _rows(t.read(version=0)) == sorted(OLD, key=str)
    assert _rows(t.read(lottery="B")) == [OLD[2]]


def test_replay_changes_nothing_and_late_rows_lose(spark):
    t = _table(spark, OLD)
    batch = spark.createDataFrame([_row("2020-01-05", "A", 7, 70), _row("2020-01-05", "A", 6, 60), _row(None, None, 5, 50)], SCHEMA)
    assert t.merge(batch, 0)["updated"] == 2
    before = (t.versions(), t.snapshot(), _rows(t.read()))
    assert t.merge(batch, 0) is None
    assert (t.versions(), t.snapshot(), _rows(t.read())) == before
    late = t.merge(spark.createDataFrame([_row("2020-01-05", "A", 5, 65), _row(None, None, 3, 51)], SCHEMA), 1)
    assert late == {"read": 2, "inserted": 0, "updated": 1, "stale": 1, "affected": 2}
    got = _rows(t.read())
    assert _row("2020-01-05", "A", 7, 70) in got and _row(None, None, 3, 51) in got and len(got) == 4
    assert t.merge(spark.createDataFrame([], SCHEMA), 2)["read"] == 0 and _rows(t.read()) == got


def test_crash_before_the_manifest_leaves_the_old_version(spark, monkeypatch):
    t = _table(spark, OLD)
    batch = spark.createDataFrame([_row("2020-03-01", "B", 1, 10)], SCHEMA)

    def die(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(CowTable, "_commit", die)
        with pytest.raises(RuntimeError):
            t.merge(batch, 0)
    assert t.versions() == [0] and _rows(t.read()) == sorted(OLD, key=str)
    assert len(t._names("data")) == 2                   # the dead writer's files lie about
    assert t.merge(batch, 0)["inserted"] == 1 and len(_rows(t.read())) == 5
    gone = t.vacuum()
    assert t.versions() == [1] and len(gone) == 2       # the dead writer's and the replaced part of B
    assert len(_rows(t.read())) == 5


def test_stored_rows_are_not_shuffled(spark):
    t = _table(spark, [_row(f"20{y:02d}-01-{d:02d}", lot, d, y) for y in range(10, 20) for d in range(1, 20) for lot in "AB"])
    snap = t.snapshot()
    from drawseries.session import store
    new = store(t._with_part(spark.createDataFrame([_row("2015-01-03", "A", 1, 99)], SCHEMA).withColumn("_src", F.lit(1))), "n")
    stays, _known, touched = t.plan_merge(new, snap)
    assert touched == ["A".encode().hex() + "-2015"]
    plan = stays._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert stays.inputFiles() and all("part=41-2015" in f for f in stays.inputFiles() if "/data/" in f)


def test_two_writers_do_not_overwrite(spark):
    t = _table(spark, OLD)
    snap = t.snapshot()
    t.merge(spark.createDataFrame([_row("2020-03-01", "B", 1, 10)], SCHEMA), 0)
    from drawseries.sources.cow import Snapshot
    with pytest.raises(FileExistsError):
        t._commit(Snapshot(snap.version + 1, 0, {}), t.schema())

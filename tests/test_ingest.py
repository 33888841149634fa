"""Ingest runs: exclusive, all or nothing, audited by footers."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.sources import ingest, lake

AT, EPOCH = dt.datetime(2026, 8, 4, 12), 1_785_844_800


def broker_bars(spark, n, close=2.5, days=1):
    rows = [(EPOCH + 60 * i + 86_400 * d, 2.0, 3.0, 1.0, close, 7, 1, 0) for d in range(days) for i in range(n)]
    return spark.createDataFrame(rows, "time long, open double, high double, low double, close double, tick_volume long, spread int, real_volume long")


def run(spark, root, n=4, close=2.5, days=1, **options):
    return ingest.ingest({"m1": broker_bars(spark, n, close, days), "h1": broker_bars(spark, 1, close, days)}, root, "SYN", AT, AT + dt.timedelta(days=days), **options)


def state(spark, root):
    return {k: sorted(map(tuple, lake.read_lake(spark, root, k, "SYN").select("timestamp_utc", "close").collect())) for k in ("m1", "h1")}


def test_days_are_replaced_whole(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    assert [(r.kind, r.rows, len(r.days)) for r in run(spark, root, 4, days=3)] == [("m1", 12, 3), ("h1", 3, 3)]
    assert [r.rows for r in run(spark, root, 2, close=2.75)] == [2, 1]  # the first day alone
    got = state(spark, root)
    assert [len(got["m1"]), len(got["h1"])] == [10, 3] and sorted({c for _, c in got["m1"]}) == [2.5, 2.75]
    assert sorted(os.listdir(f"{tmp_path}/lake")) in (["_replaced", "_staging", "h1", "m1"], ["h1", "m1"], ["_staging", "h1", "m1"]) and not os.path.exists(f"{tmp_path}/lake/.ingest.lock")
    assert not [f for d, _, fs in os.walk(f"{tmp_path}/lake/_staging") for f in fs] and not [f for d, _, fs in os.walk(f"{tmp_path}/lake/_replaced") for f in fs]


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    run(spark, root)
    before, found = state(spark, root), []

    def other():
        try:
            run(spark, root, close=2.25)
        except RuntimeError as e:
            found.append(e)

    with ingest.exclusive(spark, root):
        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert len(found) == 1 and state(spark, root) == before
    (tmp_path / "lake/.ingest.lock").write_text("of another process")
    for options in ({}, {"stale_after": dt.timedelta(hours=1)}):
        with pytest.raises(RuntimeError, match="another ingest run"):
            run(spark, root, close=2.25, **options)
    assert (tmp_path / "lake/.ingest.lock").read_text() == "of another process" and state(spark, root) == before


def test_stale_lock_is_taken_over(spark, tmp_path):
    root, lock = f"file://{tmp_path}/lake", tmp_path / "lake/.ingest.lock"
    lock.parent.mkdir()
    lock.write_text("left behind")
    os.utime(lock, (1_000_000_000, 1_000_000_000))
    with pytest.raises(RuntimeError):
        run(spark, root)
    assert run(spark, root, stale_after=dt.timedelta(hours=1))[0].rows == 4 and not lock.exists()
    assert not [f for f in os.listdir(tmp_path / "lake") if f.startswith(".ingest.lock.") and not f.endswith(".crc")]


def test_failed_runs_leave_the_lake_as_it_was(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/lake"
    run(spark, root, days=2)
    before = state(spark, root)

    def failing(*a):
        raise AssertionError("audit")

    with monkeypatch.context() as m:
        m.setattr(ingest, "audit", failing)
        with pytest.raises(AssertionError):
            run(spark, root, close=2.25, days=2)
    assert state(spark, root) == before
    with pytest.raises(RuntimeError, match="no h1 rows"):  # m1 is staged already
        ingest.ingest({"m1": broker_bars(spark, 3, 2.25), "h1": broker_bars(spark, 1).where("time < 0")}, root, "SYN", AT, AT + dt.timedelta(days=1))
    with pytest.raises(ValueError):
        ingest.ingest({"m2": broker_bars(spark, 1)}, root, "SYN", AT, AT)
    with pytest.raises(ValueError):
        ingest.ingest({}, root, "SYN", AT, AT)
    move, calls = ingest._Files.move, []

    def breaking(self, a, b):
        calls.append(b)
        if len(calls) == 6:  # in the middle of the swap
            raise OSError("disk")
        move(self, a, b)

    with monkeypatch.context() as m:
        m.setattr(ingest._Files, "move", breaking)
        with pytest.raises(OSError):
            run(spark, root, close=2.25, days=2)
    spark.catalog.refreshByPath(root)
    assert len(calls) > 6 and state(spark, root) == before and not (tmp_path / "lake/.ingest.lock").exists()
    assert run(spark, root, close=2.25, days=2)[0].rows == 8


def test_file_index_and_audit_from_footers(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    run(spark, root, 5, days=3)
    period = cal.Period(dt.date(2026, 8, 4), dt.date(2026, 8, 6))
    files = lake.stored_files(spark, root, "m1", "SYN", period)
    assert "FileScan" not in files._jdf.queryExecution().toString()  # no table is read
    rows = files.collect()
    assert sum(r.rows for r in rows) == 10 and min(r.first_utc for r in rows) == AT and max(r.last_utc for r in rows) == AT + dt.timedelta(days=1, minutes=4)
    assert all(r.bytes == os.path.getsize(r.file.removeprefix("file://")) for r in rows)
    assert lake.stored_files(spark, root, "m1", "NONE").count() == 0
    one = spark.read.parquet(f"{root}/m1").where("day = 4").select(F.col("timestamp_utc"), *[F.col(c).cast("float") for c in ("open", "high", "low", "close")], "volume", "spread", "real_volume")
    one.coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{root}/m1/symbol=SYN/year=2026/month=8/day=9")
    with pytest.raises(AssertionError, match="another type"):  # one file among others
        lake.audit(spark, root, "m1", "SYN")
    found = lake.audit_counters(spark, root, "m1", "SYN").first()
    assert (found.rows, found.another_type, found.another_codec, found.absent) == (20, 4, 0, 0)

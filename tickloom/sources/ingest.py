"""Ingest runs: one at a time on a lake, all of a run or nothing of it.

A run takes the lake's lock, writes each kind below a staging folder of its own, audits what it wrote there, and only then
moves the day partitions into place; if that fails midway, the days that were there before come back. Staging and lock
names begin with an underscore or a dot, which readers of the lake pass over. All file work goes through the Hadoop file
system of the lake's path. Moves are renames: swift and whole on HDFS and local disks; on an object store without renames
keep the lake in a table format instead.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import threading
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.calendar import between_utc
from tickloom.sources.lake import SCHEMAS, audit, bars_from_broker, ticks_from_broker, write_lake

LOCK_NAME = ".ingest.lock"
_here = threading.Lock()


@dataclass(frozen=True)
class IngestRecord:
    kind: str
    rows: int
    days: tuple[str, ...]  # the partitions, below the kind's folder
    from_utc: dt.datetime
    to_utc: dt.datetime


class _Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def create(self, p: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        try:
            out = self.fs.create(self.path(p), False)
        except Exception as e:  # py4j wraps the Java error
            if self.fs.exists(self.path(p)):
                return False
            raise OSError(f"cannot create {p}") from e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, p: str) -> str:
        source = self.fs.open(self.path(p))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if self.exists(b) or not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def days(self, folder: str) -> list[str]:
        found = self.fs.globStatus(self.path(f"{folder}/symbol=*/year=*/month=*/day=*"))
        return sorted("/".join(s.getPath().toString().split("/")[-4:]) for s in found)


@contextlib.contextmanager
def exclusive(spark: SparkSession, root: str, stale_after: dt.timedelta | None = None) -> Iterator[None]:
    """Hold the lock of a lake; RuntimeError if another run has it, in this process or elsewhere.

    A lock older than `stale_after` counts as left behind by a run that died and is taken over; by default none does.
    """
    if not _here.acquire(blocking=False):
        raise RuntimeError("an ingest run is under way in this process")
    try:
        files, lock, own = _Files(spark, root), f"{root}/{LOCK_NAME}", f"{uuid.uuid4().hex} {dt.datetime.now(dt.timezone.utc).isoformat()}"
        files.fs.mkdirs(files.path(root))
        if not files.create(lock, own):
            age = dt.datetime.now().timestamp() - files.fs.getFileStatus(files.path(lock)).getModificationTime() / 1000
            if stale_after is None or age <= stale_after.total_seconds():
                raise RuntimeError(f"another ingest run holds {lock}, or left it behind {age:.0f} s ago")
            left = files.read(lock)
            aside = f"{lock}.{uuid.uuid4().hex}"
            files.move(lock, aside)  # of two that find it stale, one moves it
            if files.read(aside) != left or not files.create(lock, own):
                raise RuntimeError(f"another ingest run has taken {lock}")
            files.delete(aside)
        try:
            if files.read(lock) != own:  # where creation is not exclusive, the last writer has it
                raise RuntimeError(f"another ingest run has taken {lock}")
            yield
        finally:
            if files.exists(lock) and files.read(lock) == own:
                files.delete(lock)
    finally:
        _here.release()


def _swap(files: _Files, root: str, staging: str, kinds: Mapping[str, list[str]], old: str) -> None:
    """Move staged days into place and those they replace to `old`; undo all of it if one fails."""
    undo: list[tuple[str, str]] = []
    try:
        for kind, days in kinds.items():
            for day in days:
                place = f"{root}/{kind}/{day}"
                if files.exists(place):
                    files.move(place, f"{old}/{kind}/{day}")
                    undo.append((f"{old}/{kind}/{day}", place))
                files.move(f"{staging}/{kind}/{day}", place)
                undo.append((place, f"{staging}/{kind}/{day}"))
    except OSError:
        for now, before in reversed(undo):
            files.move(now, before)
        raise


def ingest(raws: Mapping[str, DataFrame], root: str, symbol: str, lo: dt.datetime, hi: dt.datetime, stale_after: dt.timedelta | None = None) -> list[IngestRecord]:
    """Broker rows of each kind in [lo, hi) as day partitions of the lake, replacing those days.

    An unknown kind is a ValueError, a kind without rows in the range or a lake in use a RuntimeError, a failed audit an
    AssertionError; in all these cases, and if Spark fails, the lake stays as it was.
    """
    frames = {k.lower(): df for k, df in raws.items()}
    unknown = sorted(set(frames) - set(SCHEMAS))
    if unknown or not frames:
        raise ValueError(f"unknown kinds {unknown}" if unknown else "no kinds")
    spark = next(iter(frames.values())).sparkSession
    run = uuid.uuid4().hex
    staging, old = f"{root}/_staging/{run}", f"{root}/_replaced/{run}"
    with exclusive(spark, root, stale_after):
        files = _Files(spark, root)
        try:
            out = []
            for kind, raw in frames.items():
                df = between_utc(ticks_from_broker(raw) if kind == "ticks" else bars_from_broker(raw), lo, hi)
                write_lake(df, staging, kind, symbol)
                days = files.days(f"{staging}/{kind}") if files.exists(f"{staging}/{kind}") else []
                if not days:
                    raise RuntimeError(f"no {kind} rows in [{lo}, {hi})")
                out.append(IngestRecord(kind, audit(spark, staging, kind, symbol), tuple(days), lo, hi))
            _swap(files, root, staging, {r.kind: list(r.days) for r in out}, old)
        finally:
            files.delete(staging)
        files.delete(old)
        for r in out:
            spark.catalog.refreshByPath(f"{root}/{r.kind}")
        return out

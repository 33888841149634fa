"""Half-open time ranges, local calendar, sessions (overnight ones too) and closed periods.

Times are NTZ timestamps that mean UTC; local ones are wall-clock NTZ columns made by `local_time`.
"""

from __future__ import annotations

import calendar
import datetime as dt
import math
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

LOCAL_ZONE = "America/Bogota"
BROKER_ZONE = "Europe/Athens"  # for display alone
WEEKDAYS = {1: "Monday", 2: "Tuesday", 3: "Wednesday", 4: "Thursday", 5: "Friday", 6: "Saturday", 7: "Sunday"}


def local_time(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def minutes_after(ts: Column | str, n: int) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts) + F.expr(f"INTERVAL {n} MINUTES")


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def iso_weekday(ts: Column | str) -> Column:
    return F.extract(F.lit("dayofweek_iso"), F.col(ts) if isinstance(ts, str) else ts)


def floor_minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def between_utc(df: DataFrame, lo: dt.datetime, hi: dt.datetime, column: str = "timestamp_utc") -> DataFrame:
    """Rows of [lo, hi); the bare column reaches the scan as a pushed filter."""
    literal = lambda t: F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return df.where((F.col(column) >= literal(lo)) & (F.col(column) < literal(hi)))


def weekdays_only(df: DataFrame, local: str = "timestamp_cot") -> DataFrame:
    return df.where(iso_weekday(local) <= 5)


@dataclass(frozen=True)
class SessionWindow:
    """[start, end) in minutes of the local day; an end not after the start is on the next day; full_day: all of it."""

    code: str
    start: int = 0
    end: int = 0
    full_day: bool = False
    zone: str = LOCAL_ZONE

    def __post_init__(self) -> None:
        if not self.full_day and self.start == self.end:
            raise ValueError("a session needs different start and end times")
        if not (0 <= self.start < 1440 and 0 <= self.end < 1440):
            raise ValueError("session times must lie within a day")

    @property
    def crosses_midnight(self) -> bool:
        return not self.full_day and self.end <= self.start

    @property
    def duration(self) -> int:
        return 1440 if self.full_day else (self.end - self.start) % 1440

    def bounds(self, day: dt.date) -> tuple[dt.datetime, dt.datetime]:
        """Local start and end of the session that begins on `day`."""
        start = dt.datetime.combine(day, dt.time(), ZoneInfo(self.zone)) + dt.timedelta(minutes=0 if self.full_day else self.start)
        return start, start + dt.timedelta(minutes=self.duration)

    def bounds_utc(self, day: Column) -> tuple[Column, Column]:
        """The same of a date column, as UTC columns."""
        start = day.cast("timestamp_ntz") + F.expr(f"INTERVAL {0 if self.full_day else self.start} MINUTES")
        to_utc = lambda c: F.convert_timezone(F.lit(self.zone), F.lit("UTC"), c)
        return to_utc(start), to_utc(start + F.expr(f"INTERVAL {self.duration} MINUTES"))


#: The sessions by name, in minutes of the local day.
SESSIONS = {
    "asia": SessionWindow("asia", 19 * 60, 23 * 60),
    "london": SessionWindow("london", 2 * 60, 5 * 60),
    "new_york": SessionWindow("new_york", 7 * 60, 10 * 60),
    "full_day": SessionWindow("full_day", full_day=True),
}


def parse_minute(text: str) -> int:
    """Minutes of the day of HH:MM."""
    try:
        hour, minute = (int(x) for x in text.split(":"))
        return dt.time(hour, minute).hour * 60 + minute
    except ValueError as e:
        raise ValueError(f"not a time of day: {text!r}") from e


def resolve_session(code: str = "new_york", start: str | None = None, end: str | None = None) -> SessionWindow:
    if code == "custom":
        if start is None or end is None:
            raise ValueError("a custom session needs start and end")
        return SessionWindow("custom", parse_minute(start), parse_minute(end))
    if code not in SESSIONS:
        raise ValueError(f"unknown session {code!r}")
    return SESSIONS[code]


def in_session(session: SessionWindow, local: str = "timestamp_cot") -> Column:
    if session.full_day:
        return F.lit(True)
    m = minute_of_day(local)
    return ((m >= session.start) | (m < session.end)) if session.crosses_midnight else ((m >= session.start) & (m < session.end))


def session_date(session: SessionWindow, local: str = "timestamp_cot") -> Column:
    """The date on which the session of a time began."""
    day = F.to_date(local)
    return F.when(minute_of_day(local) < session.end, F.date_sub(day, 1)).otherwise(day) if session.crosses_midnight else day


def add_session_columns(df: DataFrame, session: SessionWindow, local: str = "timestamp_cot", position: str | None = None) -> DataFrame:
    """session_code, session_date (from `local`), minute_of_session and session_progress (from `position`, else `local`)."""
    minute = F.pmod(minute_of_day(position or local) - (0 if session.full_day else session.start), F.lit(1440))
    return df.withColumns({
        "session_code": F.lit(session.code), "session_date": session_date(session, local),
        "minute_of_session": minute.cast("short"), "session_progress": minute / F.lit(float(session.duration))})


def filter_session(df: DataFrame, session: SessionWindow, local: str = "timestamp_cot") -> DataFrame:
    return add_session_columns(df.where(in_session(session, local)), session, local)


def filter_observations(df: DataFrame, session: SessionWindow) -> DataFrame:
    """Membership and date by a bar's open, position by its close."""
    return add_session_columns(df.where(in_session(session)), session, position="observation_time_cot")


def add_time_features(df: DataFrame, local: str = "timestamp_cot") -> DataFrame:
    minute = minute_of_day(local)
    angle = minute * F.lit(2 * math.pi / 1440)
    return df.withColumns({
        "minute_of_day": minute.cast("short"), "iso_weekday": iso_weekday(local).cast("byte"), "time_sin": F.sin(angle), "time_cos": F.cos(angle),
        "day_of_year": F.dayofyear(local).cast("short"), "month": F.month(local).cast("byte")})


def zone_table(df: DataFrame, ts: str = "timestamp_utc", zones: tuple[str, ...] = (LOCAL_ZONE, BROKER_ZONE)) -> DataFrame:
    """Hours ahead of UTC and whether clocks are on summer time, for each date and zone."""
    days = df.select(F.to_date(ts).alias("date")).distinct()
    noon = F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    winter = F.make_date(F.year("date"), F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    hours = lambda zone, t: (F.unix_seconds(local_time(t, zone).cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))) / 3600
    parts = [days.select("date", F.lit(z).alias("zone"), hours(z, noon).alias("offset_hours"), (hours(z, noon) != hours(z, winter)).alias("summer_time")) for z in zones]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Period:
    """[start, end) in local dates."""

    start: dt.date
    end: dt.date
    zone: str = LOCAL_ZONE

    @property
    def bounds_utc(self) -> tuple[dt.datetime, dt.datetime]:
        at = lambda d: dt.datetime.combine(d, dt.time(), ZoneInfo(self.zone)).astimezone(dt.timezone.utc)
        return at(self.start), at(self.end)

    def dates(self) -> list[dt.date]:
        return [self.start + dt.timedelta(days=i) for i in range((self.end - self.start).days)]

    def business_days(self) -> int:
        return sum(d.isoweekday() <= 5 for d in self.dates())


def month_end(day: dt.date) -> dt.date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1]) + dt.timedelta(days=1)


def closed_months(first: dt.date, last: dt.date, today: dt.date | None = None) -> Period:
    """The months of first to last, both included; the last must be over."""
    if last < first:
        raise ValueError("the last month lies before the first")
    end = month_end(last)
    if end > (today or dt.date.today()):
        raise ValueError("the month is not over")
    return Period(first.replace(day=1), end)


def day_range_utc(day: dt.date, now: dt.datetime | None = None, zone: str = LOCAL_ZONE) -> tuple[dt.datetime, dt.datetime]:
    """UTC range of a local day; today's ends now, a later day is an error."""
    now = now or dt.datetime.now(dt.timezone.utc)
    lo, hi = Period(day, day + dt.timedelta(days=1), zone).bounds_utc
    if lo > now:
        raise ValueError("the day has not begun")
    return lo, min(hi, now)

"""Deadlines: data must be fresh, and a model must have run, by a time of day in a zone."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ConfigError, RunContext

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_TIME = re.compile(r"^(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*(am|pm)?$", re.I)


def parse_time(value: str | int) -> time:
    """7, '07:00', '7am', '2:30pm'."""
    m = _TIME.match(str(value).strip())
    if not m:
        raise ConfigError(f"{value!r} is no time of day")
    hour, minute, second, half = int(m[1]), int(m[2] or 0), int(m[3] or 0), (m[4] or "").lower()
    if half:
        if not 1 <= hour <= 12:
            raise ConfigError(f"{value!r} is no time of day")
        hour = hour % 12 + (12 if half == "pm" else 0)
    if hour > 23 or minute > 59 or second > 59:
        raise ConfigError(f"{value!r} is no time of day")
    return time(hour, minute, second)


def format_time(t: time) -> str:
    return f"{t.hour % 12 or 12}:{t.minute:02d} {'PM' if t.hour >= 12 else 'AM'}"


def as_list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def applies(day: datetime, day_of_week=None, day_of_month=None) -> bool:
    """Whether the deadline holds on a day: by either filter, or always without one."""
    weekdays, dates = [str(d).lower() for d in as_list(day_of_week)], [int(d) for d in as_list(day_of_month)]
    if unknown := set(weekdays) - set(DAYS):
        raise ConfigError(f"unknown days: {sorted(unknown)}")
    if bad := [d for d in dates if not 1 <= d <= 31]:
        raise ConfigError(f"no days of a month: {bad}")
    if not weekdays and not dates:
        return True
    return DAYS[day.weekday()] in weekdays or day.day in dates


def to_utc(local: datetime, zone: str) -> datetime:
    """A clock reading in a zone as a UTC one without zone; standard time where it is ambiguous or skipped."""
    tz = ZoneInfo(zone)
    early, late = local.replace(tzinfo=tz, fold=0), local.replace(tzinfo=tz, fold=1)
    # fold=1 is standard time for a repeated hour; of a skipped hour fold=0 has the offset before the change.
    repeated = early.utcoffset() > late.utcoffset()
    return (late if repeated else early).astimezone(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class Deadline:
    day_start: datetime
    day_end: datetime
    deadline: datetime
    passed: bool
    applies: bool
    text: str


def deadline(ctx: RunContext, sla_time: str | int, zone: str, day_of_week=None, day_of_month=None) -> Deadline:
    """Today's deadline in a zone, in UTC, for a run's clock."""
    local = ctx.now.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
    t = parse_time(sla_time)
    due = to_utc(datetime.combine(local.date(), t), zone)
    return Deadline(
        to_utc(midnight, zone), to_utc(midnight + timedelta(days=1), zone), due, ctx.now > due, applies(local, day_of_week, day_of_month), f"{format_time(t)} {zone}"
    )


def data_freshness(df: DataFrame, timestamp: str, due: Deadline, where: str | None = None) -> DataFrame:
    """One row (status, is_failure, latest, sla_deadline): DATA_FRESH, DATA_STALE or NO_DATA.

    Stale data only fails once the deadline has passed on a day it holds.
    """
    rows = df.where(where) if where else df
    latest = rows.agg(F.max(F.expr(timestamp).cast("timestamp_ntz")).alias("latest"))
    status = (
        F.when(F.col("latest").isNull(), "NO_DATA").when(F.col("latest") >= F.lit(due.day_start).cast("timestamp_ntz"), "DATA_FRESH").otherwise("DATA_STALE")
    )
    fails = F.lit(due.applies and due.passed)
    return latest.select(
        status.alias("status"), ((status != "DATA_FRESH") & fails).alias("is_failure"), "latest", F.lit(due.deadline).cast("timestamp_ntz").alias("sla_deadline")
    )


def execution(runs: DataFrame, model: str, due: Deadline) -> DataFrame:
    """One row (status, is_failure, first_success, runs): MET_SLA, MISSED_SLA, ALL_FAILED or NOT_RUN.

    runs: (unique_id, status, completed_at timestamp_ntz) of a day; one conditional aggregate.
    """
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    today = runs.where((F.col("unique_id") == model) & (F.col("completed_at") >= lit(due.day_start)) & (F.col("completed_at") < lit(due.day_end)))
    good = F.col("status") == "success"
    seen = today.agg(F.count(F.lit(1)).alias("runs"), F.min(F.when(good, F.col("completed_at"))).alias("first_success"))
    status = (
        F.when(F.col("runs") == 0, "NOT_RUN").when(F.col("first_success").isNull(), "ALL_FAILED").when(F.col("first_success") <= lit(due.deadline), "MET_SLA").otherwise("MISSED_SLA")
    )
    fails = F.lit(due.applies and due.passed)
    return seen.select(status.alias("status"), ((status != "MET_SLA") & fails).alias("is_failure"), "first_success", "runs")

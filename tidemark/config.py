"""What a check is configured with: layered resolution, defaults, validation and derived periods."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import datetime
from typing import Any

# The defaults that results depend on.
DEFAULTS: dict[str, Any] = {
    "days_back": 14,
    "anomaly_sensitivity": 3,
    "backfill_days": 2,
    "anomaly_direction": "both",
    "fail_on_zero": False,
    "ignore_small_changes": {"spike_failure_percent_threshold": None, "drop_failure_percent_threshold": None},
    "anomaly_exclude_metrics": None,
    "max_int": 2147483647,
    "test_sample_row_count": 5,
    "store_result_rows_in_own_table": True,
    "calculate_failed_count": True,
    "force_metrics_backfill": False,
    "upload_artifacts_method": "diff",
    "columns_upload_strategy": "enriched_only",
    "disable_samples_on_pii_tags": False,
    "pii_tags": ["pii"],
    "enable_samples_on_show_sample_rows_tags": False,
    "show_sample_rows_tags": ["show_sample_rows"],
    "disable_model_alerts": False,
    "disable_test_alerts": False,
    "disable_skipped_model_alerts": True,
    "disable_skipped_test_alerts": True,
}
PERIODS = ("hour", "day", "week", "month")
SEASONALITIES = ("day_of_week", "hour_of_day", "hour_of_week")
DIRECTIONS = ("both", "drop", "spike")
#: Days of a period when it is turned into days.
PERIOD_DAYS = {"hour": 1 / 24, "day": 1, "week": 7, "month": 30}


class ConfigError(ValueError):
    """A check cannot run with what it was given."""


@dataclass(frozen=True)
class TimeBucket:
    period: str = "day"
    count: int = 1

    def __post_init__(self):
        if self.period not in PERIODS:
            raise ConfigError(f"time_bucket.period must be one of {', '.join(PERIODS)}, not {self.period!r}")
        if isinstance(self.count, bool) or not isinstance(self.count, int) or self.count <= 0:
            raise ConfigError(f"time_bucket.count must be a positive integer, not {self.count!r}")

    @classmethod
    def of(cls, value: TimeBucket | Mapping | None) -> TimeBucket:
        if value is None or isinstance(value, TimeBucket):
            return value or cls()
        unknown = set(value) - {"period", "count"}
        if unknown or set(value) != {"period", "count"}:
            raise ConfigError(f"time_bucket needs exactly period and count, got {sorted(value)}")
        return cls(value["period"], value["count"])

    @property
    def days(self) -> int:
        return math.ceil(PERIOD_DAYS[self.period] * self.count)


@dataclass(frozen=True)
class TableRef:
    """A monitored table's name; compared in upper case."""

    name: str
    schema: str = ""
    database: str = ""

    @property
    def full_name(self) -> str:
        return ".".join(p.upper() for p in (self.database, self.schema, self.name) if p)


@dataclass(frozen=True)
class CheckConfig:
    table: TableRef
    timestamp_column: str | None = None
    where_expression: str | None = None
    time_bucket: TimeBucket = field(default_factory=TimeBucket)
    days_back: int = 14
    backfill_days: int = 2
    anomaly_sensitivity: float = 3
    anomaly_direction: str = "both"
    seasonality: str | None = None
    fail_on_zero: bool = False
    min_value: float | None = None
    spike_percent: float | None = None
    drop_percent: float | None = None
    anomaly_exclude_metrics: str | None = None
    exclude_final_results: str | None = None
    exclude_detection_period_from_training: bool = False
    detection_delay_hours: int = 0
    dimensions: tuple[str, ...] = ()
    freshness_column: str | None = None
    event_timestamp_column: str | None = None
    update_timestamp_column: str | None = None
    force_metrics_backfill: bool = False
    max_int: int = 2147483647
    collected_by: str | None = None

    @property
    def metric_properties(self) -> str:
        """Part of a metric's identity: with other properties earlier history does not count."""
        out: dict[str, Any] = {
            "timestamp_column": self.timestamp_column,
            "where_expression": self.where_expression,
            "time_bucket": {"period": self.time_bucket.period, "count": self.time_bucket.count} if self.timestamp_column else None,
            "freshness_column": self.freshness_column,
            "event_timestamp_column": self.event_timestamp_column,
            "dimensions": list(self.dimensions) or None,
        }
        if self.collected_by:
            out["collected_by"] = self.collected_by
        return json.dumps(out, sort_keys=True)

    @property
    def dimension(self) -> str | None:
        return "; ".join(self.dimensions) if self.dimensions else None


def as_boolean(value: Any) -> Any:
    """Texts "true" and "false" in any case become booleans, everything else stays."""
    if isinstance(value, str) and value.strip().lower() in ("true", "false"):
        return value.strip().lower() == "true"
    return value


def argument(name: str, test: Mapping | None = None, model: Mapping | None = None, variables: Mapping | None = None) -> Any:
    """A test's own argument, else the model's configuration (of its three places the later wins), else the
    project's variable, else the default."""
    if test and test.get(name) is not None:
        return as_boolean(test[name])
    found = model_config(model or {}).get(name)
    if found is not None:
        return as_boolean(found)
    if variables and variables.get(name) is not None:
        return as_boolean(variables[name])
    return DEFAULTS.get(name)


def model_config(model: Mapping, key: str = "monitoring") -> dict[str, Any]:
    """config.<key>, then config.meta.<key>, then meta.<key> of a model, merged in that order."""
    out: dict[str, Any] = {}
    config = model.get("config") or {}
    for place in (config, config.get("meta") or {}, model.get("meta") or {}):
        out.update(place.get(key) or {})
    return out


def period_days(value: Mapping | None) -> int | None:
    """{'period', 'count'} in whole days, rounded up; None stays."""
    if value is None:
        return None
    bucket = TimeBucket.of(value)
    return math.ceil(PERIOD_DAYS[bucket.period] * bucket.count)


def resolve(
    table: TableRef,
    test: Mapping | None = None,
    model: Mapping | None = None,
    variables: Mapping | None = None,
    need_timestamp: bool = False,
) -> CheckConfig:
    """The configuration of a check from its layers, validated."""
    get = lambda name: argument(name, test, model, variables)
    bucket = TimeBucket.of(get("time_bucket"))
    timestamp = get("timestamp_column")
    if need_timestamp and not timestamp:
        raise ConfigError("timestamp_column is mandatory for this check")
    direction = str(get("anomaly_direction")).lower()
    if direction not in DIRECTIONS:
        raise ConfigError(f"anomaly_direction must be one of {', '.join(DIRECTIONS)}, not {direction!r}")
    sensitivity = get("anomaly_sensitivity")
    if isinstance(sensitivity, bool) or not isinstance(sensitivity, (int, float)) or sensitivity <= 0:
        raise ConfigError("anomaly_sensitivity must be a positive number")
    season = get("seasonality")
    if season is not None:
        season = str(season).lower()
        wanted = ("day", 1) if season == "day_of_week" else ("hour", 1)
        if season not in SEASONALITIES:
            raise ConfigError(f"seasonality must be one of {', '.join(SEASONALITIES)}, not {season!r}")
        if not timestamp:
            raise ConfigError("seasonality needs a timestamp_column")
        if (bucket.period, bucket.count) != wanted:
            raise ConfigError(f"seasonality {season} needs buckets of 1 {wanted[0]}")
    days = period_days(get("training_period")) or get("days_back")
    if season in ("day_of_week", "hour_of_week"):
        days *= 7
    backfill = max(period_days(get("detection_period")) or get("backfill_days"), bucket.days)
    small = get("ignore_small_changes") or {}
    for name in ("spike_failure_percent_threshold", "drop_failure_percent_threshold"):
        v = small.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0):
            raise ConfigError(f"ignore_small_changes.{name} must be a number of at least 0")
    delay = get("detection_delay")
    hours = 0
    if delay:
        if set(delay) != {"period", "count"} or delay["period"] not in ("hour", "day", "week") or delay["count"] < 0:
            raise ConfigError("detection_delay needs a period (hour, day or week) and a count")
        hours = int(delay["count"]) * {"hour": 1, "day": 24, "week": 168}[delay["period"]]
    return CheckConfig(
        table=table,
        timestamp_column=timestamp,
        where_expression=get("where_expression"),
        time_bucket=bucket,
        days_back=int(days),
        backfill_days=int(backfill),
        anomaly_sensitivity=sensitivity,
        anomaly_direction=direction,
        seasonality=season,
        fail_on_zero=bool(get("fail_on_zero")),
        min_value=get("min_value"),
        spike_percent=small.get("spike_failure_percent_threshold"),
        drop_percent=small.get("drop_failure_percent_threshold"),
        anomaly_exclude_metrics=get("anomaly_exclude_metrics"),
        exclude_final_results=get("exclude_final_results"),
        exclude_detection_period_from_training=bool(get("exclude_detection_period_from_training")),
        detection_delay_hours=hours,
        dimensions=tuple(get("dimensions") or ()),
        freshness_column=get("freshness_column"),
        event_timestamp_column=get("event_timestamp_column"),
        update_timestamp_column=get("update_timestamp_column"),
        force_metrics_backfill=bool(get("force_metrics_backfill")),
        max_int=get("max_int"),
    )


def with_changes(config: CheckConfig, **changes: Any) -> CheckConfig:
    known = {f.name for f in fields(config)}
    if unknown := set(changes) - known:
        raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
    return replace(config, **changes)


@dataclass(frozen=True)
class RunContext:
    """The clock and names of one run; every operator takes the time from here."""

    now: datetime
    invocation_id: str = "local"
    execution_id: str = "run"

    @property
    def run_started_at(self) -> datetime:
        return self.now.replace(microsecond=0)

"""The checks by name: each takes a table and options and gives classified scores or failing rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.config import CheckConfig, ConfigError, RunContext, TableRef, resolve
from tidemark.operators import buckets, metrics, scoring, threshold
from tidemark.sources.store import MetricStore


class Monitor:
    """A monitored table with the run it is checked in and, if given, its metric history."""

    def __init__(self, df: DataFrame, table: TableRef, ctx: RunContext, store: MetricStore | None = None, model: Mapping | None = None, variables: Mapping | None = None):
        self.df, self.table, self.ctx, self.store = df, table, ctx, store
        self.model, self.variables = model, variables
        #: Metrics of this run; they become history at its end.
        self.pending: list[DataFrame] = []

    def _config(self, options: dict[str, Any], need_timestamp: bool = False) -> CheckConfig:
        return resolve(self.table, options, self.model, self.variables, need_timestamp)

    def _history(self, config: CheckConfig) -> DataFrame | None:
        if self.store is None:
            return None
        start, _ = buckets.regular_range(config, self.ctx)
        return self.store.history(config.table.full_name, config.metric_properties, start.date())

    def _range(self, config: CheckConfig, history: DataFrame | None, names: list[str]):
        if config.timestamp_column is None:
            return None, None
        if history is None:
            return buckets.regular_range(config, self.ctx)
        known = history.where(history["metric_name"].isin(*names))
        return buckets.incremental_range(config, self.ctx, known)

    def _judge(self, new: DataFrame, history: DataFrame | None, config: CheckConfig) -> DataFrame:
        self.pending.append(new)
        rows = scoring.training_rows(history, new, config, self.ctx)
        return scoring.classify(scoring.anomaly_scores(rows, config, self.ctx), config, self.ctx)

    def table_anomalies(self, kinds: list[str], **options: Any) -> DataFrame:
        config = self._config(options)
        if "freshness" in kinds and not config.timestamp_column:
            raise ConfigError("freshness needs a timestamp_column")
        history = self._history(config)
        start, end = self._range(config, history, kinds)
        return self._judge(metrics.table_metrics(self.df, config, self.ctx, kinds, start, end), history, config)

    def volume_anomalies(self, **options: Any) -> DataFrame:
        return self.table_anomalies(["row_count"], **options)

    def freshness_anomalies(self, **options: Any) -> DataFrame:
        """A late update is the only anomaly; a direction is not taken."""
        options.pop("anomaly_direction", None)
        self._config(options, need_timestamp=True)
        return self.table_anomalies(["freshness"], **options)

    def event_freshness_anomalies(self, event_timestamp_column: str, update_timestamp_column: str | None = None, **options: Any) -> DataFrame:
        options.pop("anomaly_direction", None)
        self._is_time(event_timestamp_column)
        return self.table_anomalies(
            ["event_freshness"],
            event_timestamp_column=event_timestamp_column,
            update_timestamp_column=update_timestamp_column,
            timestamp_column=update_timestamp_column,
            **options,
        )

    def _is_time(self, column: str) -> None:
        names = {f.name.lower(): f.dataType for f in self.df.schema.fields}
        kind = names.get(column.lower())
        if kind is not None and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ConfigError(f"{column} is no timestamp")

    def column_anomalies(self, column: str, monitors: list[str] | None = None, **options: Any) -> DataFrame:
        return self._columns({column: monitors}, options)

    def all_columns_anomalies(self, monitors: list[str] | None = None, exclude_prefix: str | None = None, exclude_regexp: str | None = None, **options: Any) -> DataFrame:
        """All columns' monitors from one scan."""
        config = self._config(options)
        names = metrics.monitored_columns(self.df, exclude_prefix, exclude_regexp, config.dimensions)
        return self._columns(dict.fromkeys(names, monitors), options)

    def _columns(self, columns: dict[str, list[str] | None], options: dict[str, Any]) -> DataFrame:
        config = self._config(options)
        history = self._history(config)
        start, end = self._range(config, history, [m for ms in columns.values() for m in ms or []] or ["null_count"])
        return self._judge(metrics.column_metrics(self.df, config, self.ctx, columns, start, end), history, config)

    def dimension_anomalies(self, dimensions: list[str], **options: Any) -> DataFrame:
        config = self._config({**options, "dimensions": dimensions})
        history = self._history(config)
        start, end = self._range(config, history, ["dimension"])
        return self._judge(metrics.dimension_metrics(self.df, config, self.ctx, start, end, history), history, config)

    def collect_metrics(self, wanted: list[dict], **options: Any) -> DataFrame:
        """Metrics to be stored, never judged; by default of the last 64 days."""
        config = self._config({"days_back": 64, **options})
        history = self._history(config)
        start, end = self._range(config, history, [m.get("name") or m["type"] for m in wanted])
        out = metrics.collected(self.df, config, self.ctx, wanted, start, end, history)
        self.pending.append(out)
        return out

    def volume_threshold(self, warn_threshold_percent: float = 5, error_threshold_percent: float = 10, direction: str = "both", min_row_count: int = 100, **options: Any) -> DataFrame:
        """The verdict on the last bucket; its severity_level is the number of failures."""
        config = self._config(options, need_timestamp=True)
        history = self._history(config)
        start, end = self._range(config, history, ["row_count"])
        new = metrics.table_metrics(self.df, config, self.ctx, ["row_count"], start, end)
        self.pending.append(new)
        rows = new if history is None else history.where("metric_name = 'row_count'").select(*new.columns).unionByName(new)
        verdicts = threshold.volume_threshold(rows, warn_threshold_percent, error_threshold_percent, direction, min_row_count)
        return verdicts.orderBy(verdicts["bucket_end"].desc()).limit(1)

    def finish(self) -> None:
        """Make this run's metrics history: visible to later runs only."""
        if self.store is not None and self.pending:
            out = self.pending[0]
            for p in self.pending[1:]:
                out = out.unionByName(p)
            self.store.add(scoring.latest_by_id(out), self.ctx.now)
        self.pending = []

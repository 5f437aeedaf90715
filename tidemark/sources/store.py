"""Stored metrics, snapshots and results as Parquet tables: append, upsert, delete and replace by key."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut


class Conflict(RuntimeError):
    """Another writer changed the table meanwhile; nothing was changed by this one."""


class ParquetTable:
    """A table of Parquet files below a folder, its partitions in generations, named by a manifest.

    A change writes new generations of the partitions it touches and then a manifest of the folders
    that make up the table, so readers see the old rows or the new ones, never half of them. The
    manifest before is kept with its files, so that whoever has just begun to read it can end. Of
    two writers at once one fails (Conflict), but appends, which do not depend on what is there, try again.
    """

    #: Tokens of past appends that a manifest remembers.
    TOKENS = 100

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by
        self.schema = spark.createDataFrame([], schema).schema
        self.data = f"{self.path}/data"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> dict[int, dict]:
        """The manifests that are whole, by number."""
        fs, home = self._fs(self.path)
        out = {}
        if fs.exists(home):
            for s in fs.listStatus(home):
                name = s.getPath().getName()
                if name.startswith("manifest-"):
                    stream = fs.open(s.getPath())
                    try:
                        text = bytes(stream.readAllBytes()).decode()
                    finally:
                        stream.close()
                    if text.endswith("\n"):
                        out[int(name.split("-")[1])] = json.loads(text)
        return out

    def _current(self) -> tuple[int, dict]:
        manifests = self._manifests()
        number = max(manifests, default=0)
        return number, manifests.get(number, {"folders": [], "tokens": []})

    def _open(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.data}/{f}" for f in folders]
        shape = T.StructType([*self.schema.fields, T.StructField("_generation", T.StringType())])
        return self.spark.read.schema(shape).option("basePath", self.data).parquet(*paths).select(*self.schema.names)

    def read(self) -> DataFrame:
        return self._open(self._current()[1]["folders"])

    def _write(self, df: DataFrame) -> list[str]:
        """The folders, one per partition, of a new generation with these rows."""
        generation = uuid.uuid4().hex
        shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        shaped.withColumn("_generation", F.lit(generation)).write.mode("append").partitionBy(*self.partition_by, "_generation").parquet(self.data)
        fs, found = self._fs("/".join([self.data, *["*"] * len(self.partition_by), f"_generation={generation}"]))
        return ["/".join(s.getPath().toString().split("/")[-len(self.partition_by) - 1 :]) for s in fs.globStatus(found) or []]

    def _publish(self, before: int, folders: list[str], tokens: list[str]) -> None:
        """Make these folders the table, if it is still as it was at manifest `before`; remove what two manifests no longer name."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self._fs(f"{self.path}/manifest-{before + 1:09d}")
        try:
            out = fs.create(target, False)
        except Exception as e:  # noqa: BLE001  the exception's class differs by file system
            if fs.exists(target):
                raise Conflict(self.path) from e
            raise
        out.write(bytearray((json.dumps({"folders": folders, "tokens": tokens[-self.TOKENS :]}) + "\n").encode()))
        out.close()
        manifests = self._manifests()
        kept = {f for n, m in manifests.items() if n >= before for f in m["folders"]}
        for n, m in manifests.items():
            if n < before:
                for f in set(m["folders"]) - kept:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.data}/{f}"), True)
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{n:09d}"), False)

    def append(self, df: DataFrame, token: str | None = None) -> None:
        """Add rows; a batch whose token was appended before is not added again."""
        folders = None
        while True:
            number, now = self._current()
            if token is not None and token in now["tokens"]:
                return
            folders = self._write(df) if folders is None else folders
            try:
                return self._publish(number, now["folders"] + folders, now["tokens"] + [token] * (token is not None))
            except Conflict:
                continue

    def replace(self, df: DataFrame) -> None:
        number, now = self._current()
        self._publish(number, self._write(df), now["tokens"])

    def _rewrite(self, state: tuple[int, dict], touched: DataFrame | None, left: Callable[[DataFrame], DataFrame], more: DataFrame | None) -> None:
        """Write the touched partitions anew, with what left() keeps of them and more; the others stay as they are."""
        number, now = state
        folders, mine = now["folders"], now["folders"]
        if self.partition_by:
            path = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
            none = "__HIVE_DEFAULT_PARTITION__"
            # Partitions are few: each is a folder.
            values = touched.select(*self.partition_by).distinct().collect()
            names = {"/".join(path(p, none if v[p] is None else str(v[p])) for p in self.partition_by) for v in values}
            mine = [f for f in folders if f.rsplit("/", 1)[0] in names]
        out = left(self._open(mine))
        if more is not None:
            out = out.unionByName(more, allowMissingColumns=True)
        gone = set(mine)
        self._publish(number, [f for f in folders if f not in gone] + self._write(out), now["tokens"])

    def delete(self, condition: str) -> None:
        """Rows for which the condition is true go."""
        state = self._current()
        gone = F.coalesce(F.expr(condition), F.lit(False))
        self._rewrite(state, self._open(state[1]["folders"]).where(gone), lambda old: old.where(~gone), None)

    def upsert(self, df: DataFrame, key: str, newest: str) -> None:
        """Rows of new keys are added, of known ones replaced; of several new rows the newest counts.

        Only the partitions that hold such a key, or get one, are written; to find them the keys are read.
        """
        order = W.partitionBy(key).orderBy(F.col(newest).desc_nulls_last())
        once = cut(df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth"))
        self._replace_keys(once.select(key), once, key, False)

    def delete_and_insert(self, keys: DataFrame | None, rows: DataFrame | None, key: str) -> None:
        """Rows whose key is null or among `keys` go, then `rows` come; without keys none goes."""
        if keys is not None:
            self._replace_keys(cut(keys.select(key).distinct()), None if rows is None else cut(rows), key, True)
        elif rows is not None:
            self.append(rows)

    def _replace_keys(self, gone: DataFrame, more: DataFrame | None, key: str, nulls: bool) -> None:
        state, touched = self._current(), None
        named = gone.select(F.col(key).alias("_gone"))
        if self.partition_by:
            there = self._open(state[1]["folders"]).select(key, *self.partition_by)
            lost = there.join(named, F.col(key) == F.col("_gone"), "left_semi")
            if nulls:
                lost = lost.unionByName(there.where(F.col(key).isNull()))
            touched = lost.select(*self.partition_by)
            if more is not None:
                touched = touched.unionByName(more.select(*self.partition_by))
        known = lambda old: old.where(F.col(key).isNotNull()) if nulls else old
        self._rewrite(state, touched, lambda old: known(old).join(named, F.col(key) == F.col("_gone"), "left_anti"), more)

    def count(self) -> int:
        return self.read().count()


METRICS_SCHEMA = (
    "id string, full_table_name string, column_name string, metric_name string, metric_type string, metric_value double, source_value string, "
    "bucket_start timestamp_ntz, bucket_end timestamp_ntz, bucket_duration_hours int, updated_at timestamp_ntz, dimension string, dimension_value string, "
    "metric_properties string, created_at timestamp_ntz, bucket_date date"
)


class MetricStore(ParquetTable):
    """Metric history, partitioned by the day of bucket_end, so that a training period reads its days only."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, METRICS_SCHEMA, ("bucket_date",))

    def add(self, metrics: DataFrame, created_at) -> None:
        stamped = metrics.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")).withColumn("bucket_date", F.to_date("bucket_end"))
        self.append(stamped)

    def history(self, table: str, properties: str, since=None) -> DataFrame:
        out = self.read().where((F.upper("full_table_name") == table.upper()) & (F.col("metric_properties") == properties))
        if since is not None:  # reads the folders of these days only
            out = out.where(F.col("bucket_date") >= F.lit(since).cast("date"))
        return out

"""Session, checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import itertools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; rows here are narrow (keys and a few numbers).
BROADCAST_ROWS = 50_000
SALTS = 16
#: Bytes of a table up to which spread() moves it.
SPREAD_BYTES = 32_000_000


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where none is named and all work is done on this machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there (survives lost executors).

    A written table rather than checkpoint(): a checkpointed plan keeps the estimated size of its
    origin, which joins multiply, so in iterations the estimate itself grows beyond all memory. The
    application's tables are deleted when it ends.
    """
    spark = df.sparkSession
    home = f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_delete, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_CUTS) % 8 == 0:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut() and aggregates of the rows, taken while they are written, so that no job of its own counts them."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()]))
    got = seen.get
    if set(got) != set(measures):  # an empty plan is not observed
        got = out.agg(*[F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()]).first().asDict()
    return out, got


def spread(df: DataFrame) -> DataFrame:
    """A table of few bytes over as many tasks as there are cores, for work that costs far more than to move it: a small
    file is one row group, and so one task. Larger ones stay as they are read."""
    # What is read, not what Catalyst guesses to be left of it.
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def release(spark: SparkSession) -> None:
    """Let go of plans that are done: the cleaner then removes their shuffle files and broadcasts, which in
    long iterations would stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HOMES: set[str] = set()
_CUTS = itertools.count(1)


def _delete(spark: SparkSession, home: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(home)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110  the session is already gone
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that do not clash with those of df (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def join_lookup(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", rows_bound: int | None = None
) -> DataFrame:
    """Join rows with a lookup that has one row per key; null keys match null keys.

    The lookup is counted (pass one that is cheap to compute or was cut()). Up to BROADCAST_ROWS it
    is broadcast; beyond that both sides are shuffled on the keys and a salt, so that a key that
    holds a third of all rows is spread over SALTS tasks, against SALTS copies of the lookup row.
    """
    known = lookup.count() if rows_bound is None else rows_bound
    mine = {k: f"_lookup_{i}" for i, k in enumerate(keys)}
    right = lookup.select(*[F.col(k).alias(v) for k, v in mine.items()], *[c for c in lookup.columns if c not in keys])
    if known <= BROADCAST_ROWS:
        on = [F.col(k).eqNullSafe(F.col(v)) for k, v in mine.items()]
        return rows.join(F.broadcast(right), on, how).drop(*mine.values())
    (salt,) = fresh(rows, "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in mine.items()] + [F.col(salt) == F.col("_lookup_salt")]
    return left.join(right.hint("merge"), on, how).drop(salt, "_lookup_salt", *mine.values())

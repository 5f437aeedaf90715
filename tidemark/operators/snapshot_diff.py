"""What changed between consecutive full snapshots: a streamed merge of sorted ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANGES = "entity string, day date, member string, change_kind string, old string, new string"
_SCHEMA = pa.schema(
    [("entity", pa.string()), ("day", pa.date32()), ("member", pa.string()), ("change_kind", pa.string()), ("old", pa.string()), ("new", pa.string())]
)


def snapshot_rows(df: DataFrame, entity: Column, day: Column, member: Column, value: Column) -> DataFrame:
    """(entity, day, member, value), one row per member of a snapshot.

    Rows without entity, day or member are left out. Repeated rows of a member within a snapshot
    count once; of several values the largest non-null one stands.
    """
    return (
        df.select(entity.alias("entity"), day.alias("day"), member.alias("member"), value.alias("value"))
        .filter(F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("member").isNotNull())
        .groupBy("entity", "day", "member")
        .agg(F.max("value").alias("value"))
    )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(entity, day, member, change_kind, old, new) between each snapshot and the entity's one before.

    change_kind: 'added', 'removed', or 'changed' where both values are known and differ. An entity's
    first snapshot has no changes. Every row is sent to the merge twice, as a member of its own day
    and as a candidate for the entity's next day; both streams are partitioned by ranges of
    (entity, day, member) and sorted, and each range is merged in one pass that holds one batch. A
    large entity spans many ranges; no group is ever collected.
    """
    days = rows.select("entity", "day").distinct()
    span = W.partitionBy("entity").orderBy("day")
    steps = days.select(
        F.col("entity").alias("_entity"),
        F.col("day").alias("_day"),
        F.lead("day").over(span).alias("next_day"),
        F.lag("day").over(span).isNotNull().alias("has_before"),
    )
    known = rows.join(steps, (F.col("entity") == F.col("_entity")) & (F.col("day") == F.col("_day")))
    sides = F.array(
        F.struct(F.when(F.col("has_before"), F.col("day")).alias("day"), F.lit(1).alias("side")),
        F.struct(F.col("next_day").alias("day"), F.lit(0).alias("side")),
    )
    stream = (
        known.select("entity", "member", "value", F.explode(sides).alias("s"))
        .select("entity", "s.day", "member", "s.side", "value")
        .filter(F.col("day").isNotNull())
    )
    ranged = stream.repartitionByRange("entity", "day", "member").sortWithinPartitions("entity", "day", "member", "side")
    return ranged.mapInArrow(_merge, CHANGES)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sorted old (side 0) and new (side 1) rows; a key's two rows are neighbours."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        rows = piece if held is None else pa.concat_tables([held, piece])
        # The last row may still meet its partner in the next batch.
        yield from _emit(rows, last=False)
        held = rows.slice(rows.num_rows - 2 if _paired(rows) else rows.num_rows - 1)
    if held is not None:
        yield from _emit(held, last=True)


def _paired(rows: pa.Table) -> bool:
    return bool(rows.num_rows > 1 and _same_as_next(rows.slice(rows.num_rows - 2))[0])


def _same_as_next(rows: pa.Table) -> np.ndarray:
    if rows.num_rows < 2:
        return np.zeros(0, dtype=bool)
    out = np.ones(rows.num_rows - 1, dtype=bool)
    for name in ("entity", "day", "member"):
        column = rows[name].combine_chunks()
        out &= pc.equal(column.slice(0, len(column) - 1), column.slice(1)).to_numpy(zero_copy_only=False)
    return out


def _emit(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    same = _same_as_next(rows)
    end = n if last else n - (2 if n > 1 and same[-1] else 1)
    if end <= 0:
        return
    with_next = np.append(same, False)[:end]
    with_prev = np.insert(same, 0, False)[:end]
    side = rows["side"].to_numpy()[:end]
    value = rows["value"].combine_chunks()
    old, new = value.slice(0, end), pc.take(value, pa.array(np.minimum(np.arange(end) + 1, n - 1)))
    differs = pc.fill_null(pc.not_equal(old, new), False).to_numpy(zero_copy_only=False)
    kind = np.full(end, "", dtype=object)
    kind[~with_next & ~with_prev & (side == 1)] = "added"
    kind[~with_next & ~with_prev & (side == 0)] = "removed"
    kind[with_next & differs] = "changed"
    at = np.flatnonzero(kind != "")
    if not len(at):
        return
    index = pa.array(at)
    kinds = kind[at]
    old_values = pc.if_else(pa.array(kinds == "added"), pa.scalar(None, pa.string()), pc.take(old, index))
    new_values = pc.if_else(
        pa.array(kinds == "removed"),
        pa.scalar(None, pa.string()),
        pc.if_else(pa.array(kinds == "added"), pc.take(old, index), pc.take(new, index)),
    )
    yield pa.RecordBatch.from_arrays(
        [
            pc.take(rows["entity"].combine_chunks(), index).cast(pa.string()),
            pc.take(rows["day"].combine_chunks(), index).cast(pa.date32()),
            pc.take(rows["member"].combine_chunks(), index).cast(pa.string()),
            pa.array(list(kinds), pa.string()),
            old_values,
            new_values,
        ],
        schema=_SCHEMA,
    )

"""Texts into containers of fixed capacity: best-fit decreasing per partition, certified and repacked."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, spread

CAPACITY = 2048
#: A vocabulary file of ranks (base64 token, rank) of a public byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut into pieces before the byte pairs are merged (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one partition packs; a task holds the sizes of one partition.
PARTITION_ITEMS = 50_000
#: Containers fuller than this keep their items when a partition with a gap gives up documents.
KEEP_FILL = 0.995
ASSIGNED = "doc_id bigint, part int, n_tokens int, container string, released boolean"


@cache
def _encoding(digest: str, content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding(digest, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty texts have none. The vocabulary file is read here and sent to the workers."""
    content = Path(vocabulary).read_bytes()
    digest = hashlib.sha256(content).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(digest, shared.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(n, dtype=np.int64)})

    return spread(docs.select("doc_id", "text").filter("doc_id IS NOT NULL")).mapInPandas(count, "doc_id bigint, n_tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item by best-fit decreasing: into the fullest bin that still takes it.

    Open bins are kept by what is left in them, and one bit per rest says which rests there are, so
    an item costs a shift and a lowest bit, not a search.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = there >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = rest[left].pop()
            if not rest[left]:
                there ^= 1 << left
        else:
            left, b = capacity, made
            made += 1
        bins[i] = b
        rest[left - s].append(b)
        there |= 1 << (left - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual-feasible functions of the sizes.

    The plain sum; the function that counts items above capacity - k as whole bins, those above half
    the capacity as they are and small ones below k as nothing, for every k; and the rounding
    functions floor((p + 1) s / capacity) / p for p up to 100.
    """
    return histogram_bound(np.bincount(np.asarray(sizes, dtype=np.int64), minlength=capacity + 1), capacity)


def histogram_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound() from the number of items of each size."""
    h = counts.astype(np.int64)
    h[0] = 0
    s = np.arange(capacity + 1)
    best = -(-int((h * s).sum()) // capacity)
    count, total = np.cumsum(h), np.cumsum(h * s)
    half = capacity // 2
    k = np.arange(0, half + 1)
    top = count[-1] - count[capacity - k]
    middle = count[capacity - k] - count[half]
    middle_sum = total[capacity - k] - total[half]
    small_sum = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    extra = -(-(small_sum - (middle * capacity - middle_sum)) // capacity)
    best = max(best, int((top + middle + np.maximum(0, extra)).max()))
    for p in range(1, 101):
        # In units of 1 / (p capacity): the size itself where (p + 1) s divides by the capacity.
        whole = (p + 1) * s
        u = np.where(whole % capacity == 0, p * s, whole // capacity * capacity)
        best = max(best, -(-int((h * u).sum()) // (p * capacity)))
    return best


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens): a text above the capacity in full pieces and a rest, any other whole."""
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    last = F.greatest(full, F.lit(0)).cast("int")
    size = F.when(F.col("part") < last, capacity).otherwise(F.col("n_tokens") - F.col("part") * capacity)
    return sizes.withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("doc_id", "part", size.cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """(doc_id, part, n_tokens, container) for sizes (doc_id, n_tokens).

    Containers hold at most `capacity`; only texts above that are split, into full pieces and a rest.
    Texts without tokens go into a container like others and take no space. Rows with a null doc_id
    or size are left out; a doc_id given twice is packed twice. An empty table gives an empty result.

    Items are spread over partitions of about `partition_items` by hash and packed there by best-fit
    decreasing. The dual-feasible lower bound certifies the partition's bin count; a partition that
    has more bins than its bound keeps its full containers and gives up the documents of the others.
    Those are pooled, spread anew over fewer partitions, and packed again, until every partition is certified, or the
    pool no longer shrinks; what is then left is packed once more in its partitions. certificate() says
    how far the whole is from its bound. Full pieces fill a container each and are never moved.
    """
    every = cut(pieces(sizes.filter("doc_id IS NOT NULL AND n_tokens >= 0"), capacity))
    alone = every.filter(F.col("n_tokens") == capacity).select(
        "doc_id", "part", "n_tokens", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("container")
    )
    pool, out, before, number = every.filter(F.col("n_tokens") < capacity), alone, None, 0
    while True:
        items = pool.count()
        if not items and number:
            return out
        spread = max(1, -(-items // partition_items))
        last = spread == 1 or before is not None and items >= before
        packed = cut(_pack_round(pool, number, spread, last, capacity))
        out = out.unionByName(packed.filter("NOT released").select("doc_id", "part", "n_tokens", "container"))
        if last:
            return out
        pool, before, number = packed.filter("released").select("doc_id", "part", "n_tokens"), items, number + 1


def _pack_round(pool: DataFrame, number: int, spread: int, last: bool, capacity: int) -> DataFrame:
    place = F.pmod(F.xxhash64(F.lit(number), "doc_id", "part"), F.lit(spread)).cast("int")
    sorted_ = pool.withColumn("place", place).repartition(spread, "place").sortWithinPartitions("place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for place_, rows in batch.groupby("place", sort=True):
                if held and held[0]["place"].iloc[0] != place_:
                    yield from _pack_partition(pd.concat(held), number, last, capacity)
                    held = []
                held.append(rows)
        if held:
            yield from _pack_partition(pd.concat(held), number, last, capacity)

    return sorted_.mapInPandas(run, ASSIGNED)


def _pack_partition(rows: pd.DataFrame, number: int, last: bool, capacity: int) -> Iterator[pd.DataFrame]:
    rows = rows.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True])
    size = rows["n_tokens"].to_numpy(dtype=np.int64)
    bins = best_fit(size, capacity)
    used = int(bins.max()) + 1
    released = np.zeros(len(rows), dtype=bool)
    if not last and used > lower_bound(size, capacity):
        fill = np.bincount(bins, weights=size, minlength=used)
        released = (fill < KEEP_FILL * capacity)[bins]
    place = rows["place"].iloc[0]
    yield pd.DataFrame(
        {
            "doc_id": rows["doc_id"].to_numpy(),
            "part": rows["part"].to_numpy(),
            "n_tokens": size.astype(np.int32),
            "container": [f"{number}-{place}-{b}" for b in bins.tolist()],
            "released": released,
        }
    )


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (items, tokens, containers, lower_bound, fill): the packing against the bound of all sizes.

    The bound needs the sizes' histogram only: capacity + 1 counts, whatever the number of texts.
    """
    containers = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).agg(F.count(F.lit(1)).alias("n"), F.max("fill").alias("most")).first()
    counts = packed.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    h = np.zeros(capacity + 1, dtype=np.int64)
    h[counts["n_tokens"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    items = int(h.sum())
    tokens = int((h * np.arange(capacity + 1)).sum())
    bound = histogram_bound(h, capacity)
    row = (items, tokens, int(containers["n"]), bound, tokens / (containers["n"] * capacity) if containers["n"] else 0.0)
    return packed.sparkSession.createDataFrame([row], "items bigint, tokens bigint, containers bigint, lower_bound bigint, fill double")

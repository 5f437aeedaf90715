"""Parent-child links to full hierarchies by contraction: rake leaves, compress unary chains, expand again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, cut_counting

CYCLE = "cycle"
#: Edges that contraction may leave over for one task to close at once, in blocks of so many of their tops.
LOCAL_EDGES, TOPS = 5_000, 512


def listed_parents(c: Column) -> Column:
    """The entries of a dependency list written as JSON, with single quotes or with blanks; trimmed, lower case.

    Null, blank and empty lists give an empty array.
    """
    entries = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[\"']([^\"']*)[\"']"), 1)
    tidy = F.transform(entries, lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) and (child, parent) from (node, parents array): distinct links whose parent is a node too."""
    ids = nodes.select("node").filter(F.col("node").isNotNull()).distinct()
    pairs = nodes.filter(F.col("node").isNotNull()).select(F.col("node").alias("child"), F.explode("parents").alias("parent")).distinct()
    return ids, pairs.join(_merge(ids.withColumnRenamed("node", "parent")), "parent", "left_semi").select("child", "parent")


def _merge(df: DataFrame) -> DataFrame:
    """Joins here are shuffled: either side grows with the graph, and broadcasts would pile up on the driver."""
    return df.hint("merge")


def _columns(paths: bool) -> list[str]:
    return ["child", "parent", "w", *(["hops"] if paths else [])]


def _lighter(edges: DataFrame, paths: bool, *more: str) -> DataFrame:
    """Parallel edges merged to the longest; `hops` are the nodes after the parent down to the child."""
    best = [F.max("w").alias("w")]
    if paths:
        best.append(F.max_by("hops", F.struct("w", "hops")).alias("hops"))
    return edges.groupBy("child", "parent", *more).agg(*best)


def _follow(edges: DataFrame, pointers: DataFrame, paths: bool, *more: str | Column) -> DataFrame:
    """Edges whose parent has a pointer moved on to where it points; `more` are columns to keep or compute."""
    up = _merge(pointers.select(*[F.col(c).alias(f"u_{c}") for c in pointers.columns]))
    moved = F.col("u_child").isNotNull()
    return edges.join(up, F.col("parent") == F.col("u_child"), "left").select(
        "child",
        F.coalesce("u_parent", "parent").alias("parent"),
        (F.col("w") + F.coalesce("u_w", F.lit(0))).alias("w"),
        *([F.when(moved, F.concat("u_hops", "hops")).otherwise(F.col("hops")).alias("hops")] if paths else []),
        *more,
    )


def _anchors(single: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """(record, looped) of the nodes with a single parent.

    record (child, parent, w[, hops]) ties each to its first ancestor that has not a single parent;
    looped (node) are those that never reach one, as they lie on or below a cycle. Pointers are
    doubled, so a chain of n nodes takes log2(n) joins.
    """
    cols = _columns(paths)
    inner = _merge(single.select(F.col("child").alias("parent")).distinct().withColumn("inner", F.lit(True)))
    pointers = single.join(inner, "parent", "left").select(*cols, F.col("inner").isNull().alias("ended"))
    before = None
    while True:
        ended = F.col("ended") | F.coalesce("u_ended", F.lit(True))
        pointers, seen = cut_counting(_follow(pointers, pointers, paths, ended.alias("ended")), left=F.count_if(~F.col("ended")))
        if seen["left"] == 0:
            return pointers.select(*cols), None
        if seen["left"] == before:
            # No chain ended in this step, so none ends later either: these run round for ever.
            return pointers.filter("ended").select(*cols), pointers.filter("NOT ended").select(F.col("child").alias("node"))
        before = seen["left"]


def _state(edges: DataFrame, paths: bool) -> DataFrame:
    """Edges with n, the number of their child's parents, and leaf, whether it has no children: sums per node,
    combined where the edges are read, so that a child of very many parents is no burden."""
    ends = F.array(F.struct(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("n"), F.max("e.down").alias("inner"))
    return edges.join(_merge(nodes), F.col("child") == F.col("node")).select(*_columns(paths), "n", (F.col("inner") == 0).alias("leaf"))


def hierarchy(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, depth[, path]) for each node and each root it descends from.

    nodes: (node, parents array<string>); a null node is left out, repeated rows and parents count
    once, parents that are no node are ignored. A root has no parents and itself as root at depth 0;
    depth is the number of links on the longest path. path is that path from the root to the node
    (of several the lexicographically last). A node on a cycle or below one has the single row
    (node, 'cycle', -1). An empty table gives an empty result.

    The graph is contracted: in each step its leaves are raked off and its unary chains spliced out,
    both recorded, until nothing is left but roots. A core that does not shrink holds the cycles: its
    nodes are settled from the roots downward as far as that goes, the rest is cyclic. The records
    are then undone last to first (once it is contracted to LOCAL_EDGES edges or fewer, what is left is closed in one task as
    the last record, where no paths are asked for); a node's roots are those of its recorded ancestors, moved by the
    recorded distance, 'cycle' being one of them; at the end whoever has that loses the others. Only
    joins and aggregates keyed by node are used; the driver sees counts, taken while tables are written.
    """
    ids, pairs = links(cut(nodes.select("node", "parents")))
    cols = _columns(paths)
    base = edges = cut(pairs.select("child", "parent", F.lit(1).alias("w"), *([F.array("child").alias("hops")] if paths else [])))
    records: list[DataFrame] = []
    looped: list[DataFrame] = []
    measures = {"edges": F.count(F.lit(1)), "leaves": F.count_if("leaf"), "single": F.count_if(~F.col("leaf") & (F.col("n") == 1))}
    while True:
        state, sizes = cut_counting(_state(edges, paths), **measures)
        if not sizes["leaves"] and not sizes["single"]:
            break
        if records and sizes["edges"] <= LOCAL_EDGES and not paths:
            closed, seen = cut_counting(_closure(state.select(*cols)), cyclic=F.count_if(F.col("parent").isNull()))
            if seen["cyclic"]:
                looped.append(closed.filter("parent IS NULL").select(F.col("child").alias("node")))
            records.append(closed.filter("parent IS NOT NULL"))
            sizes["edges"] = 0
            break
        if sizes["single"]:
            record, loop = _anchors(state.filter("NOT leaf AND n = 1").select(*cols), paths)
            if loop is not None:
                looped.append(loop)
            others = cut(_lighter(_follow(state.filter("leaf OR n > 1"), record, paths, "leaf"), paths, "leaf"))
            # Leaves hang on the anchors too, so both kinds of a step are undone at once.
            records.append(record.unionByName(others.filter("leaf").select(*cols)))
            edges = others.filter("NOT leaf").select(*cols)
        else:
            records.append(state.filter("leaf").select(*cols))
            edges = state.filter("NOT leaf").select(*cols)

    roots = ids.join(_merge(base.select(F.col("child").alias("node")).distinct()), "node", "left_anti")
    start = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if paths else []))
    for loop in looped:
        start = start.unionByName(_cyclic(loop, paths))
    known = cut(start)
    if sizes["edges"]:
        known = _settle_core(known, state.select(*cols), paths)
    for record in reversed(records):
        known = known.unionByName(cut(_expand(record, known, paths)))
    if not looped and not sizes["edges"]:
        return known
    bad = known.filter("depth < 0").select("node").distinct()
    return known.filter("depth >= 0").join(_merge(bad), "node", "left_anti").unionByName(_cyclic(bad, paths))


def _closure(edges: DataFrame) -> DataFrame:
    """(child, parent, w): each node of a small graph with each top above it (a node without parents) and the
    longest distance; (child, null, -1) for those on or below a cycle. One task of bounded size."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"child": [], "parent": [], "w": []}, dtype=object), *batches])
        names, place = np.unique(np.concatenate([rows["child"], rows["parent"]]).astype(str), return_inverse=True)
        child, parent, w = place[: len(rows)], place[len(rows) :], rows["w"].to_numpy(dtype=np.int32)
        above: list[list[int]] = [[] for _ in names]
        below: list[list[int]] = [[] for _ in names]
        for i, (c, p) in enumerate(zip(child.tolist(), parent.tolist())):
            above[c].append(i)
            below[p].append(c)
        waits = [len(x) for x in above]
        tops = [k for k, n in enumerate(waits) if not n]
        order = list(tops)
        for k in order:
            for c in below[k]:
                waits[c] -= 1
                if not waits[c]:
                    order.append(c)
        yield _closed(names, [k for k, n in enumerate(waits) if n], None, -1)
        for a in range(0, len(tops), TOPS):
            some = tops[a : a + TOPS]
            far = np.full((len(names), len(some)), -1, dtype=np.int32)
            far[some, np.arange(len(some))] = 0
            for k in order:
                if above[k]:
                    up = far[parent[above[k]]]
                    far[k] = np.where(up >= 0, up + w[above[k], None], -1).max(axis=0)
            k, j = np.nonzero(far > 0)
            yield _closed(names, k, names[np.array(some)[j]], far[k, j])

    return edges.select("child", "parent", "w").coalesce(1).mapInPandas(close, "child string, parent string, w int")


def _closed(names: np.ndarray, child, parent, w) -> pd.DataFrame:
    some = names[np.asarray(child, dtype=np.int64)].astype(object)
    return pd.DataFrame({"child": some, "parent": pd.Series(parent, index=range(len(some)), dtype=object), "w": pd.Series(w, index=range(len(some)), dtype="int32")})


def _cyclic(nodes: DataFrame, paths: bool) -> DataFrame:
    return nodes.select(
        "node", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"), *([F.expr("CAST(NULL AS array<string>)").alias("path")] if paths else [])
    )


def _expand(record: DataFrame, known: DataFrame, paths: bool) -> DataFrame:
    """Rows of the recorded nodes from those of their recorded ancestors."""
    up = record.join(_merge(known.withColumnRenamed("node", "parent")), "parent")
    bad = F.col("depth") < 0
    moved = up.select(
        F.col("child").alias("node"),
        "root",
        F.when(bad, F.lit(-1)).otherwise(F.col("depth") + F.col("w")).alias("depth"),
        *([F.when(~bad, F.concat("path", "hops")).alias("path")] if paths else []),
    )
    best = [F.max("depth").alias("depth")]
    if paths:
        best.append(F.max_by("path", F.struct("depth", "path")).alias("path"))
    return moved.groupBy("node", "root").agg(*best)


def _settle_core(known: DataFrame, edges: DataFrame, paths: bool) -> DataFrame:
    """Settle the core's nodes whose parents are all settled, downward; the others are cyclic."""
    left = cut(edges.select("child").distinct())
    while True:
        parents = edges.join(_merge(left), "child", "left_semi")
        waiting = parents.join(_merge(left.withColumnRenamed("child", "parent")), "parent", "left_semi").select("child").distinct()
        ready, seen = cut_counting(parents.join(_merge(waiting), "child", "left_anti"), n=F.count(F.lit(1)))
        if not seen["n"]:
            return known.unionByName(_cyclic(left.withColumnRenamed("child", "node"), paths))
        known = known.unionByName(cut(_expand(ready, known, paths)))
        left = cut(left.join(_merge(ready.select("child").distinct()), "child", "left_anti"))


def descendants(nodes: DataFrame, settled: DataFrame) -> DataFrame:
    """(node, descendant, depth): all pairs of an ancestor and a descendant on no cycle nor below one.

    settled: the result of hierarchy(). depth is the number of links on the longest path between
    them. Distances are doubled: with all pairs up to a distance k known, a pair farther apart has on its longest
    path one node at exactly k from its ancestor, so only pairs at that distance are joined with
    all others. The number of rounds is the logarithm of the depth.
    """
    _, pairs = links(nodes)
    good = settled.filter("depth >= 0").select("node").distinct()
    reach = cut(
        pairs.join(_merge(good.withColumnRenamed("node", "child")), "child", "left_semi").select(
            F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("depth")
        )
    )
    far = 1
    while True:
        lower = reach.select(F.col("node").alias("middle"), F.col("descendant").alias("low"), F.col("depth").alias("more"))
        longer = reach.filter(F.col("depth") == far).join(_merge(lower), F.col("descendant") == F.col("middle")).select(
            "node", F.col("low").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth")
        )
        both = reach.unionByName(longer).groupBy("node", "descendant").agg(F.max("depth").alias("depth"))
        reach, seen = cut_counting(both, farther=F.count_if(F.col("depth") > far))
        if not seen["farther"]:
            return reach
        far *= 2

"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None and named:
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-ck-"))
    return df.checkpoint(eager=True)


def _apart(df: DataFrame) -> DataFrame:
    """df with a second key. A join on both is dealt anew, so that a hot u can be split; a grouping by u alone could not be."""
    return df.withColumn("salt", F.hash("u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", cut: Callable[[DataFrame], DataFrame] = _checkpointed, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Alternating large-star and small-star steps: every step is a grouped minimum (with partial
    minima before the shuffle) and a join, so a node with very many neighbours is split like any
    skewed key. `cut` ends the lineage of each round's edges. Nulls and loops are left out; types
    are kept, so ids may be numbers or strings. Rounds grow with the logarithm of the longest chain;
    if `rounds` don't settle the components, that is an error, never an unfinished result.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    start = cut(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # loops too, so that the edges are made once
    loops = start.select(F.col("u").alias("node")).union(start.select("v")).distinct()
    e = start.where("u <> v")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _apart(both.where("v > u")).join(_apart(low), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _apart(large).join(_apart(low), ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = e.groupBy("u").agg(F.min("v").alias("component"))
    return loops.join(found, loops.node == found.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links lead to."""
    root = np.arange(n)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        live = low < high
        i, j = i[live], j[live]
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
    return root


HELD = 1 << 21  # links that a task holds before it reduces them


def reduced(links: DataFrame) -> DataFrame:
    """links (a, b, c) to kind, a, b: 0, a forest of each task's links a to b; 1, each a with its largest b; 2, each c with its smallest a."""
    kind = dict(links.dtypes)["a"]

    def extreme(of: np.ndarray, value: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        edge = np.ones(len(of), bool)
        (edge[:-1] if ends else edge[1:])[:] = of[1:] != of[:-1]
        return of[edge], value[edge]

    def tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), at[: len(a)], at[len(a) :])
        moved = np.nonzero(root != np.arange(len(nodes)))[0]
        return nodes[moved], nodes[root[moved]]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], None

        def settle() -> None:
            nonlocal kept
            a, b, c = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            new = [(a, b), (a, b), (c, a)]
            kept = [tuple(np.concatenate(x) for x in zip(old, more, strict=True)) for old, more in zip(kept, new, strict=True)] if kept else new
            kept = [tree(*kept[0]), extreme(*kept[1], 1), extreme(*kept[2], 0)]

        types = None
        for t in batches:
            types = t.schema.field("a").type
            held.append([t[k].to_numpy(zero_copy_only=False) for k in ("a", "b", "c")])
            if sum(len(h[0]) for h in held) >= HELD:
                settle()
        if held:
            settle()
        for k, (a, b) in enumerate(kept or []):
            yield pa.record_batch({"kind": pa.array(np.full(len(a), k, np.int32)), "a": pa.array(a, types), "b": pa.array(b, types)})

    return links.select("a", "b", "c").mapInArrow(one, f"kind int, a {kind}, b {kind}")

"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import unsized


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) over edges a-b, for the nodes that are not that least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _local(frames):
    """A spanning forest of the edges of a few batches at a time."""
    held, n = [], 0

    def out():
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        u, v = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in frames:
        held.append(batch)
        n += batch.num_rows
        if n > 1_000_000:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the least node that edges reach.

    Edges are first reduced to spanning forests partition by partition; then large-star and
    small-star rounds run, each checkpointed without a supposed size, until the edges no longer change. A node of very many edges
    is split by adaptive execution's skewed joins. Edges that are null
    at an end or join a node to itself are left out.
    """
    own = lambda t: t.select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), "m")  # noqa: E731  a new key, so that the join has an exchange on both sides, which adaptive execution splits at a hub
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = unsized(e.mapInArrow(_local, "u long, v long").distinct())
    was = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(own(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own(low), F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = unsized(small.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

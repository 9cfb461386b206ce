"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its NEAREST pivots in order of cosine. Inverted lists hold, for each pivot,
the vectors that have it among theirs; two vectors of a list are candidates when they share at least
SHARED pivots, and are looked at in the list of the least one only. Candidates are verified by their
cosine in double precision, so no link is false; what they share fixes the recall, which the tests
hold against brute force.

Pivots are a bounded sample (one for PER_PIVOT rows, at most MAX_PIVOTS and PIVOT_BYTES, those of least hash) without rows that are close
to an earlier one: a group of near copies of any size has one pivot or few, which all its members
share, and not a share of the pivots by its size, of which two members would rarely have the same.
Every vector is indexed.
Each list is cut into chunks of CHUNK vectors and all pairs of its chunks are searched in tasks of
their own, so a list of any length is searched whole. Pairs never leave a task: it reports how many
links each vector has, and a spanning forest of them.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors
of different lengths do not link. Rows of equal vec_id do not count as each other's links. Ids are integers; one that is none, and
the least integer, count as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from driftgauge.llm.graph import components, forest
from driftgauge.llm.substring import LEAST, id_column
from driftgauge.llm.text import checkpoint, documents, frugal, lean

NEAREST, SHARED, MAX_PIVOTS, PER_PIVOT, CHUNK, COSINE = 8, 2, 16384, 64, 2048, 0.9
#: Bytes of the broadcast pivots at most.
PIVOT_BYTES = 16 << 20
#: Rows looked at for each pivot, so that enough are left when close ones are gone.
DRAWN = 4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def thinned(x: np.ndarray, n: int, most: float) -> np.ndarray:
    """The first n rows, in order, whose cosines with all taken before are below this."""
    out, m = np.empty((min(n, len(x)), x.shape[1])), 0
    for at in range(0, len(x), 512):
        y = x[at : at + 512]
        free = ~(y @ out[:m].T >= most).any(1)
        close = y @ y.T >= most
        for i in range(len(y)):
            if free[i]:
                if m == len(out):
                    return out
                out[m] = y[i]
                m += 1
                free &= ~close[i]
    return out[:m]


def pivots(good: DataFrame, n: int, least: float = COSINE) -> np.ndarray:
    """At most n directions of the rows of least hash; rows of the commonest length only.

    They are as far apart as twice the angle of a link, or less where too few are: on vectors that
    all point one way. No two are as close as a link.
    """
    got = good.orderBy(F.xxhash64("id"), "id").limit(DRAWN * n).select("v").toArrow().column("v").combine_chunks()  # bounded by n
    if not len(got):
        return np.zeros((0, 0))
    at = got.offsets.to_numpy()
    sizes = np.diff(at)
    u, count = np.unique(sizes, return_counts=True)
    dim = u[count.argmax()]
    flat = got.values.to_numpy(zero_copy_only=False)
    x = unit(np.stack([flat[i : i + dim] for i in at[:-1][sizes == dim]]))
    for most in np.linspace(2 * least * least - 1, least, 4):
        out = thinned(x, n, float(most))
        if 4 * len(out) >= n:
            break
    return out


def nearest(x: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k pivots of largest cosine, in that order; vectors of other lengths are cut or filled with zeros."""
    if x.shape[1] != p.shape[1]:
        y = np.zeros((len(x), p.shape[1]))
        m = min(x.shape[1], p.shape[1])
        y[:, :m] = x[:, :m]
        x = y
    s = x @ p.T
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def shared_counts(a: np.ndarray, b: np.ndarray, pivot: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots each pair shares, and how many of them come before this one."""
    used = np.unique(np.concatenate((a.ravel(), b.ravel())))
    place = np.zeros(n, np.int64)
    place[used] = np.arange(len(used))
    hot = [np.zeros((len(x), len(used)), np.float32) for x in (a, b)]
    for h, x in zip(hot, (a, b), strict=True):
        np.put_along_axis(h, place[x], 1, 1)
    before = int((used < pivot).sum())
    return hot[0] @ hot[1].T, hot[0][:, :before] @ hot[1][:, :before].T


def links(ida, a, pa_, idb, b, pb, pivot: int, n_pivots: int, least: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of pairs of a and b that this list answers for and whose cosine reaches the least."""
    out = []
    for at in range(0, len(a), 512):
        count, before = shared_counts(pa_[at : at + 512], pb, pivot, n_pivots)
        i, j = np.nonzero((count >= min(shared, pa_.shape[1])) & (before == 0) & (ida[at : at + 512, None] != idb[None, :]))
        if len(i):
            cosine = np.einsum("ij,ij->i", a[at + i], b[j]) if len(i) * 4 < len(b) * 512 else (a[at : at + 512] @ b.T)[i, j]
            keep = cosine >= least
            out.append((at + i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def near_dups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, k: int = NEAREST, shared: int = SHARED, chunk: int = CHUNK) -> DataFrame:
    """id, n_links, component_id, kept of each row."""
    spark = df.sparkSession
    single = df.schema[vector_col].dataType.elementType == FloatType()  # then vectors travel as they are, without loss
    rows = df.select(id_column(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    good = rows.where(F.coalesce(fine, F.lit(False)))
    total = good.count()
    dim = good.limit(1000).agg(F.max(F.size("v"))).first()[0] or 1
    n = int(min(MAX_PIVOTS, max(4 * k, PIVOT_BYTES // (8 * dim)), max(4 * k, total // PER_PIVOT)))
    p = pivots(good, n, least)
    null = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    if not len(p):
        return rows.select(null("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), null("id").alias("component_id"), F.lit(True).alias("kept"))
    sent = spark.sparkContext.broadcast(p)
    n = len(p)

    def index(frames):
        frugal()
        for batch in frames:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(sizes)))
            ids = batch.column("id").to_numpy()
            for dim in np.unique(sizes):
                pick = np.flatnonzero(sizes == dim)
                x = np.stack([flat[at[i] : at[i + 1]] for i in pick])
                for j in range(0, len(pick), 1024):
                    y = x[j : j + 1024]
                    scale = np.abs(y).max(1, keepdims=True)
                    near = nearest(unit(y / scale), sent.value, k).astype("<i4")
                    raw = y.astype("<f4") if single else (y / scale).astype("<f8")
                    yield pa.RecordBatch.from_pydict({"id": ids[pick[j : j + 1024]], "near": near.tolist(), "dim": np.full(len(y), dim, np.int32), "x": [r.tobytes() for r in raw]}, schema=pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int32())), ("dim", pa.int32()), ("x", pa.binary())]))

    described = good.mapInArrow(index, "id long, near array<int>, dim int, x binary")
    lists = described.select("id", F.explode("near").alias("pivot"), "near", "dim", "x")
    sizes = {(r.pivot, r.dim): r["count"] for r in lists.groupBy("pivot", "dim").count().where(F.col("count") > chunk).collect()}  # at most a row for each pivot and length
    cuts = spark.createDataFrame([(a, b, int(-(-c // chunk))) for (a, b), c in sizes.items()] or [(-1, -1, 1)], "pivot int, dim int, cuts int")
    lists = lists.join(F.broadcast(cuts), ["pivot", "dim"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    lists = lists.select("pivot", "dim", "id", own.alias("own"), F.explode(pair).alias("at"), "near", "x")

    def search(t: pa.Table) -> pa.Table:
        pivot, i, j = (t.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        ids, mine = t.column("id").to_numpy(), t.column("own").to_numpy()
        x = unit(np.frombuffer(b"".join(t.column("x").to_pylist()), "<f4" if single else "<f8").astype(np.float64).reshape(len(ids), -1))
        near = np.array(t.column("near").to_pylist(), np.int64)
        a, b = (np.flatnonzero(mine == c) for c in (i, j))
        u, v = links(ids[a], x[a], near[a], ids[b], x[b], near[b], pivot, n, least, shared)
        u, v = a[u], b[v]
        if i == j:
            who = u  # each pair is there in both orders
        else:
            who = np.concatenate((u, v))
        count = np.bincount(who, minlength=len(ids))
        some = np.flatnonzero(count)
        f, g = forest(ids[u], ids[v]) if len(u) else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": np.concatenate((ids[some], f)), "b": np.concatenate((count[some], g)), "kind": np.concatenate((np.zeros(len(some), np.int32), np.ones(len(f), np.int32)))})

    found = checkpoint(lists.select("pivot", "dim", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "own", "near", "x").groupBy("pivot", "dim", "i", "j").applyInArrow(lean(search), "a long, b long, kind int"))
    degree = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n_links"))
    reach = components(found.where("kind = 1"))
    out = rows.select("id").join(degree, "id", "left").join(reach, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(null("id").alias(id_col), "n_links", null("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_dups(documents(spark, sf_dir, "embeddings"))

"""Hard-negative mining by a dual-tree search for inner products.

Vectors become integers (the floor of SCALE times each component); a score is the exact integer inner product. Rows are put in
the order of their label and nearest pivot, and packed into blocks, each with a ball tree; anchors, some of the rows, are
packed into slabs of at most some SLAB bytes, each with a tree of its own. A task holds one slab and goes through its
blocks: pairs of an anchor node and a candidate node are followed from both roots down. Centres and radii bound all inner
products of a pair; where no anchor of the node can use any score within these bounds, the whole group of anchors leaves
that candidate node at once. Leaf pairs are scored exactly.

Positives of an anchor are the best rows of its own label and another id. Negatives, for each positive, are the best rows of
other labels whose score is from LOW to HIGH percent of the positive's. What an anchor can use is at first any score (or that
range), and then what is better than its k-th best so far; a first part of the blocks, about the square root of their number,
is searched before the others, so that these begin with good bounds and send little. Each block is searched for every slab.

Pivots are a bounded sample (the rows of least hash, PIVOTS at most), and fix only how well blocks can be pruned, never the
rows. Slabs pass through the driver one at a time, as broadcasts do; their size is bounded, whatever the input's.

Rows with a null id, label or vector, or any null or non-finite component take no part, nor do those whose integer vector is so
long that scores could leave 64 bits (a squared norm of 2^62 or more). Vectors of different lengths are never compared.
Scores that are equal go by smaller id; a row that repeats counts as often. An anchor without positives, or a positive
without negatives, has no rows. Ids and labels are integers. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from driftgauge.llm.text import checkpoint, documents, frugal, lean, trim

SCALE, POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 256, 5, 10, 30, 90, 100
#: Bytes of a block's and of a slab's vectors, rows of a leaf of each, and candidates that are scored at once.
BLOCK, SLAB, LEAF, ANCHOR_LEAF, STRIP = 2 << 20, 16 << 20, 128, 64, 1024
#: Pivots and their bytes at most, rows for each, and blocks below which one search does for all.
PIVOTS, PIVOT_BYTES, PER_PIVOT, FEW = 1024, 16 << 20, 4096, 64
WORST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Ball:
    """A tree of balls over integer vectors, whose rows are reordered so that each node is a range of them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int):
        self.order, self.leaf, nodes = np.arange(len(x)), leaf, []
        self._y, self._l = x.astype(np.float64), labels
        self._grow(0, len(x), nodes)
        self.start, self.end, self.left, self.right = (np.array([n[k] for n in nodes], np.int64) for k in range(4))
        self.low, self.high = (np.array([n[k] for n in nodes], np.int64) for k in (4, 5))
        self.radius, self.center = np.array([n[6] for n in nodes]), np.stack([n[7] for n in nodes])
        self.norm = np.sqrt((self.center**2).sum(1))
        self.x, self.ids, self.labels = x[self.order], ids[self.order], labels[self.order]
        self.most = int(np.abs(x).max(initial=0))
        del self._y, self._l, self.order

    def _grow(self, a: int, b: int, nodes: list) -> int:
        me, rows = len(nodes), self.order[a:b]
        nodes.append(None)
        y, own = self._y[rows], self._l[rows]
        center = y.mean(0)
        far = ((y - center) ** 2).sum(1)
        low, high, left, right = own.min(), own.max(), -1, -1
        if b - a > self.leaf:
            if low != high:  # between labels, as near the middle as can be
                o = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.diff(own[o])) + 1
                cut = int(edges[np.abs(edges - (b - a) // 2).argmin()])
            else:
                p = y[far.argmax()] if far.size else center
                q = y[((y - p) ** 2).sum(1).argmax()]
                o, cut = np.argsort(y @ (q - p), kind="stable"), (b - a) // 2
            self.order[a:b] = rows[o]
            left, right = self._grow(a, a + cut, nodes), self._grow(a + cut, b, nodes)
        nodes[me] = (a, b, left, right, low, high, math.sqrt(far.max()), center)
        return me

    def least(self, value: np.ndarray) -> np.ndarray:
        """The least value of each node's rows."""
        tip = np.flatnonzero(self.left < 0)
        out = np.empty(len(self.start), value.dtype)
        out[tip] = np.minimum.reduceat(value, self.start[tip])  # leaves follow one another
        for i in range(len(out) - 1, -1, -1):
            if self.left[i] >= 0:
                out[i] = min(out[self.left[i]], out[self.right[i]])
        return out


def meet(a: Ball, c: Ball, use) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor leaf, candidate leaf, upper bound) of all pairs of leaves that no bound rules out, from the roots down.

    use(i, j, low, up): which of the pairs of nodes may hold a score that is of use."""
    i, j, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(i):
        middle = np.einsum("nd,nd->n", a.center[i], c.center[j])
        slack = a.radius[i] * c.norm[j] + c.radius[j] * a.norm[i] + a.radius[i] * c.radius[j]
        slack = slack * (1 + 1e-9) + a.norm[i] * c.norm[j] * 1e-9 + 1e-3  # for what rounding takes away
        keep = use(i, j, middle - slack, middle + slack)
        i, j, up = i[keep], j[keep], (middle + slack)[keep]
        tip_a, tip_c = a.left[i] < 0, c.left[j] < 0
        done = tip_a & tip_c
        out.append((i[done], j[done], up[done]))
        by_a = ~tip_a & (tip_c | (a.radius[i] >= c.radius[j]))
        by_c = ~by_a & ~done
        i, j = (np.concatenate((x[by_a], x[by_a], y[by_c], y[by_c])) for x, y in ((i, i), (j, j)))
        n, m = int(by_a.sum()), int(by_c.sum())
        i[:n], i[n : 2 * n] = a.left[i[:n]], a.right[i[n : 2 * n]]
        j[2 * n : 2 * n + m], j[2 * n + m :] = c.left[j[2 * n : 2 * n + m]], c.right[j[2 * n + m :]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Best:
    """The k best (score, id) of each key, and of each the score that another one must reach."""

    def __init__(self, keys: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score, self.id = np.full((keys, k), WORST), np.full((keys, k), LAST)
        self.there = np.zeros(keys, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        touched = np.unique(key)
        n = self.there[touched]
        old = np.repeat(touched, n)
        place = np.arange(len(old)) - np.repeat(np.cumsum(n) - n, n)
        key, score, ident = np.concatenate((old, key)), np.concatenate((self.score[old, place], score)), np.concatenate((self.id[old, place], ident))
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        top = rank < self.k
        self.score[key[top], rank[top]], self.id[key[top], rank[top]] = score[top], ident[top]
        self.there[touched] = np.minimum(np.diff(np.append(first, len(key))), self.k)
        full = touched[self.there[touched] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, self.k - 1])

    def rows(self) -> pa.RecordBatch:
        key, rank = np.nonzero(np.arange(self.k) < self.there[:, None])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(self.score[key, rank]), pa.array(self.id[key, rank])], ["key", "score", "id"])


def products(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as integers; in doubles where those hold every sum."""
    kind = np.float64 if exact else np.int64
    return (a.astype(kind) @ c.astype(kind).T).astype(np.int64)


def search(a: Ball, c: Ball, best: Best, per: int, cap: np.ndarray | None) -> None:
    """Adds to best what the candidates of c have for the anchors of a. Each anchor has `per` keys. Without a cap: rows of its own
    label and another id; with one, for each key: rows of other labels and of scores up to it."""
    floor = best.floor.reshape(-1, per)
    need = a.least(floor.min(1)).astype(np.float64)
    top = -a.least(-cap.reshape(-1, per).max(1)).astype(np.float64) if cap is not None else None

    def use(i, j, low, up):
        alike = (a.low[i] <= c.high[j]) & (a.high[i] >= c.low[j])
        if cap is None:
            return alike & (up >= need[i])
        one = (a.low[i] == a.high[i]) & (c.low[j] == c.high[j]) & alike
        return ~one & (up >= need[i]) & (low <= top[i])

    i, j, up = meet(a, c, use)
    order = np.lexsort((-up, i))  # the most promising candidates first
    i, j, up = i[order], j[order], up[order]
    exact = a.most * c.most * max(1, a.x.shape[1]) < 1 << 53
    for s, e in zip(*(lambda f: (f, np.append(f[1:], len(i))))(np.flatnonzero(np.append(True, i[1:] != i[:-1]))), strict=True) if len(i) else ():
        r0, r1 = a.start[i[s]], a.end[i[s]]
        at = s
        while at < e:
            if up[at] < floor[r0:r1].min():
                break  # nor can those behind it
            stop = min(e, at + STRIP // LEAF)
            rows = np.concatenate([np.arange(c.start[x], c.end[x]) for x in j[at:stop]])
            at = stop
            score = products(a.x[r0:r1], c.x[rows], exact)
            same = a.labels[r0:r1, None] == c.labels[rows]
            fit = same & (a.ids[r0:r1, None] != c.ids[rows]) if cap is None else ~same
            found = []
            for k in range(per):
                ok = fit & (score >= floor[r0:r1, k, None])
                if cap is not None:
                    ok &= score <= cap.reshape(-1, per)[r0:r1, k, None]
                u, v = np.nonzero(ok)
                if len(u):
                    found.append(((r0 + u) * per + k, score[u, v], c.ids[rows[v]]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def vectors(df: DataFrame, anchor, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows that take part: id, label, anchor, v."""
    v = F.col(vector_col)
    single = df.schema[vector_col].dataType.elementType == FloatType()  # then vectors travel as they are
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def integers(column: pa.Array, scale: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The integer vectors of a list column by length: (row numbers, matrix) pairs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for dim in np.unique(sizes):
        pick = np.flatnonzero(sizes == dim)
        yield pick, flat[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim)


def blocks(good: DataFrame, total: int, scale: int, block: int) -> DataFrame:
    """(dim, n, data) of blocks of rows in order of length, label and nearest pivot; data holds a tree and which rows are anchors."""
    spark = good.sparkSession
    shape = good.limit(1000).agg(F.max(F.size("v"))).first()[0] or 1
    n = max(1, min(PIVOTS, PIVOT_BYTES // (8 * shape), total // PER_PIVOT))
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(n).select("v").toArrow().column("v").combine_chunks()  # bounded by n
    mats = [m for _, m in integers(drawn, scale)] if len(drawn) else []
    pivots = spark.sparkContext.broadcast(max(mats, key=len) if mats else np.zeros((1, 1)))

    def place(frames):
        frugal()
        p = pivots.value
        half = (p**2).sum(1) / 2
        for batch in frames:
            for pick, x in integers(batch.column("v"), scale):
                pick, x = (lambda ok: (pick[ok], x[ok]))((x**2).sum(1) < 2.0**62)
                if not len(pick):
                    continue
                cell = (half - x @ p.T).argmin(1) if x.shape[1] == p.shape[1] else np.zeros(len(x), np.int64)
                raw, rows = x.astype("<i4"), batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), rows.column("anchor"), pa.array(np.full(len(pick), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "label", "anchor", "dim", "cell", "x"])

    def pack(frames):
        frugal()
        held, dim, rows = [], None, 0

        def out():
            ids, labels, anchor = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "label", "anchor"))
            x = np.frombuffer(b"".join(v for b in held for v in b.column("x").to_pylist()), "<i4").reshape(len(ids), dim)
            own = None
            if anchor.any():
                own = (ids[anchor], labels[anchor], x[anchor])
            held.clear()
            data = pickle.dumps((Ball(x, ids, labels, LEAF), own), 5)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(anchor.sum())], pa.int32()), pa.array([data], pa.binary())], ["dim", "anchors", "data"])

        for batch in frames:
            dims = batch.column("dim").to_numpy()
            at = 0
            while at < len(dims):
                if held and dims[at] != dim:
                    yield out()
                    rows = 0
                dim = int(dims[at])
                room = max(LEAF, block // (8 * max(1, dim))) - rows
                same = int(np.searchsorted(dims[at:], dim, side="right"))  # dims are in order
                take = min(room, same)
                held.append(batch.slice(at, take))
                at, rows = at + take, rows + take
                if take == room:
                    yield out()
                    rows = 0
        if held:
            yield out()
        trim()

    placed = good.mapInArrow(place, "id long, label long, anchor boolean, dim int, cell int, x binary")
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * shape * 4 // (64 << 20)))
    keys = ["dim", "label", "cell", F.xxhash64("id"), "id"]
    return checkpoint(placed.repartitionByRange(many, *keys).sortWithinPartitions(*keys).mapInArrow(pack, "dim int, anchors int, data binary"))


def slabs_of(packed: DataFrame, slab: int) -> list[tuple[DataFrame, int]]:
    """Trees of the anchors, in slabs of some bytes: (slab, n, data)."""
    weight = packed.agg(F.coalesce(F.sum(F.col("anchors").cast("long") * (F.col("dim") * 4 + 16)), F.lit(0))).first()[0]
    n = max(1, -(-weight // slab))

    def own(frames):
        for batch in frames:
            for data in batch.column("data"):
                ids, labels, x = pickle.loads(data.as_py())[1]
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([pickle.dumps((ids, labels, x), 5)], pa.binary())], ["dim", "data"])

    def build(t: pa.Table) -> pa.Table:
        parts = sorted((pickle.loads(d.as_py()) for d in t.column("data").combine_chunks()), key=lambda p: (int(p[1][0]), int(p[0][0])))
        ids, labels, x = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((ids, labels))
        return pa.table({"slab": t.column("slab")[:1], "dim": t.column("dim")[:1], "data": pa.array([pickle.dumps(Ball(x[order], ids[order], labels[order], ANCHOR_LEAF), 5)], pa.binary())})

    packs = packed.where("anchors > 0").select("data").mapInArrow(own, "dim int, data binary")
    packs = packs.withColumn("slab", F.pmod(F.xxhash64("data"), F.lit(n)).cast("int"))
    return checkpoint(packs.groupBy("slab", "dim").applyInArrow(lean(build), "slab int, dim int, data binary"))


def best_of(parts: list[DataFrame], a: Ball, per: int, k: int, floor: np.ndarray, cap: np.ndarray | None) -> DataFrame:
    """(key, rank, score, id): the k best of each key over all parts of the blocks, one after the other."""
    found = None
    for part in parts:
        sent = part.sparkSession.sparkContext.broadcast((a, floor, cap))

        def run(frames, sent=sent):
            frugal()
            own, low, most = sent.value
            best = Best(len(low), k, low)
            for batch in frames:
                for data in batch.column("data"):
                    search(own, pickle.loads(data.as_py())[0], best, per, most)
            yield best.rows()
            trim()

        got = part.where(F.col("dim") == a.x.shape[1]).select("data").mapInArrow(run, "key long, score long, id long")
        if found is not None:
            got = got.union(found.select("key", "score", "id"))
        order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        found = checkpoint(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        sent.destroy()
        if part is not parts[-1]:
            last = found.where(F.col("rank") == k).select("key", "score").toArrow()  # a row for each key of the slab at most
            floor = floor.copy()
            at = last.column("key").to_numpy()
            floor[at] = np.maximum(floor[at], last.column("score").to_numpy())
    return found


def mine(
    df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK, slab: int = SLAB, few: int = FEW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition on the columns of df; rows whose id
    is divisible by EVERY where it isn't given."""
    spark = df.sparkSession
    anchor = F.col(id_col) % EVERY == 0 if anchor is None else anchor
    good = vectors(df, anchor, id_col, label_col, vector_col, scale)
    packed = blocks(good, good.count(), scale, block)
    n = packed.count()
    parts = [packed]
    if n > few:
        early = F.pmod(F.xxhash64("data"), F.lit(math.isqrt(n))) == 0
        parts = [checkpoint(packed.where(early)), packed.where(~early)]
    trees = slabs_of(packed, slab)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in trees.select("slab", "dim").collect():  # one for each slab
        a: Ball = pickle.loads(trees.where((F.col("slab") == r.slab) & (F.col("dim") == r.dim)).first().data)
        near = best_of(parts, a, 1, positives, np.full(len(a.ids), WORST), None)
        got = near.toArrow()  # a row for each anchor of the slab and positive at most
        at = got.column("key").to_numpy() * positives + got.column("rank").to_numpy() - 1
        score = got.column("score").to_numpy()
        floor, cap = np.full(len(a.ids) * positives, LAST), np.full(len(a.ids) * positives, WORST)
        floor[at] = [-(-low * s // 100) for s in score.tolist()]
        cap[at] = [high * s // 100 for s in score.tolist()]
        far = best_of(parts, a, positives, negatives, floor, cap)
        own = pa.table({"key": at, "anchor_id": a.ids[at // positives], "positive_id": got.column("id"), "positive_score": score})
        named = spark.createDataFrame(own)
        rows = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, "key")
        out = out.union(rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    return out


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (SELECT a, b AS pid, score AS ps FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, pid AS positive_id, (row_number() OVER (PARTITION BY p.a, pid ORDER BY score DESC, b))::INT AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a WHERE la <> lb AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
QUALIFY row_number() OVER (PARTITION BY p.a, pid ORDER BY score DESC, b) <= 10
"""

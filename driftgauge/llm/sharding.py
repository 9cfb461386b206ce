"""Sharding by Karmarkar-Karp differencing, so that shards of indivisible groups have near equal bytes.

Groups are the rows of equal text (null counts as empty); a group stays in one shard. A partial partition is a
vector of sums, one for each shard. At first each group is one of its own. The two with the largest spread (largest
less smallest sum) are combined again and again, the largest sums of one with the smallest of the other.

That runs in tasks over buckets of groups, and the buckets' partitions are combined by the same rule in a tree, so no task
holds more than some thousand vectors or PER groups. Groups above a 64th of a shard's share, of which there are
64 for each shard at most, come first, by themselves; each bucket then begins with their partition, cut at the level
that the rest can fill and scaled to the bucket's share of the rest, as a partial partition whose places are fixed. So a
group that holds a third of all bytes is alone in its shard, and the others are filled evenly. Vectors of buckets may still
be turned among places where that partition is equal.

Size is the UTF-8 bytes of the text plus OVERHEAD. Slots are numbered from 0 in each shard without gaps, through chunks of
rows whose numbers are summed first; they and the shards depend on the rows alone, not on partitions. Rows that repeat are
numbered each; no task makes more than BLOCK of their numbers in a row. Ids may be of any type, null included. No rows give no rows.
Groups are told apart by 64-bit hashes: two texts of equal hash would share a shard, and nothing else.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.text import checkpoint, documents, lean

SHARDS, OVERHEAD, HEAVY = 40, 16, 64
#: Groups of a bucket, vectors combined in a task, rows of a chunk that is numbered at once, and numbers made from one row.
PER, FAN, CHUNK_ROWS, BLOCK = 1 << 14, 4096, 1024, 4096


def difference(vectors: list[list[float]], fixed: list[bool], classes: list[int]) -> tuple[list[float], list[list[int]]]:
    """The sums when all vectors are combined, and for each vector the places that its own went to.

    A vector is as long as there are shards, or of length one: a group by itself, on any place. Places of fixed ones change only
    with places of their class."""
    k = len(classes)
    sums, fixed = list(vectors), list(fixed)
    heap = [(min(v) - max(v) if len(v) == k else -v[0], i) for i, v in enumerate(sums)]
    heapq.heapify(heap)
    steps = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heap[0][1]
        if (fixed[b] and not fixed[a]) or (fixed[a] == fixed[b] and len(sums[a]) < k <= len(sums[b])):
            a, b = b, a  # a's places stay
        x, y = sums[a], sums[b]
        if len(x) < k:
            x = x + [0.0] * (k - 1)
        if len(y) < k:  # a group goes where least is
            at = x.index(min(x))
            x = x.copy()
            x[at] += y[0]
            steps.append((a, b, at))
        else:
            if fixed[a] and fixed[b]:
                low = sorted(range(k), key=lambda i: (classes[i], x[i]))
                high = sorted(range(k), key=lambda i: (classes[i], -y[i]))
            else:
                low = sorted(range(k), key=x.__getitem__)
                high = sorted(range(k), key=y.__getitem__, reverse=True)
            to = [0] * k
            x = x.copy()
            for i, j in zip(low, high, strict=True):
                x[i] += y[j]
                to[j] = i
            steps.append((a, b, to))
        sums[a], sums[b] = x, None
        heapq.heapreplace(heap, (min(x) - max(x), a))
    root = heap[0][1]
    places: list = [None] * len(vectors)
    places[root] = list(range(k))
    for a, b, to in reversed(steps):
        places[b] = [places[a][to]] if isinstance(to, int) else [places[a][i] for i in to]
    top = sums[root]
    return top + [0.0] * (k - len(top)), places


def filled(base: list[float], more: float) -> list[float]:
    """The base cut at the level to which `more` fills it."""
    order = sorted(base)
    for n in range(len(order), 0, -1):
        level = (sum(order[:n]) + more) / n
        if level >= order[n - 1]:
            return [min(b, level) for b in base]
    return list(base)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_crc32, size, grp and m, how many rows are alike, of each row. One scan, which leaves the texts behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.xxhash64(text).alias("grp"))
    return rows.groupBy("id", "grp", "size", "text_crc32").agg(F.count("*").alias("m"))


def shard_of_groups(rows: DataFrame, shards: int = SHARDS, per: int = PER, fan: int = FAN) -> DataFrame:
    """(grp, shard) of each group of the rows that groups() gives."""
    spark = rows.sparkSession
    weights = checkpoint(rows.groupBy("grp").agg(F.sum(F.col("size") * F.col("m")).alias("bytes")))
    total, n = weights.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    large = F.col("bytes") * F.lit(shards * HEAVY) > F.lit(total)
    first = sorted(((r.bytes, r.grp) for r in weights.where(large).collect()), reverse=True)  # fewer than shards * HEAVY
    any_place = [0] * shards
    base, where = difference([[float(b)] for b, _ in first], [False] * len(first), any_place) if first else ([0.0] * shards, [])
    heavy = spark.createDataFrame([(g, p[0]) for (_, g), p in zip(first, where, strict=True)], "grp long, shard int")
    rest = float(total - sum(b for b, _ in first))
    level = filled(base, rest)
    classes = np.unique(level, return_inverse=True)[1].tolist()
    buckets = max(1, -(-n // per))

    def deal(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("grp").to_numpy(), -t.column("bytes").to_numpy()))
        own, grp = t.column("bytes").to_numpy()[order], t.column("grp").to_numpy()[order]
        share = float(own.sum()) / rest
        sums, places = difference([[x * share for x in level], *([float(b)] for b in own.tolist())], [True] + [False] * len(own), classes)
        none = pa.nulls(len(own), pa.list_(pa.float64()))
        at = pa.array([p[0] for p in places[1:]], pa.int32())
        bucket = t.column("bucket")[0].as_py()
        return pa.table({
            "grp": pa.concat_arrays([pa.array(grp, pa.int64()), pa.nulls(1, pa.int64())]), "place": pa.concat_arrays([at, pa.nulls(1, pa.int32())]),
            "bucket": pa.array([bucket] * (len(own) + 1), pa.int32()), "sums": pa.concat_arrays([none, pa.array([sums], pa.list_(pa.float64()))]),
        })

    light = weights.where(~large).withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    dealt = checkpoint(light.groupBy("bucket").applyInArrow(lean(deal), "grp long, place int, bucket int, sums array<double>"))

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        vectors = t.column("sums").to_pylist()
        sums, places = difference(vectors, [True] * len(vectors), classes)
        return pa.table({"up": t.column("up"), "node": t.column("node"), "to": pa.array(places, pa.list_(pa.int32())), "sums": pa.array([sums] + [None] * (len(vectors) - 1), pa.list_(pa.float64()))})

    nodes, left, levels = dealt.where("sums is not null").select(F.col("bucket").alias("node"), "sums"), buckets, []
    while left > 1:
        left = -(-left // fan)
        done = checkpoint(nodes.withColumn("up", F.floor(F.col("node") / fan).cast("int")).groupBy("up").applyInArrow(lean(combine), "up int, node int, to array<int>, sums array<double>"))
        levels.append(done.select("up", "node", "to"))
        nodes = done.where("sums is not null").select(F.col("up").alias("node"), "sums")
    place = dealt.where("grp is not null").select("grp", "bucket", "place")
    if not levels:
        return place.select("grp", F.col("place").alias("shard")).union(heavy)
    turned = levels.pop()
    while levels:
        above = turned.select(F.col("node").alias("over"), F.col("to").alias("then"))
        turned = levels.pop().join(above, F.col("up") == F.col("over")).select("node", F.transform("to", lambda i: F.element_at("then", i + 1)).alias("to"))
    out = place.join(turned.select(F.col("node").alias("bucket"), "to"), "bucket").select("grp", F.element_at("to", F.col("place") + 1).alias("shard"))
    return out.union(heavy)


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with slot: from 0 in each shard, without gaps."""
    n = rows.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    chunks = max(1, n // (shards * CHUNK_ROWS))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / BLOCK))))
    pieces = pieces.withColumn("k", F.least(F.col("m") - F.col("piece") * BLOCK, F.lit(BLOCK)))
    pieces = checkpoint(pieces.withColumn("chunk", F.pmod(F.xxhash64("id", "grp", "piece"), F.lit(chunks)).cast("int")).drop("m"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("shard", "chunk").agg(F.sum("k").alias("k")).select("shard", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "chunk").orderBy("id", "grp", "piece").rowsBetween(Window.unboundedPreceding, -1)
    at = pieces.withColumn("own", F.coalesce(F.sum("k").over(own), F.lit(0))).join(starts, ["shard", "chunk"])
    first = F.col("start") + F.col("own")
    return at.withColumn("slot", F.explode(F.sequence(first, first + F.col("k") - 1)))


def assign(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", per: int = PER, fan: int = FAN) -> DataFrame:
    """id, size, text_crc32, shard, slot of each row."""
    rows = checkpoint(groups(df, id_col, text_col))
    placed = numbered(rows.join(shard_of_groups(rows, shards, per, fan), "grp"), shards)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write(df: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """The rows of df, all columns, as Parquet in a folder for each shard; a name like shard of df's own gets underscores."""
    own = [c for c in df.columns if c != "shard"]
    kept = df.withColumnsRenamed({"shard": "shard_"}) if "shard" in df.columns else df
    name = "grp"
    while name in own:
        name += "_"
    where = shard_of_groups(checkpoint(groups(df.withColumn(name, F.lit(0)), name, text_col)), shards).withColumnRenamed("grp", name)
    keyed = kept.withColumn(name, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keyed.join(where, name).drop(name).write.mode("errorifexists").partitionBy("shard").parquet(path)


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

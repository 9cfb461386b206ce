"""Token-id output: best-fit-decreasing packing with a segment tree over remaining capacities.

Documents are dealt to shards by id and text, and encoded there; an end-of-text token closes each. The
number of shards follows from the bytes of all texts, so rows are the same on any cluster and setting. A document longer than a row is split without loss: whole rows of its own, and a rest.
The rests, longest first, go each to the row with the least remaining capacity that holds it, which
the segment tree finds in log(row length) steps. Each row has its ids, the cumulative lengths of its
segments, and the offsets at which positions begin anew.

Null and empty texts are the end token alone, so every row of df is in the output once, repeated rows
as often as they stand there. Ties in length go by id, then text, then place. A null id comes back null.
Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.bpe import default_path, load
from driftgauge.llm.substring import LEAST, id_column, text_groups
from driftgauge.llm.text import documents, lean, text_bytes

LENGTH, END = 2048, "<|endoftext|>"
#: Bytes of text of a shard, on average.
SHARD = 8 << 20


class Capacities:
    """A segment tree: how many open rows have each remaining capacity; finds the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least capacity >= need that a row has, or -1."""
        i, count = need + self.size, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:  # a right neighbour holds larger capacities
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces of each row; sizes are at most length."""
    tree, open_rows, out = Capacities(length), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[i])
        if room < 0:
            row, room = len(out), length
            out.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        out[row].append(i)
        room -= sizes[i]
        if room:
            open_rows.setdefault(room, []).append(row)
            tree.add(room, 1)
    return out


def pack(df: DataFrame, length: int = LENGTH, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_token: str = END) -> DataFrame:
    """One row for each packed row: shard, row, n_tokens, n_segments, input_ids (little-endian 16 or 32 bits,
    filled up with the end token), cu_seqlens, position_resets, and of each segment its id and start in its document."""
    path = path or default_path()
    n = max(1, -(-text_bytes(df, text_col) // SHARD))

    def run(t: pa.Table) -> pa.Table:
        bpe = load(path)
        end_id = bpe.added[end_token]
        wide = "<u2" if bpe.size <= 65536 else "<u4"
        shard = t.column("part")[0].as_py()
        pieces, data = [], []
        for ids, buf, off in text_groups(t):
            flat, at = bpe.encode_bytes(buf, off)
            for i, doc in enumerate(ids.tolist()):
                own = np.append(flat[at[i] : at[i + 1]], end_id).astype(wide)
                for a in range(0, len(own), length):
                    pieces.append((doc, a))
                    data.append(own[a : a + length])
        sizes = [len(x) for x in data]
        out = []
        for row, members in enumerate(best_fit(sizes, length)):
            held = [sizes[i] for i in members]
            cu = np.concatenate(([0], np.cumsum(held)))
            line = np.full(length, end_id, wide)
            line[: cu[-1]] = np.concatenate([data[i] for i in members])
            out.append((shard, row, int(cu[-1]), len(members), line.tobytes(), cu.tolist(), cu[:-1].tolist(), [pieces[i][0] if pieces[i][0] != LEAST else None for i in members], [pieces[i][1] for i in members]))
        names = ["shard", "row", "n_tokens", "n_segments", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"]
        ints = pa.list_(pa.int32())
        types = [pa.int32()] * 4 + [pa.binary(), ints, ints, pa.list_(pa.int64()), ints]
        return pa.table([pa.array(c, ty) for c, ty in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "shard int, row int, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<int>"
    docs = df.select(id_column(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(lean(run), schema)


def write(packed: DataFrame, path: str) -> None:
    """Matrices by shard: each Parquet row is a line of its shard's id matrix, in order."""
    packed.sortWithinPartitions("shard", "row").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position of each token of a row: it begins anew at every reset, and the fill counts on from its start."""
    edge = np.asarray([*cu_seqlens, length] if cu_seqlens[-1] < length else cu_seqlens)
    n = np.diff(edge)
    return np.arange(length) - np.repeat(edge[:-1], n)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

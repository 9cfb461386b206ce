"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Sets are distinct K-word shingles of lower-cased words. Two sets r, s are linked when
|r & s| >= THRESHOLD * |r | s|, so a linked pair shares at least T = ceil(t / (1 + t) * (|r| + |s|))
shingles, and each of its sets has at most floor((1 - t) * n) shingles that the other lacks.

1. Every shingle of every document is dealt by hash to count the documents that hold it; short
   hashes suffice, as an accidental match only keeps a document that could have been left out.
2. A document with more than floor((1 - t) * n) shingles that no other holds cannot link. Of the
   others the floor((1 - t) * n) + 1 rarest shingles are posted, as any linked pair shares one.
3. Sets posted under one shingle are put in one block (components of a star for each shingle).
4. In each block, inverted lists are searched for each set: the L longest lists are kept apart, the
   short ones are merged by heap or counting, sets that reach T - L there are probed by binary
   search in the long lists, and those that reach T are links. A set whose component already spans
   the block's largest one needs no search of its own: links are found from their other end.
5. A block of more than BLOCK sets is cut into chunks, each with the block's leader; sets not linked
   to the leader are then searched in all other chunks, in slices, so that a task holds about BLOCK
   sets of a chunk and BLOCK others, however many there are. No pair is left out, no list cut.

Equal sets are one node, so copies are never expanded. Null, empty and blank texts have an empty
set and link with nothing; a text of fewer than K words has its whole sequence as one shingle. Rows
of equal doc_id are kept apart as rows and fall in one component only when their sets link; a null
doc_id comes back null, and counts as the least number.
"""

from __future__ import annotations

import heapq
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.graph import components, forest
from driftgauge.llm.substring import LEAST, by_doc, cat, rows, table, text_groups, with_bucket
from driftgauge.llm.text import Words, batches, bucket_count, by_bucket, checkpoint, documents, lean, mix, plan_bytes

K, THRESHOLD = 5, (75, 100)
#: Sets that one search task indexes at most; larger blocks are cut into chunks.
BLOCK = 1500
#: Document counts above this are one class of the shingle order, which keeps a task's report small.
HOT = 60


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, in order of text and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def slack(n: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-n * t[0] // t[1])


COUNTED = "key int, kind int, part int, h binary, d binary, n binary, c binary"


def by_runs(ids: np.ndarray, bounds: np.ndarray) -> dict:
    """Columns d and n: the ids of each row's runs of equal ids, and the runs' lengths."""
    new = np.append(True, ids[1:] != ids[:-1])
    new[bounds[:-1]] = True
    at = np.flatnonzero(new)
    got = rows(np.zeros(len(bounds) - 1), np.searchsorted(at, bounds), d=ids[at], n=np.diff(np.append(at, len(ids))).astype("<u4"))
    return {"d": got["d"], "n": got["n"]}


def run_ids(t: pa.Table) -> np.ndarray:
    return np.repeat(cat(t.column("d"), np.int64), cat(t.column("n"), "<u4"))



def packed(h: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of hashes, as rows of bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def unpacked(column, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


class Blob:
    """Rows of bytes that rows() can cut."""

    def __init__(self, x: np.ndarray):
        self.x, self.itemsize = x, x.shape[1]

    def tobytes(self) -> bytes:
        return self.x.tobytes()


def _count(n_buckets: int, n_docs: int, k: int, width: int):
    """Post short hashes of every set; what more than HOT of a batch's documents hold is posted once."""

    def run(frames):
        for batch, buf, off in batches(frames, "text"):
            ids = batch.column("id").to_numpy()
            h, doc = distinct(*Words(buf, off, lower=True).shingles(k))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.append(True, h[1:] != h[:-1])
            n = np.diff(np.append(np.flatnonzero(first), len(h)))
            hot = np.repeat(n > HOT, n)
            parts = []
            for kind, pick in ((0, ~hot), (1, hot & first)):
                hh, dd = h[pick], ids[doc[pick]]
                if len(hh):
                    o, key, at = by_bucket(hh, n_buckets)  # sorted by hash, so by bucket already
                    o = np.lexsort((dd, np.repeat(np.arange(len(key)), np.diff(at))))
                    parts.append(rows(key, at, h=Blob(packed(hh[o], width))) | (by_runs(dd[o], at) if kind == 0 else {}) | {"kind": kind})
            if hot.any():
                hh, dd = h[hot], ids[doc[hot]]
                o, key, at = by_doc(dd, n_docs)
                o = o[np.lexsort((dd[o], np.repeat(np.arange(len(key)), np.diff(at))))]
                parts.append(rows(key % n_buckets, at, h=Blob(packed(hh[o], width)), c=np.full(len(o), HOT + 1, np.uint8)) | by_runs(dd[o], at) | {"kind": 2, "part": pa.array(key, pa.int32())})
            yield from table(COUNTED, *parts).to_batches()

    return run


def _frequencies(n_docs: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        own, rep, local = (t.filter(pa.array(kind == i)) for i in range(3))
        h, d = unpacked(own.column("h"), width), run_ids(own)
        hot = np.unique(unpacked(rep.column("h"), width))
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        if len(hot) and len(h):
            n = np.where(hot[np.minimum(np.searchsorted(hot, h[first]), len(hot) - 1)] == h[first], HOT + 1, n)
        c = np.repeat(np.minimum(n, HOT + 1), np.diff(np.append(first, len(h)))).astype(np.uint8)
        live = c > 1
        parts = []
        if live.any():
            h, d, c = h[live], d[live], c[live]
            o, key, at = by_doc(d, n_docs)
            o = o[np.lexsort((d[o], np.repeat(np.arange(len(key)), np.diff(at))))]
            parts.append(rows(key, at, h=Blob(packed(h[o], width)), c=c[o]) | by_runs(d[o], at) | {"part": pa.array(key, pa.int32())})
        if local.num_rows:
            parts.append({x: local.column(x).combine_chunks() for x in ("h", "d", "n", "c", "part")} | {"key": local.column("part").combine_chunks()})
        return table(COUNTED, *parts)

    return run


SETS = "kind int, id long, n long, sid long, items binary"


def _prefixes(k: int, t: tuple[int, int], width: int, n_buckets: int):
    """kind 0: every document's size and set id; 1: set of a document that may link; 2: its posted shingles, by bucket."""
    cut = np.uint64((1 << (8 * width)) - 1 if width < 8 else 2**64 - 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rd, rc, rh = run_ids(right), cat(right.column("c"), np.uint8), unpacked(right.column("h"), width)
        o = np.lexsort((rh, rd))
        rd, rc, rh = rd[o], rc[o], rh[o]
        infos, sets, posts, seen = [], [], [], set()
        for ids, buf, off in text_groups(left) if left.num_rows else ():
            h, doc = distinct(*Words(buf, off, lower=True).shingles(k))
            n = np.bincount(doc, minlength=len(ids))
            at = np.concatenate(([0], np.cumsum(n)))
            q = slack(n, t)
            sid = np.zeros(len(ids), np.uint64)
            full = n > 0
            if len(h):
                sid[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1][full]) + n[full].astype(np.uint64))
            sid = sid.view(np.int64)
            infos.append((ids, n, sid))
            a, b = np.searchsorted(rd, ids, side="left"), np.searchsorted(rd, ids, side="right")
            for i in np.flatnonzero(full & (b - a >= n - q)).tolist():
                if sid[i] in seen:  # an equal set of this task stands for it
                    continue
                own = h[at[i] : at[i + 1]]
                low = own & cut
                mine = rh[a[i] : b[i]]
                where = np.minimum(np.searchsorted(mine, low), len(mine) - 1)
                c = np.where(mine[where] == low, rc[a[i] : b[i]][where], 1)
                if (c > 1).sum() < n[i] - q[i]:
                    continue
                seen.add(sid[i])
                rank = np.lexsort((own, c))[: q[i] + 1]
                rank = rank[c[rank] > 1]
                sets.append((ids[i], n[i], sid[i], own.astype("<u8").tobytes()))
                posts.append((own[rank], np.full(len(rank), sid[i]), np.full(len(rank), n[i], np.int32)))
        out = []
        if infos:
            x = [np.concatenate(c) for c in zip(*infos, strict=True)]
            out.append((np.zeros(len(x[0]), np.int32), *x, [b""] * len(x[0])))
        if sets:
            x = list(zip(*sets, strict=True))
            out.append((np.ones(len(sets), np.int32), *map(np.array, x[:3]), list(x[3])))
            h, s, m = (np.concatenate(c) for c in zip(*posts, strict=True))
            o, key, at = by_bucket(h, n_buckets)
            raw = np.stack((h[o].view(np.int64), s[o], m[o].astype(np.int64)), 1)
            out.append((np.full(len(key), 2, np.int32), key, np.diff(at), np.zeros(len(key), np.int64), [raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]))
        names = [x.split()[0] for x in SETS.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.concat_tables([pa.table([pa.array(c, ty) for c, ty in zip(x, types, strict=True)], names=names) for x in out]) if out else pa.table([pa.array([], ty) for ty in types], names=names)

    return run


def _stars(t: tuple[int, int]):
    """Edges that join the sets of one posted shingle, neighbours by size, where their sizes can link."""

    def run(tab: pa.Table) -> pa.Table:
        raw = cat(tab.column("items"), np.int64).reshape(-1, 3)
        o = np.lexsort((raw[:, 1], raw[:, 2], raw[:, 0].view(np.uint64)))
        h, s, n = raw[o, 0], raw[o, 1], raw[o, 2]
        same = (h[1:] == h[:-1]) & (s[1:] != s[:-1]) & (n[:-1] * t[1] >= n[1:] * t[0])
        a, b = forest(s[:-1][same], s[1:][same]) if same.any() else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a, "b": b})

    return run


def needed(n: int, m: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Shared shingles that sets of n and m need at least: ceil(t (n + m) / (1 + t))."""
    return -(-(n + m) * t[0] // (t[0] + t[1]))


def heap_merge(lists: list[np.ndarray]) -> dict[int, int]:
    """How often each member occurs in sorted lists, by a heap of their heads."""
    heads = [(int(x[0]), i, 0) for i, x in enumerate(lists) if len(x)]
    heapq.heapify(heads)
    out: dict[int, int] = {}
    while heads:
        member, i, at = heads[0]
        out[member] = out.get(member, 0) + 1
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heads, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heads)
    return out


class Index:
    """Inverted lists of sets, numbered in order of size."""

    def __init__(self, sets: list[np.ndarray], t: tuple[int, int] = THRESHOLD):
        self.t, self.sizes = t, np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(flat, kind="stable")  # members of a list stay sorted
        flat, self.members = flat[order], who[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        self.keys, self.at = flat[first], np.append(first, len(flat))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the sets linked with the query, by DivideSkip."""
        n = len(query)
        if not len(self.keys) or not n:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        lengths = self.at[at + 1] - self.at[at]
        low, high = -(-n * self.t[0] // self.t[1]), n * self.t[1] // self.t[0]
        least = int(needed(n, np.array(low), self.t))  # the smallest T of any set that can link
        if len(at) < least:
            return np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths[order[0]])
        n_long = min(least - 1, int(least / (0.0085 * log2(max(longest, 2)) + 1)))
        long, short = at[order[:n_long]], at[order[n_long:]]
        spans = [self.members[self.at[i] : self.at[i + 1]] for i in short]
        total = sum(map(len, spans))
        if total <= 64:
            count = heap_merge(spans)
            who = np.fromiter(count.keys(), np.int64, len(count))
            seen = np.fromiter(count.values(), np.int64, len(count))
        else:
            counts = np.bincount(np.concatenate(spans), minlength=len(self.sizes))
            who = np.flatnonzero(counts)
            seen = counts[who]
        size = self.sizes[who]
        want = needed(n, size, self.t)
        keep = (size >= low) & (size <= high) & (seen >= want - n_long)
        who, seen, want = who[keep], seen[keep], want[keep]
        for i in long:  # binary probes of the long lists, for those that can still reach T
            if not len(who):
                break
            span = self.members[self.at[i] : self.at[i + 1]]
            place = np.minimum(np.searchsorted(span, who), len(span) - 1)
            seen = seen + (span[place] == who)
        return who[seen >= want]


def search_block(ids: np.ndarray, sets: list[np.ndarray], t: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join all sets of a block whose links join them; ids in the order of sets."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = ids[order], [sets[i] for i in order]
    index = Index(sets, t)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size, links, largest = [1] * len(sets), [], 0
    skipped = False
    todo = list(range(len(sets)))
    middle = len(sets) // 2
    todo[0], todo[middle] = todo[middle], todo[0]
    for i in todo:
        if find(i) == find(largest) and size[find(largest)] > 1:
            skipped = True  # what it links with outside is found from there
            continue
        for j in index.search(sets[i]).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                size[a] += size[b]
                links.append((int(ids[i]), int(ids[j])))
                if size[a] > size[find(largest)]:
                    if skipped and find(largest) != a:
                        return _all_links(ids, sets, index)  # the largest changed: search from every set
                    largest = a
    return links


def _all_links(ids, sets, index):
    return [(int(ids[i]), int(ids[j])) for i in range(len(sets)) for j in index.search(sets[i]).tolist() if i != j]


def _search(t: tuple[int, int]):
    """Spanning links of the blocks of a bucket."""

    def run(tab: pa.Table) -> pa.Table:
        block, chunk = tab.column("block").to_numpy(), tab.column("chunk").to_numpy()
        sid, items, far = tab.column("sid").to_numpy(), tab.column("items"), tab.column("far").to_numpy(zero_copy_only=False)
        o = np.lexsort((sid, chunk, block))
        edge = np.flatnonzero(np.append(True, (block[o][1:] != block[o][:-1]) | (chunk[o][1:] != chunk[o][:-1]))) if len(o) else np.zeros(0, np.int64)
        a, b = [], []
        for x, y in zip(edge, np.append(edge[1:], len(o)), strict=True):
            own = o[x:y]
            own = own[np.append(True, sid[own][1:] != sid[own][:-1])]
            if len(own) < 2:
                continue
            sets = [np.frombuffer(items[int(i)].as_py(), "<u8") for i in own]
            if far[own].any():  # sets of other chunks, searched in this one
                here = np.flatnonzero(~far[own])
                index = Index([sets[i] for i in here], t)
                links = [(int(sid[own[i]]), int(sid[own[here[j]]])) for i in np.flatnonzero(far[own]) for j in index.search(sets[i]).tolist()]
            else:
                links = search_block(sid[own], sets, t)
            if links:
                u, v = forest(*np.array(links, np.int64).T)
                a.append(u)
                b.append(v)
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return run


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id of each row: the least id that links reach."""
    n_buckets, n_docs = bucket_count(df, 2.0), bucket_count(df, 2.0)
    width = min(8, max(5, ceil((log2(max(plan_bytes(df), 1)) + 10) / 8)))
    docs = with_bucket(df, id_col, text_col, n_docs)
    posted = docs.select("id", "text").mapInArrow(_count(n_buckets, n_docs, k, width), COUNTED)
    counts = posted.groupBy("key").applyInArrow(lean(_frequencies(n_docs, width)), COUNTED)
    made = docs.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(lean(_prefixes(k, threshold, width, n_buckets)), SETS)
    made = checkpoint(made)

    stars = made.where("kind = 2").groupBy("id").applyInArrow(lean(_stars(threshold)), "a long, b long")
    blocks = checkpoint(components(stars))
    sets = made.where("kind = 1").groupBy("sid").agg(F.max("items").alias("items"))
    sizes = blocks.groupBy("component").agg(F.count("*").alias("members")).select("component", F.ceil(F.col("members") / block).cast("int").alias("chunks"))
    inside = blocks.join(sizes, "component").join(sets, F.col("node") == F.col("sid"))
    chunk = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    inside = inside.select(F.col("component").alias("block"), F.explode(chunk).alias("chunk"), "chunks", "sid", "items", F.lit(False).alias("far"))
    keyed = F.pmod(F.xxhash64("block", "chunk"), F.lit(n_buckets))
    links = inside.groupBy(keyed.alias("key")).applyInArrow(lean(_search(threshold)), "a long, b long")
    large = sizes.where("chunks > 1")
    if large.limit(1).count():
        links = checkpoint(links)
        near = components(links)
        wide = blocks.join(large, "component")
        led = wide.join(near.withColumnRenamed("component", "own"), "node", "left").select("node", "component", "chunks", F.coalesce("own", "node").alias("own"))
        leader = led.where("node = component").select("component", F.col("own").alias("main"))
        rest = led.join(leader, "component").where("own <> main")
        rest = checkpoint(rest.select("component", "node", "chunks"))
        cuts = rest.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("slices"))  # only blocks with such sets
        home = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        away = rest.join(cuts, "component").join(sets, F.col("node") == F.col("sid")).select(F.col("component").alias("block"), home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("slices")).cast("int").alias("slice"), "sid", "items", F.lit(True).alias("far"))
        away = away.where("home <> chunk").drop("home")
        here = inside.join(cuts, F.col("block") == F.col("component")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*away.columns)
        more = here.unionByName(away).groupBy("block", "chunk", "slice").applyInArrow(lean(_search(threshold)), "a long, b long")
        links = links.union(more)
    reach = components(links)
    info = made.where("kind = 0").select("id", "n", "sid")
    # what a component is, is settled for each distinct set; rows then join a written table, which a hot set cannot skew
    sets = info.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    sets = sets.join(reach.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("g", F.coalesce("component", "sid"))
    least = sets.groupBy("g").agg(F.min("least").alias("component_id"))
    settled = checkpoint(sets.join(least, "g").select(F.col("sid").alias("set_id"), "component_id"))
    out = info.join(settled, F.when(F.col("n") > 0, F.col("sid")) == F.col("set_id"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return out.select(null("id").alias(id_col), "n_shingles", null("component_id").alias("component_id"))


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))

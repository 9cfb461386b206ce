"""Substring dedup: relative Lempel-Ziv parsing of documents against indexed reference blocks.

A window is SIZE consecutive words. The windows of all documents are dealt to reference blocks by
content, and each block indexes the first occurrence of every window. A document is then parsed
greedily, left to right: a factor begins at a window that the index has earlier, and is the longest
run from there whose windows the index has one after the other, so that it copies `windows + SIZE - 1`
words from (ref_doc, ref_start). Where a factor ends, the windows across the boundary are looked up
as well, and begin factors of their own. Every factor is long enough to be a duplicate span, and the
words that factors cover are removed. All references are the corpus's first occurrences, so factors
depend on the rows alone, not on blocks or tasks.

Windows that cannot repeat are not dealt. Each window is owned by the least hash of its GRAM-word
sequences; a hash that occurs in one place of the whole corpus owns no repeated window. So pass one
counts owner hashes, pass two deals the windows of those seen twice, and pass three removes words.
What repeats inside one task's documents is settled there: a block gets each window once a task, so
a passage that a third of all rows hold is spread like any other.

Order is (doc_id, start); ids are integers. Null and empty texts have no words. Rows of equal doc_id count as one
place for the order and get the factors of both; a null doc_id counts as the least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import Words, batches, bucket_count, by_bucket, documents, lean, mix, powers, slices, string_bytes

SIZE, GRAM = 20, 5
LEAST = -(2**63)


def windows(w: Words, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word index of the start of each window, its hash, its owner hash, and where the first such owner is in it."""
    h, total = w.hash, len(w.hash)
    if total < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    c = powers(size + 2)
    n = total - size + 1
    left = w.first[w.doc[:n] + 1] - np.arange(n)
    starts = np.flatnonzero(left >= size)
    full = np.zeros(n, np.uint64)
    for j in range(size):
        full += h[j : j + n] * c[j + 1]
    g = np.zeros(total - gram + 1, np.uint64)
    for j in range(gram):
        g += h[j : j + len(g)] * c[j + 1]
    least, span, want = mix(g), 1, size - gram + 1
    place = np.arange(len(least), dtype=np.int32)
    while span < want:
        step = min(span, want - span)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        span += step
    return starts, mix(full)[starts], least[starts], place[starts]


#: The multipliers of the 64-bit hash that Spark's xxhash64 takes of a long, and its seed: fixed values.
XX1, XX2, XX3, XX4, XX5, XX_SEED = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 42


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(id), n), as with_bucket has it."""
    u = np.uint64
    turn = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    h = turn(ids.astype(np.int64).view(u) * u(XX2), 31) * u(XX1) ^ u((XX_SEED + XX5 + 8) % 2**64)
    h = turn(h, 27) * u(XX1) + u(XX4)
    h = (h ^ (h >> u(33))) * u(XX2)
    h = (h ^ (h >> u(29))) * u(XX3)
    return (h ^ (h >> u(32))).view(np.int64) % n


def id_column(col):
    """Ids as integers: one that is no integer, as a text may be, counts as null, and the least integer stands for null."""
    return F.coalesce(F.col(col).try_cast("long"), F.lit(LEAST))


def with_bucket(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    out = df.select(id_column(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def rows(key: np.ndarray, bounds: np.ndarray, **arrays: np.ndarray) -> dict:
    """A row of bytes for each key, from arrays in the keys' order."""
    out = {"key": pa.array(key, pa.int32())}
    for name, x in arrays.items():
        raw, k = x.tobytes(), x.itemsize
        out[name] = pa.array([raw[a * k : b * k] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
    return out


def cat(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def by_doc(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = doc_bucket(ids, n)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, part[at], np.append(at, len(part))


def table(schema: str, *parts: dict) -> pa.Table:
    """One table of the parts' rows; absent binary columns are empty."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: {"int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")}
    made = []
    for p in parts:
        n = len(p["key"])
        cols = []
        for name in names:
            if name in p:
                v = p[name]
                cols.append(v.cast(kinds[name]) if isinstance(v, pa.Array) else pa.array([v] * n, kinds[name]))
            else:
                cols.append(pa.array([b"" if kinds[name] == pa.binary() else 0] * n, kinds[name]))
        made.append(pa.table(cols, names=names))
    return pa.concat_tables(made) if made else pa.table([pa.array([], kinds[x]) for x in names], names=names)


OWNERS = "key int, kind int, part int, h binary, d binary"
DEALT = "key int, kind int, part int, h binary, d binary, s binary, n binary, rd binary, rs binary"


def _owners(n_buckets: int, n_docs: int, size: int, gram: int):
    def run(frames):
        for batch, buf, off in batches(frames, "text"):
            ids = batch.column("id").to_numpy()
            w = Words(buf, off, lower=False)
            start, _, own, place = windows(w, size, gram)
            if not len(start):
                continue
            doc = w.doc[start]
            new = np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))
            own, doc = own[new], doc[new]  # a run of windows that one place owns
            order = np.argsort(own, kind="stable")
            own, doc = own[order], doc[order]
            first = np.append(True, own[1:] != own[:-1])
            size_of = np.diff(np.append(np.flatnonzero(first), len(own)))
            many = np.repeat(size_of > 1, size_of)
            once, rep = ~many, first & many
            parts = []
            for kind, pick in ((0, once), (1, rep)):
                h, d = own[pick], ids[doc[pick]]
                o, key, at = by_bucket(h, n_buckets)
                if len(h):
                    parts.append(rows(key, at, h=h[o], **({"d": d[o]} if kind == 0 else {})) | {"kind": kind})
            if many.any():
                h, d = own[many], ids[doc[many]]
                o, key, at = by_doc(d, n_docs)
                parts.append(rows(key % n_buckets, at, h=h[o], d=d[o]) | {"kind": 2, "part": pa.array(key, pa.int32())})
            yield from table(OWNERS, *parts).to_batches()

    return run


def _seen_twice(n_docs: int):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        parts = []
        once, rep = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
        h, d = cat(once.column("h"), np.uint64), cat(once.column("d"), np.int64)
        known = np.unique(cat(rep.column("h"), np.uint64))
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        live = np.repeat(n > 1, n)
        if len(known) and len(h):
            live |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        if live.any():
            h, d = h[live], d[live]
            o, key, at = by_doc(d, n_docs)
            parts.append(rows(key, at, h=h[o]) | {"kind": 3, "part": pa.array(key, pa.int32())})
        local = t.filter(pa.array(kind == 2))
        if local.num_rows:
            parts.append({"key": local.column("part").combine_chunks(), "h": local.column("h").combine_chunks(), "kind": 3, "part": local.column("part").combine_chunks()})
        return table(OWNERS, *parts)

    return run


def runs(d, s, rd, rs) -> tuple[np.ndarray, ...]:
    """Factors: runs of starts, ordered by (document, start), that continue one reference."""
    if not len(d):
        return d, s, np.zeros(0, np.int32), rd, rs
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1) | (rd[1:] != rd[:-1]) | (rs[1:] != rs[:-1] + 1))
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d))).astype(np.int32), rd[at], rs[at]


def parsed(d, s, n, rd, rs) -> tuple[np.ndarray, ...]:
    """Greedy factors from what the blocks and a task's own documents report of some documents.

    A window that is repeated within the task has its reference there; where that is a copy itself, what it
    copies is the reference.
    """
    if not len(d):
        return d, s, n, rd, rs
    one = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    d, s, rd, rs = np.repeat(d, n), np.repeat(s, n) + one, np.repeat(rd, n), np.repeat(rs, n) + one
    o = sorted_by(d, s, rd, rs)
    d, s, rd, rs = d[o], s[o], rd[o], rs[o]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
    d, s, rd, rs = d[new], s[new], rd[new], rs[new]
    ids, code = np.unique(d, return_inverse=True)
    width = int(max(s.max(), rs.max())) + 1
    place = code * width + s
    who = np.minimum(np.searchsorted(ids, rd), len(ids) - 1)
    for _ in range(2):  # a reference within the task is a first occurrence there, so one step is enough; the second finds none
        of = who * width + rs
        at = np.minimum(np.searchsorted(place, of), len(place) - 1)
        copy = (ids[who] == rd) & (place[at] == of)
        if not copy.any():
            break
        rd, rs = np.where(copy, rd[at], rd), np.where(copy, rs[at], rs)
        who = np.minimum(np.searchsorted(ids, rd), len(ids) - 1)
    return runs(d, s, rd, rs)


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def text_groups(t: pa.Table):
    """(ids, bytes, offsets) of rows in order of id and text, so much text at a time."""
    t = t.sort_by([("id", "ascending"), ("text", "ascending")])
    buf, off = string_bytes(t.column("text"))
    ids = t.column("id").to_numpy()
    for a, b in slices(np.diff(off)):
        yield ids[a:b], buf[off[a] : off[b]], off[a : b + 1] - off[a]


def first_of_each(h, d, s):
    """Indexes of first occurrences by (document, start), and for the others (index, that of the first)."""
    order = sorted_by(h, d, s)
    hs = h[order]
    first = np.append(True, hs[1:] != hs[:-1]) if len(hs) else np.zeros(0, bool)
    head = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(hs) else order
    same = ~first & (d[order] == d[head]) & (s[order] == s[head])  # another row of the same id
    other = ~first & ~same
    return order[first], order[other], head[other]


def factor_rows(d, s, rd, rs, n_docs: int) -> dict | None:
    if not len(d):
        return None
    o = sorted_by(d, s)
    d, s, n, rd, rs = runs(d[o], s[o], rd[o], rs[o])
    o, key, at = by_doc(d, n_docs)
    return rows(key, at, d=d[o], s=s[o].astype(np.int32), n=n[o], rd=rd[o], rs=rs[o].astype(np.int32)) | {"part": pa.array(key, pa.int32())}


def _deal(n_buckets: int, n_docs: int, size: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        live = np.unique(cat(right.column("h"), np.uint64))
        if not len(live) or not left.num_rows:
            return table(DEALT)
        got = []
        for ids, buf, off in text_groups(left):
            w = Words(buf, off, lower=False)
            start, h, own, _ = windows(w, size, gram)
            keep = live[np.minimum(np.searchsorted(live, own), len(live) - 1)] == own
            start, h, own = start[keep], h[keep], own[keep]
            got.append((h, ids[w.doc[start]], start - w.first[w.doc[start]]))
        h, d, s = (np.concatenate(x) for x in zip(*got, strict=True))
        first, other, head = first_of_each(h, d, s)
        parts = []
        if len(first):
            hh, dd, ss = h[first], d[first], s[first].astype(np.int32)
            o, key, at = by_bucket(hh, n_buckets)
            parts.append(rows(key, at, h=hh[o], d=dd[o], s=ss[o]) | {"kind": 0})
        if found := factor_rows(d[other], s[other], d[head], s[head], n_docs):
            found["key"] = pa.array(found["part"].to_numpy() % n_buckets, pa.int32())
            parts.append(found | {"kind": 1})
        return table(DEALT, *parts)

    return run


def _index(n_docs: int):
    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        own = t.filter(pa.array(kind == 0))
        h, d, s = cat(own.column("h"), np.uint64), cat(own.column("d"), np.int64), cat(own.column("s"), np.int32)
        _, other, head = first_of_each(h, d, s)
        parts = []
        if found := factor_rows(d[other], s[other], d[head], s[head], n_docs):
            parts.append(found | {"kind": 1})
        local = t.filter(pa.array(kind == 1))
        if local.num_rows:
            parts.append({c: local.column(c).combine_chunks() for c in ("part", "d", "s", "n", "rd", "rs")} | {"key": local.column("part").combine_chunks(), "kind": 1})
        return table(DEALT, *parts)

    return run


def _remove(size: int, keep_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        d, s, n = cat(right.column("d"), np.int64), cat(right.column("s"), np.int32), cat(right.column("n"), np.int32)
        rd, rs = cat(right.column("rd"), np.int64), cat(right.column("rs"), np.int32)
        d, s, n, rd, rs = parsed(d, s.astype(np.int64), n, rd, rs.astype(np.int64))
        out = {k: [] for k in ("id", "n_words", "n_removed", "kept_sha256", "kept", "factors")}
        for ids, buf, off in text_groups(left) if left.num_rows else ():
            w = Words(buf, off, lower=False)
            a, b = np.searchsorted(d, ids, side="left"), np.searchsorted(d, ids, side="right")
            edge = np.zeros(len(w.starts) + 1, np.int64)
            for i in np.flatnonzero(b > a).tolist():
                base, last = w.first[i], w.first[i + 1]
                np.add.at(edge, np.minimum(base + s[a[i] : b[i]], last), 1)
                np.add.at(edge, np.minimum(base + s[a[i] : b[i]] + n[a[i] : b[i]] + size - 1, last), -1)
            kept = np.cumsum(edge)[:-1] == 0
            at, length = w.starts[kept], (w.ends - w.starts)[kept] + 1
            to = np.cumsum(length)
            total = int(to[-1]) if len(to) else 0
            new = np.append(buf, np.uint8(32))[np.minimum(np.repeat(at - (to - length), length) + np.arange(total), len(buf))]
            new[to - 1] = 32
            count = np.bincount(w.doc[kept], minlength=w.n)
            cut = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(count)))]
            raw = new.tobytes()
            for i in range(w.n):
                text = raw[cut[i] : max(cut[i], cut[i + 1] - 1)]
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    out["kept"].append(text.decode("utf-8", "replace"))
                    out["factors"].append([{"start": int(x), "words": int(y) + size - 1, "ref_doc": int(u), "ref_start": int(v)} for x, y, u, v in zip(s[a[i] : b[i]], n[a[i] : b[i]], rd[a[i] : b[i]], rs[a[i] : b[i]], strict=True)])
            out["id"].append(ids)
            out["n_words"].append(w.count)
            out["n_removed"].append(w.count - count)
        cols = {k: np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("id", "n_words", "n_removed")}
        t = pa.table({k: pa.array(v, pa.int64()) for k, v in cols.items()} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())})
        if keep_text:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
            t = t.append_column("kept", pa.array(out["kept"], pa.string())).append_column("factors", pa.array(out["factors"], kind))
        return t

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row, and with keep_text the kept words and the factors."""
    n_buckets = bucket_count(df, 0.5)
    n_docs = bucket_count(df, 2.0)
    docs = with_bucket(df, id_col, text_col, n_docs)
    owners = docs.select("id", "text").mapInArrow(_owners(n_buckets, n_docs, size, gram), OWNERS)
    live = owners.groupBy("key").applyInArrow(lean(_seen_twice(n_docs)), OWNERS)
    dealt = docs.groupBy("part").cogroup(live.groupBy("part")).applyInArrow(lean(_deal(n_buckets, n_docs, size, gram)), DEALT)
    factors = dealt.groupBy("key").applyInArrow(lean(_index(n_docs)), DEALT)
    more = ", kept string, factors array<struct<start:int,words:int,ref_doc:bigint,ref_start:int>>" if keep_text else ""
    out = docs.groupBy("part").cogroup(factors.groupBy("part")).applyInArrow(lean(_remove(size, keep_text)), f"id long, n_words long, n_removed long, kept_sha256 string{more}")
    return out.withColumn("id", F.when(F.col("id") != LEAST, F.col("id"))).withColumnRenamed("id", id_col)


def op10_substring(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), keep_text=False)

"""LM scoring by online logistic context mixing, beside a smoothed unigram base.

`mixed_score`, which op9 is: before each word a bit says whether the text ends, another whether the word comes that anchors foretell (1 below),
where they foretell one; of every word that is not so told all bytes are coded by hashed-context bit predictors, mixed online along the text
(contexts.py). Known and new words alike are so coded; none is scored by its frequency.

`score` is the plainer form, by words and their frequency, with predictors for new words alone; no query uses it. In it a text is coded as a stream of bits, word by word:

1. hit: is this the word that the corpus has most often after the same words? Anchors, chosen by content so that
   none is more than SPAN words from the next, are the places that carry this context: an anchor is three words, and it
   predicts the words up to the next anchor. Every anchor of the training texts is gathered, so what is learned grows
   with the corpus. A text never predicts itself: its own occurrence is taken out, but for what stands earlier in it.
2. known: is the word one of the lexicon, which holds every training word but those of this text alone? If so its
   frequency there codes it. The flag's probability is refined along the text by what the text has shown so far.
3. else the bytes of the word, and an end-of-word byte, most significant bit first, by four predictors, one for each
   hashed context (the last one to four bytes), with counts from all distinct training words.

The bit predictors' logits are mixed by weights which a gate selects (bytes: how well the contexts have been seen; hits:
whether the words before were hit), refined online in the order of the stream by the gradient of the coding cost; an
adaptive probability map over (bits so far in the byte, mixed logit) corrects the bytes' bits. A text's score is the log10
probability of all its tokens; bits_per_byte is its cost over its bytes.

Counts are integers, added up; weights are learned in shards whose number follows from the bytes of the texts, and merged in
their order. So scores depend on the rows alone (to rounding), not on partitions, settings or retries. Words are dealt by
hash; a batch sends a word once, however often it has it, and equal anchors with equal words behind them once.

Tokens are the words of the text with A-Z lower-cased, then one end. Null and empty texts are the end alone. Rows of equal id
are texts of their own; ids are integers. A null id is never held out. Words, predicted ones too, are told apart by a 64-bit hash, so a hit is
that word and no other, and what all words could have cost sums to no more than one; anchors by 48 bits of theirs, where two that meet would
share their predictions. With no training rows all counts are 0, and every word is spelled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm import contexts
from driftgauge.llm.substring import LEAST, id_column
from driftgauge.llm.text import _LOWER, Words, batches, by_bucket, checkpoint, documents, frugal, lean, mix, powers, slices, text_bytes, trim

ORDERS = 4
#: log2 of the slots of each predictor of bytes; a hashed line of 16 slots holds the nodes of a nibble.
BITS = (16, 18, 20, 20)
DELTA, GATES, BINS = 0.35, 16, 33
#: A predictor's weight before anything is learned.
FIRST = 0.3
#: Words of an anchor, words between two anchors at most, and the classes of a prediction: support, agreement, and what came before.
LEAD, SPAN, SUPPORT, AGREE, STATES = 3, 12, 7, 3, 3
CELLS = SUPPORT * AGREE * STATES * SPAN
#: How many words of a text weigh as much as the corpus in the known flag.
PRIOR = 20.0
#: Bytes of text for each bucket of words and of anchors, so that their number is a function of the rows alone.
SHARD = 16 << 20
#: Freed memory that a worker keeps within a batch, whose arrays are made and dropped again and again.
ROOM = 64 << 20
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_V = np.arange(16)
_NODE = np.stack((np.ones(16, np.int64), 2 + (_V >> 3), 4 + (_V >> 2), 8 + (_V >> 1)), 1).astype(np.int32)
TOP = np.uint64(2**64 - 1)


# ---- the bits of spelled words


def steps(raw: np.ndarray, sizes: np.ndarray):
    """Per coded byte of the words, end-of-word included: its word, value, and the slots of its eight bits in each predictor."""
    n = sizes + 1
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(sizes)), n)
    total = int(n.sum())
    x = np.full(total, 32, np.uint8)
    inner = np.ones(total, bool)
    inner[first + sizes] = False
    x[inner] = raw
    rel = np.arange(total) - first[word]
    high, low = (x >> 4).astype(np.int64), x & 15
    node = np.concatenate((_NODE[high], _NODE[low]), 1)
    step = mix(high.astype(np.uint64) + np.uint64(0x51))
    out, acc = [], np.zeros(total, np.uint64)
    for k in range(ORDERS):
        prev = np.zeros(total, np.uint64)
        prev[k + 1 :] = x[: -k - 1]
        acc = (acc << np.uint64(9)) | np.where(rel > k, prev + np.uint64(1), np.uint64(0))
        h = mix(acc * _SALT[k])
        shift = np.uint64(64 - BITS[k] + 4)
        lines = np.stack((h >> shift, (h ^ step) * _SALT[0] >> shift), 1).astype(np.int32) << 4
        out.append((np.repeat(lines, 4, 1) | node).ravel())
    return word, x, out


def bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x)


def fresh() -> list[np.ndarray]:
    return [np.zeros((1 << b, 2), np.int64) for b in BITS]


def groups(lengths: np.ndarray, most: int):
    """Runs of words of so many coded bytes at most, or of one word."""
    total = np.cumsum(lengths + 1)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def count_words(tables: list[np.ndarray], raw, sizes) -> None:
    """Add the words' bits to the tables."""
    _, x, slots = steps(raw, sizes)
    y = bits(x)
    for t, slot in zip(tables, slots, strict=True):
        t.reshape(-1)[:] += np.bincount(slot.astype(np.int64) * 2 + y, minlength=t.size)


def logits(tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each slot's logit of a one, and the log2 of its count."""
    out = []
    for t in tables:
        z = np.log((t[:, 1] + DELTA) / (t[:, 0] + DELTA))
        out.append((np.clip(z, -10, 10).astype(np.float32), np.minimum(np.log2(t.sum(1) + 1.0), 15).astype(np.uint8)))
    return out


def inputs(model, slots) -> tuple[np.ndarray, np.ndarray]:
    """The predictors' logits for each bit, and the gate."""
    s = np.stack([m[0][at] for m, at in zip(model, slots, strict=True)])
    seen = [np.minimum((model[k][1][slots[k]] + 1) // 2, 3).astype(np.int32) for k in (2, 3)]
    return s, seen[1] * 4 + seen[0]


def squash(z):
    return 1 / (1 + np.exp(-z))


def stretch(p):
    return np.log(p / (1 - p))


class Mixer:
    """Gated weights and the adaptive probability map."""

    def __init__(self, weights=None, apm=None):
        self.w = np.full((GATES, ORDERS), FIRST, np.float32) if weights is None else weights.astype(np.float32)
        if apm is None:
            p = squash(np.linspace(-8, 8, BINS))
            apm = np.repeat(np.stack((1 - p, p), 1)[None] * 20.0, 256, 0)
        self.apm = apm
        self.seen, self.power = np.zeros(GATES), np.full((GATES, ORDERS), 1e-6)
        self.curve = (apm[..., 1] / apm.sum(-1)).astype(np.float32)

    def predict(self, s, gate, x):
        """Mixed logit's probability, the refined one, and the map's cell."""
        z = np.zeros(s.shape[1], np.float32)
        for k in range(len(s)):
            z += s[k] * self.w[:, k][gate]
        np.clip(z, -12, 12, out=z)
        at = (np.clip(z, -8, 8) + 8) * np.float32((BINS - 1) / 16)
        low = np.minimum(at.astype(np.int32), BINS - 2)
        frac = at - low
        part = ((np.uint8(128) | x[:, None] >> np.uint8(1)) >> (np.arange(7, -1, -1, dtype=np.uint8))).ravel()
        cell = part.astype(np.int32) * BINS + low
        curve = self.curve.ravel()
        left = curve[cell]
        refined = left + (curve[cell + 1] - left) * frac
        p = squash(z)
        return p, np.clip(0.6 * p + 0.4 * refined, 1e-6, 1 - 1e-6), cell + (frac > 0.5)

    def learn(self, s, gate, x, rate: float = 0.06) -> None:
        """One online step over a run of words: weights against the gradient of the coding cost, and the map's counts."""
        y = bits(x)
        p, _, cell = self.predict(s, gate, x)
        g = y - p
        for k in range(ORDERS):
            step = np.bincount(gate, g * s[k], GATES)
            self.power[:, k] += step**2
            self.w[:, k] += (rate * step / np.sqrt(self.power[:, k])).astype(np.float32)
        np.clip(self.w, -3, 8, out=self.w)
        self.seen += np.bincount(gate, minlength=GATES)
        self.apm.reshape(-1, 2)[:] += np.bincount(cell * 2 + y, minlength=self.apm.size).reshape(-1, 2)
        self.curve = (self.apm[..., 1] / self.apm.sum(-1)).astype(np.float32)


def word_logs(model, mixer: Mixer, raw, sizes) -> np.ndarray:
    """log10 probability of each word with its end, when spelled."""
    out = np.empty(len(sizes))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in groups(sizes, 40_000):
        word, x, slots = steps(raw[at[a] : at[b]], sizes[a:b])
        s, gate = inputs(model, slots)
        p = mixer.predict(s, gate, x)[1]
        cost = np.log10(np.where(bits(x) == 1, p, 1 - p)).reshape(-1, 8).sum(1)
        out[a:b] = np.bincount(word, cost, b - a)
    return out


# ---- anchors


def anchors(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words with these hashes: where anchors begin, the words that each predicts, and their keys.

    Of SPAN neighbouring runs of LEAD words that of least hash is an anchor; it predicts the words behind it up to those
    behind the next one.
    """
    n = np.maximum(count - LEAD, 0)  # there is a word to predict behind each run
    doc = np.repeat(np.arange(len(count)), n)
    rel = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(count) - count)[doc] + rel
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    key = mix(h[at] * _SALT[1] + h[at + 1] * _SALT[2] + h[at + 2] * _SALT[3])
    room = np.arange(len(at)) + doc * SPAN  # with SPAN places of no run behind each text
    least = np.full(int(room[-1]) + 1 + SPAN, TOP, np.uint64)
    least[room] = key
    place = np.arange(len(least))
    span = 1
    while span < SPAN:
        step = min(span, SPAN - span)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        span += step
    back = np.full(len(least) + SPAN, -1)
    back[room] = np.arange(len(at))
    taken = np.zeros(len(at), bool)
    taken[back[place[room]]] = True
    chosen = np.flatnonzero(taken)
    after = np.append(chosen[1:], -1)
    own = doc[chosen]
    same = np.append(own[1:] == own[:-1], False)
    end = np.where(same, at[after] + LEAD, np.cumsum(count)[own])
    # least hashes are small numbers, so they are mixed again before they are dealt by their high bits
    return at[chosen], np.minimum(end - at[chosen] - LEAD, SPAN), mix(key[chosen] ^ _SALT[0])


def followers(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of SPAN hashes of the words that each anchor predicts, 0 behind the last."""
    col = np.arange(SPAN)
    live = col[None] < n[:, None]
    where = np.minimum(at[:, None] + LEAD + col[None], len(h) - 1)
    return np.where(live, h[where], np.uint64(0))


def anchor_rows(h: np.ndarray, count: np.ndarray, train: np.ndarray):
    """Distinct (key, words, own) of a batch's anchors: key, number of words, their hashes, own, how many; and of each anchor
    its row, place, and number of words. own: the first with its key in a training text, which alone adds to the counts."""
    at, n, key = anchors(h, count)
    doc = np.searchsorted(np.cumsum(count), at, side="right")
    prints = followers(h, at, n)
    order = np.lexsort((at, key, doc))
    first = np.zeros(len(at), bool)
    k, d = key[order], doc[order]
    first[order] = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(at) else False
    own = first & (train[doc] if len(at) else first)
    row = key + n.astype(np.uint64) * _SALT[3]
    for j in range(SPAN):
        row += prints[:, j] * powers(SPAN + 1)[j + 1]
    row = mix(row)
    _, where, code, many = np.unique(row ^ own.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
    return key[where], n[where], prints[where], own[where], many, code, at, n


def predicted(key: np.ndarray, n: np.ndarray, prints: np.ndarray, own: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each anchor row and place: 0 without a prediction, else 1 + hit + 2 * (agreement + AGREE * support).

    The prediction is the word that most other own rows of the key have there, that of least hash of equals.
    """
    out = np.zeros((len(key), SPAN), np.uint8)
    _, code = np.unique(key, return_inverse=True)
    able = np.zeros(len(key), bool)
    if len(key):
        asked = np.bincount(code, np.bincount(code, many * own)[code] - own > 0) > 0  # keys of which a row has others
        able = asked[code]
    live = np.flatnonzero(able)
    if not len(live):
        return out
    _, code = np.unique(code[live], return_inverse=True)
    n, prints, own, many = n[live], prints[live], own[live], many[live] * own[live]
    for j in range(int(n.max())):
        here = np.flatnonzero(n > j)
        g, p = code[here], prints[here, j]
        sort = np.lexsort((p, g))
        gs, ps = g[sort], p[sort]
        new = np.append(True, (gs[1:] != gs[:-1]) | (ps[1:] != ps[:-1]))
        back = np.empty(len(here), np.int64)
        back[sort] = np.cumsum(new) - 1
        whose, word = gs[new], ps[new]  # distinct pairs of a key and a word
        votes = np.bincount(back, many[here]).astype(np.int64)
        total = np.bincount(whose, votes, int(g.max()) + 1).astype(np.int64)
        order = np.lexsort((word, -votes, whose))  # by key: most votes, then least hash
        head = np.flatnonzero(np.append(True, whose[order][1:] != whose[order][:-1]))
        slot = np.zeros(int(g.max()) + 1, np.int64)
        slot[whose[order][head]] = head
        top = order[slot[g]]
        second = np.minimum(slot[g] + 1, len(order) - 1)
        has = (slot[g] + 1 < len(order)) & (whose[order[second]] == g)
        n1, n2 = votes[top], np.where(has, votes[order[second]], 0)
        p1, p2 = word[top], word[order[second]]
        mine = own[here].astype(np.int64)
        left = np.where(p == p1, n1 - mine, n1)
        falls = has & (p == p1) & ((left < n2) | ((left == n2) & (p2 < p1)))
        best = np.where(falls, n2, left)
        hit = (p == p1) & ~falls
        rest = total[g] - mine
        agree = np.where(best == rest, 2, np.where(2 * best > rest, 1, 0))
        support = np.minimum(np.log2(np.maximum(best, 1)).astype(np.int64), SUPPORT - 1)
        out[live[here], j] = np.where((rest > 0) & (best > 0), 1 + hit + 2 * (agree + AGREE * support), 0)
    return out


def cells(sym: np.ndarray) -> np.ndarray:
    """The cell of each prediction of anchor rows: support, agreement, whether the place before was hit, and the place."""
    before = np.zeros(sym.shape, np.int64)
    before[:, 1:] = np.where(sym[:, :-1] == 0, 0, 1 + (sym[:, :-1] - 1) % 2)
    kind = (sym.astype(np.int64) - 1) // 2
    return (kind * STATES + before) * SPAN + np.arange(SPAN)


def hit_odds(counts: np.ndarray) -> np.ndarray:
    """Probability of a hit in each cell, mixed from four contexts' counts by weights that the state selects."""
    c = counts.reshape(SUPPORT, AGREE, STATES, SPAN, 2).astype(np.float64)
    views = [c, c.sum(3, keepdims=True), c.sum((0, 1), keepdims=True), c.sum((1, 3), keepdims=True)]
    s = np.stack([np.broadcast_to(stretch((v[..., 1] + 0.4) / (v.sum(-1) + 0.8)), c.shape[:-1]) for v in views])
    gate = np.broadcast_to(np.arange(STATES)[None, None, :, None], c.shape[:-1])
    w, power = np.full((len(views), STATES), 0.3), np.full((len(views), STATES), 1e-6)
    n, ones = c.sum(-1), c[..., 1]
    for _ in range(200):
        p = squash(np.clip((s * w[:, gate]).sum(0), -12, 12))
        for g in range(STATES):
            step = ((ones - n * p) * s)[:, gate == g].sum(1)
            power[:, g] += step**2
            w[:, g] += 0.1 * step / np.sqrt(power[:, g])
    return np.clip(squash(np.clip((s * w[:, gate]).sum(0), -12, 12)), 1e-5, 1 - 1e-5).ravel()


# ---- exchanges: rows of pressed arrays

KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
BATCH = "key long, n_train long, ids binary, train binary, count binary, bytes binary, code binary, c binary, size binary, raw binary"
DEALT = "key long, bid long, at binary, n binary, own binary, c binary, size binary, raw binary"
VOCAB = "key long, n_known long, total long, once long, bid binary, many binary, at binary, which binary, lone binary, c binary, size binary, raw binary"
BACK = "key long, kind int, at binary, v binary, logs binary"


def pressed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def opened(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw) if raw else b""


def wide(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 as four planes of bytes, which press better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def narrow(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def batch_of(schema: str, **columns) -> pa.RecordBatch:
    """A batch from columns of numbers and lists of arrays; absent ones are empty."""
    out, n = [], len(columns["key"])
    for part in schema.split(", "):
        name, kind = part.split()
        v = columns.get(name)
        if kind == "binary":
            v = [pressed(np.ascontiguousarray(x).tobytes()) for x in v] if v is not None else [b""] * n
        out.append(pa.array(v if v is not None else [0] * n, KINDS[kind]))
    return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])


def pieces(t: pa.Table, **dtypes):
    """Lists of arrays, one for each row of each named column; dtype None for wide numbers."""
    return [[narrow(opened(x.as_py())) if d is None else np.frombuffer(opened(x.as_py()), d) for x in t.column(c)] for c, d in dtypes.items()]


def joined(parts: list[np.ndarray], dtype=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def hashes(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of lower-cased words that stand end to end, as Words has them."""
    if not len(size):
        return np.zeros(0, np.uint64)
    out, at = [], np.concatenate(([0], np.cumsum(size)))
    for a, b in groups(size, 1 << 20):
        part, own = raw[at[a] : at[b]], size[a:b]
        start = at[a:b] - at[a]
        rel = np.arange(len(part)) - np.repeat(start, own)
        out.append(mix(np.add.reduceat(_LOWER[part] * powers(int(own.max()))[rel], start)))
    return np.concatenate(out)


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some words, end to end."""
    to = np.cumsum(size)
    return raw[np.repeat(start - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)]


def _read(frames):
    """A row for each batch of texts: its documents, its distinct words, most frequent first, and its text as their numbers."""
    base, k = TaskContext.get().partitionId() << 32, 0
    for batch, buf, off in batches(frames, "text"):
        frugal(ROOM)
        train = batch.column("train").to_numpy(zero_copy_only=False)
        w = Words(buf, off, lower=True)
        u, where, code = np.unique(w.hash, return_index=True, return_inverse=True)
        order = np.argsort(-np.bincount(code, minlength=len(u)), kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        where, code = where[order], rank[code]
        size = (w.ends - w.starts)[where]
        c = np.bincount(code, train[w.doc], len(u)) if len(u) else np.zeros(0)
        yield batch_of(BATCH, key=[base + k], n_train=[int(train.sum())], ids=[batch.column("id").to_numpy().astype("<i8")], train=[train.astype(np.uint8)], count=[w.count.astype("<i8")], bytes=[np.diff(off).astype("<i8")], code=[wide(code)], c=[wide(c)], size=[wide(size)], raw=[_LOW[gathered(buf, w.starts[where], size)]])
        k += 1


def _rows(frames):
    frugal(ROOM)
    for batch in frames:
        yield from (batch.slice(i, 1) for i in range(batch.num_rows))
    trim()


def _words(n_buckets: int, frames):
    """The distinct words of each batch, dealt by hash."""
    for t in _rows(frames):
        bid = t.column("key")[0].as_py()
        ((c,), (size,), (raw,)) = pieces(t, c=None, size=None, raw=np.uint8)
        if not len(size):
            continue
        start = np.cumsum(size) - size
        order, key, at = by_bucket(hashes(raw, size), n_buckets)
        own = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield batch_of(DEALT, key=key, bid=[bid] * len(key), at=[wide(np.diff(x, prepend=0)) for x in own], c=[wide(c[x]) for x in own], size=[wide(size[x]) for x in own], raw=[gathered(raw, start[x], size[x]) for x in own])


def _merge(t: pa.Table) -> pa.Table:
    """The distinct words of a bucket in order of hash, with their counts, and which each batch's are."""
    c, size, raw, at = pieces(t, c=None, size=None, raw=np.uint8, at=None)
    bid, many = t.column("bid").to_numpy(), np.array([len(x) for x in c])
    c, size, raw, at = joined(c), joined(size), joined(raw, np.uint8), [np.cumsum(x) for x in at]
    u, where, which = np.unique(hashes(raw, size), return_index=True, return_inverse=True)
    total, most = np.bincount(which, c, len(u)).astype(np.int64), np.zeros(len(u), np.int64)
    np.maximum.at(most, which, c)
    sizes = size[where]
    flat = gathered(raw, (np.cumsum(size) - size)[where], sizes)
    return pa.Table.from_batches([batch_of(VOCAB, key=[t.column("key")[0].as_py()], n_known=[int((total > 0).sum())], total=[int(total.sum())], once=[int((total == 1).sum())], bid=[bid.astype("<i8")], many=[many.astype("<i8")], at=[wide(joined([np.diff(x, prepend=0) for x in at]))], which=[wide(which)], lone=[most == total], c=[total.astype("<i8")], size=[wide(sizes)], raw=[flat])])


def _known(t) -> tuple[np.ndarray, np.ndarray]:
    """The training words of a bucket: bytes and sizes."""
    (c,), (size,), (raw,) = pieces(t, c="<i8", size=None, raw=np.uint8)
    pick = c > 0
    return raw[np.repeat(pick, size)], size[pick]


TABLE_PIECE = 1 << 16


def _count_tables(frames):
    tables, some = fresh(), False
    for t in _rows(frames):
        raw, size = _known(t)
        at = np.concatenate(([0], np.cumsum(size)))
        for a, b in groups(size, 100_000):
            count_words(tables, raw[at[a] : at[b]], size[a:b])
            some = True
    if some:
        for k, table in enumerate(tables):
            for i in range(0, len(table), TABLE_PIECE):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([i // TABLE_PIECE], pa.int32()), "v": [pressed(table[i : i + TABLE_PIECE].tobytes())]})


def _add_tables(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(opened(v.as_py()), np.int64) for v in t.column("v"))
    return pa.table({"k": t.column("k")[:1], "piece": t.column("piece")[:1], "v": [pressed(total.tobytes())]})


LEARNED = "key long, w binary, seen binary, apm binary"


def _add_learned(t: pa.Table) -> pa.Table:
    """Weights averaged by the bits they were learned on, in order of shards; the map's counts added."""
    t = t.sort_by("first") if "first" in t.column_names else t
    w, seen, apm = pieces(t, w="<f8", seen="<f8", apm="<i8")
    total = sum(seen)[:, None]
    mean = sum(x.reshape(GATES, -1) * s[:, None] for x, s in zip(w, seen, strict=True)) / np.maximum(total, 1)
    mean = np.where(total > 0, mean, FIRST)
    return pa.Table.from_batches([batch_of(LEARNED, key=[t.column("key")[0].as_py()], w=[mean], seen=[sum(seen)], apm=[sum(apm)])])


def train(vocab: DataFrame):
    """The byte predictors' logits, broadcast, and the mixer, from the buckets of all distinct training words."""
    sc = vocab.sparkSession.sparkContext
    words = vocab.select("key", "c", "size", "raw")
    counted = words.mapInArrow(_count_tables, "k int, piece int, v binary").groupBy("k", "piece").applyInArrow(lean(_add_tables), "k int, piece int, v binary")
    tables = fresh()
    for row in counted.collect():  # tables of a fixed size
        i = row["piece"] * TABLE_PIECE
        tables[row["k"]][i : i + TABLE_PIECE] = np.frombuffer(opened(row["v"]), np.int64).reshape(-1, 2)
    sent = sc.broadcast(logits(tables))

    def learn(frames):
        prior = Mixer().apm
        for t in _rows(frames):
            mixer, (raw, size) = Mixer(), _known(t)
            at = np.concatenate(([0], np.cumsum(size)))
            for a, b in groups(size, 20_000):
                _, x, slots = steps(raw[at[a] : at[b]], size[a:b])
                s, gate = inputs(sent.value, slots)
                mixer.learn(s, gate, x)
            if len(size):
                yield batch_of(LEARNED, key=[t.column("key")[0].as_py()], w=[mixer.w.astype("<f8")], seen=[mixer.seen], apm=[np.rint(mixer.apm - prior).astype("<i8")])

    shards = words.mapInArrow(learn, LEARNED).select((F.col("key") % 64).alias("key"), F.col("key").alias("first"), "w", "seen", "apm")
    got = shards.groupBy("key").applyInArrow(lean(_add_learned), LEARNED).orderBy("key").toArrow()  # 64 rows at most
    mixer = Mixer()
    if got.num_rows:
        (w,), (apm,) = pieces(_add_learned(got), w="<f8", apm="<i8")
        mixer = Mixer(w.reshape(GATES, -1), mixer.apm + apm.reshape(mixer.apm.shape))
    return sent, mixer


def _text(t) -> tuple:
    """The hashes of a batch's words in the order of its texts, words of each text, which texts train, word numbers, own counts."""
    (code,), (size,), (raw,), (count,), (own,) = pieces(t, code=None, size=None, raw=np.uint8, count="<i8", train=np.uint8)
    return hashes(raw, size)[code], count, own == 1, code


def _anchors(n_buckets: int, frames):
    for t in _rows(frames):
        bid = t.column("key")[0].as_py()
        h, count, own, _ = _text(t)
        key, n, prints, own, many, *_ = anchor_rows(h, count, own)
        if not len(key):
            continue
        order, bucket, at = by_bucket(key, n_buckets)
        rows = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        live = np.arange(SPAN)[None] < n[:, None]
        six = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        yield batch_of(DEALT, key=bucket, bid=[bid] * len(bucket), at=[wide(np.diff(x, prepend=0)) for x in rows], n=[n[x].astype(np.uint8) for x in rows], own=[own[x].astype(np.uint8) for x in rows], c=[wide(many[x]) for x in rows], size=[six[x] for x in rows], raw=[prints[x][live[x]].astype("<u8") for x in rows])


def _match(t: pa.Table) -> pa.Table:
    """kind 1: what each batch's anchor rows predict, where anything; kind 2: hits and misses by cell, of own rows."""
    at, n, own, many, key, flat = pieces(t, at=None, n=np.uint8, own=np.uint8, c=None, size=np.uint8, raw="<u8")
    rows, at = [len(x) for x in n], [np.cumsum(x) for x in at]
    n, own, many = joined(n, np.uint8).astype(np.int64), joined(own, np.uint8) == 1, joined(many)
    wide_key = np.zeros((len(n), 8), np.uint8)
    wide_key[:, 2:] = joined(key, np.uint8).reshape(-1, 6)
    prints = np.zeros((len(n), SPAN), np.uint64)
    prints[np.arange(SPAN)[None] < n[:, None]] = joined(flat, np.uint64)
    sym = predicted(wide_key.view("<u8").ravel(), n, prints, own, many)
    some, cell = (sym > 0) & own[:, None], cells(sym)
    counts = np.bincount((cell * 2 + (sym.astype(np.int64) - 1) % 2)[some], np.broadcast_to(many[:, None], sym.shape)[some], CELLS * 2)
    any_, first = sym.any(1), np.concatenate(([0], np.cumsum(rows)))
    back = [np.flatnonzero(any_[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    bid = t.column("bid").to_numpy()
    out = [batch_of(BACK, key=[int(t.column("key")[0].as_py()) % 64], kind=[2], v=[counts.astype("<i8")])]
    if made := [(int(b), np.diff(x[y], prepend=0), sym[a + y]) for b, x, y, a in zip(bid, at, back, first, strict=False) if len(y)]:
        key, place, v = zip(*made, strict=True)
        out.append(batch_of(BACK, key=key, kind=[1] * len(key), at=[wide(x) for x in place], v=v))
    return pa.Table.from_batches(out)


def _add_cells(t: pa.Table) -> pa.Table:
    (v,) = pieces(t, v="<i8")
    return pa.Table.from_batches([batch_of(BACK, key=[t.column("key")[0].as_py()], kind=[2], v=[sum(v)])])


SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def based(doc, n_docs, code, c, total, known, n_train):
    """n_known and base score of each text of a batch."""
    add = lambda v: np.bincount(doc, v, n_docs)
    floor = np.log10((np.append(c, n_train) + 0.5) / (total + 0.5 * (known + 1)))
    return add(c[code] > 0) + (n_train > 0), add(floor[:-1][code]) + floor[-1]


def foretold(anchored, sym, n_words):
    """What the anchors say of each word of a batch: 0 without a prediction, else as predicted() has it; and the prediction's cell."""
    row, at, n = anchored
    s, cell = np.zeros(n_words, np.uint8), np.zeros(n_words, np.int64)
    if len(row):
        live = np.arange(SPAN)[None] < n[:, None]
        where = (at[:, None] + LEAD + np.arange(SPAN)[None])[live]
        own_sym = sym[row]
        s[where], cell[where] = own_sym[live], cells(own_sym)[live]
    return s, cell


def rate(anchored, count, code, own, c, logs, sym, odds, total, known, n_train, once):
    """n_tokens, n_known, base score, score of each text of a batch, from its words' counts, spelled costs and predictions."""
    n_docs = len(count)
    doc = np.repeat(np.arange(n_docs), count)
    add = lambda v: np.bincount(doc, v, n_docs)
    n_known, base = based(doc, n_docs, code, c, total, known, n_train)
    cc = c[code]
    # without the text itself, if it trains: what it has of a word, and its length
    _, back, tf = np.unique(doc * (len(c) + 1) + code, return_inverse=True, return_counts=True)
    trains = own[doc]
    rest = np.maximum(cc - np.where(trains, tf[back], 0), 0)
    length = np.where(own, count + 1, 0)
    left = np.maximum(total - length, 1).astype(np.float64)
    s, cell = foretold(anchored, sym, len(code))
    guess = s > 0
    hit = guess & ((s.astype(np.int64) - 1) % 2 == 1)
    p = odds[np.where(guess, cell, 0)]
    cost = np.where(guess, np.log10(np.where(hit, p, 1 - p)), 0.0)
    coded = ~hit
    new = coded & (rest == 0)
    first = np.cumsum(count) - count
    so_far = lambda x: (np.cumsum(x) - x) - (np.cumsum(x) - x)[np.minimum(first, max(len(x) - 1, 0))][doc] if len(x) else np.zeros(0)
    start = min(max((once + 0.5) / (total + 1.0), 1e-6), 1 - 1e-6) if known else 1 - 1e-6
    q = (so_far(new.astype(np.int64)) + PRIOR * start) / (so_far(coded.astype(np.int64)) + PRIOR)
    word = np.where(new, np.log10(q) + logs[code], np.log10(1 - q) + np.log10(np.maximum(rest, 1) / left[doc]))
    end = np.log10(np.maximum(n_train - own.astype(np.int64), 0.5) / left)
    score = add(cost + np.where(coded, word, 0.0)) + end
    return count + 1, n_known, base, score


def gather(df: DataFrame, id_col: str, text_col: str, held_out: int, folds: int):
    """The batches of texts, the buckets of words, the anchors' predictions, the odds of their hits, and how many tokens: distinct, all, words
    seen once, texts; of the training texts."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out, F.lit(False))
    size = text_bytes(df, text_col)
    n_buckets = max(1, -(-size // SHARD))
    docs = df.select(id_column(id_col).alias("id"), F.col(text_col).alias("text"), (~held).alias("train"))
    texts = checkpoint(docs.mapInArrow(_read, BATCH))
    dealt = texts.select("key", "c", "size", "raw").mapInArrow(partial(_words, n_buckets), DEALT)
    vocab = checkpoint(dealt.groupBy("key").applyInArrow(lean(_merge), VOCAB))
    anchored = texts.select("key", "train", "count", "code", "size", "raw").mapInArrow(partial(_anchors, n_buckets), DEALT)
    matches = checkpoint(anchored.groupBy("key").applyInArrow(lean(_match), BACK))
    zero = F.lit(0).cast("long")
    known, total, once = vocab.agg(*[F.coalesce(F.sum(c), zero) for c in ("n_known", "total", "once")]).first()
    n_train = texts.agg(F.coalesce(F.sum("n_train"), zero)).first()[0]
    summed = matches.where("kind = 2").groupBy("key").applyInArrow(lean(_add_cells), BACK).toArrow()  # 64 rows at most
    odds = hit_odds(sum(pieces(summed, v="<i8")[0]) if summed.num_rows else np.zeros(CELLS * 2))
    return size, texts, vocab, matches, odds, known + (n_train > 0), total + n_train, once, n_train


def finished(texts: DataFrame, back: DataFrame, id_col: str, of) -> DataFrame:
    """The scored rows, from of(table, hashes, count, own, code, size, counts, spelled costs, anchors, predictions) of each batch."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy()
        words, found = (right.filter(pa.array(kind == k)) for k in (0, 1))
        out = []
        for i in range(left.num_rows):
            t = left.slice(i, 1)
            h, count, own, code = _text(t)
            (ids,), (size_of,), (size,) = pieces(t, ids="<i8", bytes="<i8", size=None)
            c, logs = np.zeros(len(size), np.int64), np.zeros(len(size))
            for at, v, x in zip(*pieces(words, at=None, v=np.uint8, logs="<f4"), strict=True):
                at = np.cumsum(at)
                c[at] = np.ascontiguousarray(v.reshape(8, -1).T).view("<i8").ravel()
                if len(x):
                    logs[at] = x
            anchored = anchor_rows(h, count, own)
            sym = np.zeros((len(anchored[0]), SPAN), np.uint8)
            for at, v in zip(*pieces(found, at=None, v=np.uint8), strict=True):
                sym[np.cumsum(at)] = v.reshape(-1, SPAN)
            total, tokens, n_known, base, cost = of(t, size_of, count, own, code, size, c, logs, anchored[-3:], sym)
            out.append((ids, ~own, tokens, n_known, np.full(len(ids), total), base, cost, -cost / np.log10(2) / (size_of + 1)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 8
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
        return pa.table([pa.array(v.astype(np.int64) if pa.types.is_integer(ty) else v, ty) for v, ty in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCORED.split(", ")])

    parts = texts.select("key", "ids", "train", "count", "bytes", "code", "size", "raw")
    out = parts.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(lean(finish, ROOM), SCORED)
    return out.withColumn("id", F.when(F.col("id") != LEAST, F.col("id"))).withColumnRenamed("id", id_col)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 5) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row; known words by their frequency."""
    _, texts, vocab, matches, odds, known, total, once, n_train = gather(df, id_col, text_col, held_out, folds)
    tables, mixer = train(vocab)
    weights, apm = mixer.w, mixer.apm

    def spell(frames):
        m = Mixer(weights, apm)
        for t in _rows(frames):
            (bid,), (many,), (at,), (which,), (need,), (c,), (size,), (raw,) = pieces(t, bid="<i8", many="<i8", at=None, which=None, lone=bool, c="<i8", size=None, raw=np.uint8)
            # a word is spelled where no other text has it, so only where one batch has all of it, or none has
            logs = np.zeros(len(c), np.float32)
            if need.any():
                logs[need] = word_logs(tables.value, m, raw[np.repeat(need, size)], size[need])
            cut = np.concatenate(([0], np.cumsum(many)))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield batch_of(BACK, key=bid, kind=[0] * len(bid), at=[wide(at[a:b]) for a, b in spans], v=[c[which[a:b]].astype("<i8").view(np.uint8).reshape(-1, 8).T for a, b in spans], logs=[logs[which[a:b]].astype("<f4") for a, b in spans])

    def of(_, size_of, count, own, code, size, c, logs, anchored, sym):
        return total, *rate(anchored, count, code, own, c, logs, sym, odds, total, known, n_train, once)

    return finished(texts, vocab.mapInArrow(spell, BACK).union(matches.where("kind = 1")), id_col, of)


# ---- every word by bit predictors, online


def _count_contexts(sizes: tuple[int, ...], frames):
    tables, counted = contexts.fresh(sizes), 0

    def sent():
        for k, table in enumerate(tables):
            for i in range(0, len(table), LEAF_PIECE):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "piece": pa.array([i // LEAF_PIECE], pa.int32()), "v": [pressed(table[i : i + LEAF_PIECE].tobytes())]})
            table[:] = 0

    for t in _rows(frames):
        (size,), (raw,), (c,), (count,), (own,), (code,) = pieces(t, size=None, raw=np.uint8, c=None, count="<i8", train=np.uint8, code=None)
        if not len(size):
            continue
        stream = contexts.Stream(raw, size, hashes(raw, size), code, count)
        if counted + len(stream.x) >= COUNTED:
            yield from sent()
            counted = 0
        counted += len(stream.x)
        contexts.count_bytes(tables, stream, np.flatnonzero(np.repeat(own, count)), c, sizes)
    if counted:
        yield from sent()


#: Bytes after which a task sends its counts, so that none goes over its type.
COUNTED = 1 << 31
#: Counts of lines that are sent in one piece.
LEAF_PIECE = 1 << 18


def _add_contexts(t: pa.Table) -> pa.Table:
    total = np.zeros(1, np.int64)
    for v in t.column("v"):
        total = total + np.frombuffer(opened(v.as_py()), np.int32)
    told, seen = contexts.paths(total)
    return pa.table({"k": t.column("k")[:1], "piece": t.column("piece")[:1], "v": [pressed(told.tobytes())], "seen": [pressed(seen.tobytes())]})


def learned(texts: DataFrame, sizes: tuple[int, ...]):
    """What the context predictors tell, of all training texts; tables of a size that sizes bounds, broadcast."""
    sc = texts.sparkSession.sparkContext
    # a task for each core, as each sends whole tables
    counted = texts.select("train", "count", "code", "c", "size", "raw").coalesce(max(sc.defaultParallelism, 1)).mapInArrow(partial(_count_contexts, sizes), "k int, piece int, v binary")
    tables, seen = [np.zeros((2, 16 << b), "<u4") for b in sizes], np.zeros((2, 1 << sizes[3]), np.uint8)
    for row in counted.groupBy("k", "piece").applyInArrow(lean(_add_contexts), "k int, piece int, v binary, seen binary").toLocalIterator():
        i = row["piece"] * LEAF_PIECE
        part = np.frombuffer(opened(row["v"]), "<u4").reshape(2, -1)
        tables[row["k"]][:, i : i + part.shape[1]] = part
        if row["k"] == 3:
            seen[:, i // 16 : (i + part.shape[1]) // 16] = np.frombuffer(opened(row["seen"]), np.uint8).reshape(2, -1)
    return sc.broadcast([x.ravel() for x in (*tables, seen)])


def _counted(frames):
    """The training count of each batch's words."""
    for t in _rows(frames):
        (bid,), (many,), (at,), (which,), (c,) = pieces(t, bid="<i8", many="<i8", at=None, which=None, c="<i8")
        cut = np.concatenate(([0], np.cumsum(many)))
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        yield batch_of(BACK, key=bid, kind=[0] * len(bid), at=[wide(at[a:b]) for a, b in spans], v=[c[which[a:b]].astype("<i8").view(np.uint8).reshape(-1, 8).T for a, b in spans])


def mixed(s, cell, stream, tables, sizes, size_of, count, own, odds, total, n_train):
    """log10 probability of each text of a batch: before each word whether the text ends, then whether the foretold word comes, where one is, and
    of every word that is not so told all bytes; each bit mixed online."""
    n_docs = len(count)
    left, texts_left = total - np.where(own, count + 1, 0), n_train - own.astype(np.int64)
    ends = (texts_left + 0.5) / (left + 1.0)  # without the text itself, if it trains
    doc = np.repeat(np.arange(n_docs), count + 1)
    last = np.zeros(len(doc), bool)
    last[np.cumsum(count + 1) - 1] = True
    out = contexts.flags(stretch(ends)[doc], np.zeros(len(doc), np.int64), last, doc, n_docs, 1)
    hit = (s > 0) & ((s - 1) % 2 == 1)
    told = np.flatnonzero(s)
    out += contexts.flags(stretch(odds)[cell[told]], cell[told] // SPAN % STATES, hit[told], stream.doc[told], n_docs, STATES)
    predictors, order = contexts.Told(tables, sizes, stream), np.lexsort((size_of, own))
    for a, b in slices(np.maximum(size_of[order], 3500), 1 << 20):  # side by side those that look in the same tables, of like length
        out[order[a:b]] += contexts.spell(predictors, order[a:b], hit, own)
    return out


def mixed_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 5) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row; every word by the mixed bit predictors."""
    n_bytes, texts, vocab, matches, odds, known, total, _, n_train = gather(df, id_col, text_col, held_out, folds)
    sizes = contexts.line_bits(n_bytes)
    tables = learned(texts, sizes)

    def of(t, size_of, count, own, code, size, c, logs, anchored, sym):
        (raw,) = pieces(t, raw=np.uint8)[0]
        stream = contexts.Stream(raw, size, hashes(raw, size), code, count)
        s, cell = foretold(anchored, sym, len(code))
        n_known, base = based(stream.doc, len(count), code, c, total, known, n_train)
        return total, count + 1, n_known, base, mixed(s, cell, stream, tables.value, sizes, size_of, count, own, odds, total, n_train)

    return finished(texts, vocab.select("bid", "many", "at", "which", "c").mapInArrow(_counted, BACK).union(matches.where("kind = 1")), id_col, of)


def op9_scoring(spark, sf_dir: str) -> DataFrame:
    return mixed_score(documents(spark, sf_dir))

"""Online logistic mixing of hashed-context bit predictors over the bytes of texts, in their order.

A text is its words, lower-cased, each with an end-of-word byte behind it. Every bit of a coded byte, most significant first, is predicted from
five hashed contexts, which run across the ends of words: the last one, two and four bytes, the word so far, and the word so far with the word
before. A predictor's count is that of all training texts; a training text's bit is predicted without its own count. The predictors' logits are
mixed by weights that a gate selects (place in the word; how often the word so far was seen), and an adaptive map over the mixed logit corrects
them. Each text starts with the same weights and map, and learns both as it is coded: in runs, first of RUN bytes, later of a 32nd of what was
coded. A run is predicted by what the runs before it taught, so what a text scores depends on the text and the counts alone.

Slots grow with the training bytes up to 2**MOST lines of 16 slots; a line holds the nodes of a nibble. When all is counted, a slot has what the
four bits of its nibble are told, so that a nibble is one look, not four.
"""

from __future__ import annotations

import numpy as np

from driftgauge.llm.text import _BYTE, mix, powers

PREDICTORS = 5
#: log2 of the lines of each predictor at most, and of the fewest of any.
MOST, FEWEST = (13, 16, 17, 17, 17), 8
#: Training bytes for each line, below the most.
BYTES_A_LINE = 16
#: Bytes before each text, so that contexts reach no other text: zeros and a space.
PAD = 4
DELTA, SCALE = 0.2, 15.0
#: A predictor's weight at a text's start, what bounds a step, and the evidence that a full step needs.
FIRST, RATE, EVIDENCE = 0.25, 0.1, 400.0
GATES, BINS = 16, 33
#: The bits that a cell of the map counts for before it has seen any.
PRIOR = 60.0
RUN = 64
#: Flags of a first run.
FLAGS = 32
#: Bytes whose contexts are looked up at once, and that are mixed at once, so that arrays stay in a core's cache.
LOOK, BLOCK = 1 << 14, 1 << 12
#: From which place of a word on a byte's context lies in that word, by predictor.
ALONE = (0, 1, 3, 0, 1 << 62)
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEP = mix((np.arange(256) >> 4).astype(np.uint64) + np.uint64(0x51))
_PLACE = np.array([0, 4, 8, 8, 12], np.uint8)
_HIGH, _LOW = (np.arange(256) >> 4).astype(np.uint64), (np.arange(256) & 15).astype(np.uint64)
_BITS = (np.arange(16)[:, None] >> np.arange(3, -1, -1) & 1).astype(np.float32).view(np.complex128).ravel()  # a nibble's bits, taken as one
_LOG10 = 1 / np.log(10)


def line_bits(n_bytes: int) -> tuple[int, ...]:
    """log2 of each predictor's lines for training texts of so many bytes."""
    want = max(FEWEST, int(max(n_bytes // BYTES_A_LINE, 1)).bit_length())
    return tuple(min(want, most) for most in MOST)


class Stream:
    """The bytes of some texts, from their distinct words and the words' numbers."""

    def __init__(self, raw: np.ndarray, size: np.ndarray, words: np.ndarray, code: np.ndarray, count: np.ndarray):
        n = np.append(PAD, size + 1)  # what lies before a text is as a word of its own, the first of the distinct ones
        first = np.cumsum(n) - n
        inner = np.ones(int(n.sum()), bool)
        inner[: PAD] = inner[first[1:] + size] = False
        spelled = np.full(len(inner), 32, np.uint8)
        spelled[inner] = raw
        spelled[: PAD - 1] = 0
        # the hash of the word so far, at each byte of the distinct words
        rel = np.arange(len(inner)) - np.repeat(first, n)
        total = np.cumsum(_BYTE[spelled] * powers(int(n.max()))[rel] + np.uint64(1) * inner)
        so_far = np.append(np.zeros(1, np.uint64), total)[: len(inner)]
        self.so_far = so_far - np.repeat(so_far[first], n)
        self.spelled, self.sizes = spelled, n[1:]
        self.place = _PLACE.take(rel, mode="clip")  # of each byte in its word, for the gate
        self.doc = np.repeat(np.arange(len(count)), count)
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.begin, self.long = first[1:][code], n[1:][code]
        before = np.append(np.zeros(1, np.uint64), words[code])[: len(code)]
        before[self.first[:-1][count > 0]] = 0
        self.mixed = before * _SALT[1]  # the word before, as it is mixed with the word so far
        # all texts, each behind its PAD bytes
        word = np.ones(len(code) + len(count), bool)
        word[self.first[:-1] + np.arange(len(count))] = False
        long, begin = np.full(len(word), PAD), np.zeros(len(word), np.int64)
        long[word], begin[word] = self.long, self.begin
        at = np.cumsum(long) - long
        self.at = at[word]
        self.x = np.empty(int(long.sum()), np.uint8)
        begin -= at
        for a, b in parts(long, LOOK):
            low, high = at[a], at[b - 1] + long[b - 1]
            self.x[low:high] = spelled.take(np.repeat(begin[a:b], long[a:b]) + np.arange(low, high))
        self.last = last_bytes(self.x)

    def unhit(self, texts: np.ndarray, hit: np.ndarray):
        """The words of these texts that are no hits, and how many bytes each text has of them."""
        count = np.diff(self.first)[texts]
        pick = np.repeat(self.first[texts] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        coded = ~hit[pick]
        pick = pick[coded]
        return pick, np.bincount(np.repeat(np.arange(len(texts)), count)[coded], self.long[pick], len(texts)).astype(np.int64)

    def bytes_of(self, pick: np.ndarray):
        """The word and the place in it of each byte of these words, ends included."""
        long = self.long[pick]
        rel = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        return np.repeat(pick, long), rel


def parts(long: np.ndarray, most: int):
    """Bounds of runs of words of some most bytes, or of one word."""
    total = np.cumsum(long)
    a = 0
    while a < len(long):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def last_bytes(x: np.ndarray) -> np.ndarray:
    """The PAD bytes before each byte, the last one lowest; none before the first PAD."""
    out = np.zeros(len(x), np.uint32)
    out[PAD:] = np.ndarray(len(x) - PAD, ">u4", np.ascontiguousarray(x), strides=(1,))
    return out


def nibbles(here: np.ndarray) -> list[np.ndarray]:
    """The two nibbles of each byte, and what moves the first one's line to the second's."""
    return [x.take(here, mode="clip") for x in (_HIGH, _LOW, _STEP)]


def slots(k: int, context: np.ndarray, split: list[np.ndarray], sizes: tuple[int, ...]):
    """Of a predictor the slots of the two nibbles of each byte behind these contexts. Changes the contexts."""
    high, low, step = split
    context += np.uint64(k + 1)
    context *= _SALT[k]
    h = mix(context)
    shift = np.uint64(64 - sizes[k])
    for x, nibble in ((h, high), (None, low)):
        if x is None:
            h ^= step
            h *= _SALT[0]
            x = h
        slot = x >> shift
        slot <<= np.uint64(4)
        slot |= nibble
        yield slot.view(np.int64)


def of_last(k: int, last: np.ndarray) -> np.ndarray:
    """What of the last bytes is the context of one of the first three predictors."""
    return (last & np.uint32((1 << 8 * (1, 2, 4)[k]) - 1)).astype(np.uint64)


def fresh(sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Tables for some counts: of fewer than 2**31 bytes."""
    return [np.zeros(16 << b, np.int32) for b in sizes]


def count_bytes(tables: list[np.ndarray], stream: Stream, pick: np.ndarray, many: np.ndarray, sizes: tuple[int, ...]) -> None:
    """Add the bytes of these words to the tables: how often each nibble followed each line. What lies in a word is counted from the distinct
    words, of which the picked ones are so many each."""

    def add(k, context, here, weight=np.int32(1)):
        for slot in slots(k, context, nibbles(here), sizes):
            np.add.at(tables[k], slot, weight)

    for a, b in parts(stream.long[pick], LOOK):
        word, rel = stream.bytes_of(pick[a:b])
        at = stream.at[word] + rel
        here = stream.x[at]
        add(4, stream.so_far[stream.begin[word] + rel] + stream.mixed[word], here)
        for k in (1, 2):
            live = rel < ALONE[k]
            add(k, of_last(k, stream.last[at[live]]), here[live])
    pairs = np.zeros(1 << 16)
    first = PAD + np.cumsum(stream.sizes) - stream.sizes
    last = last_bytes(stream.spelled)
    for a, b in parts(stream.sizes, LOOK):
        own = stream.sizes[a:b]
        low, high = first[a], first[b - 1] + own[-1]
        rel, weight, here = np.arange(low, high) - np.repeat(first[a:b], own), np.repeat(many[a:b], own).astype(np.int32), stream.spelled[low:high]
        pairs += np.bincount((last[low:high] & np.uint32(255)).astype(np.int64) << 8 | here, weight, 1 << 16)
        for k in (1, 2):
            live = (rel >= ALONE[k]) & (weight > 0)
            add(k, of_last(k, last[low:high][live]), here[live], weight[live])
        add(3, stream.so_far[low:high].copy(), here, weight)
    seen = np.flatnonzero(pairs)
    add(0, (seen >> 8).astype(np.uint64), seen & 255, pairs[seen].astype(np.int32))


def paths(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole lines' nibble counts: for each nibble what its four bits are told (a byte each, the logit of a one), and how often each line was
    seen; both first whole and then less one that went that way."""
    n = leaves.reshape(-1, 16)
    told = np.zeros((2, *n.shape, 4), np.int8)
    logit = lambda a, b: np.clip(np.rint(np.log((b + DELTA) / (a + DELTA)) * SCALE), -127, 127).astype(np.int8)
    for depth in range(4):
        zeros, ones = np.moveaxis(n.reshape(len(n), 1 << depth, 2, 8 >> depth).sum(3), 2, 0)
        for less in (0, 1):
            both = np.stack((logit(np.maximum(zeros - less, 0), ones), logit(zeros, np.maximum(ones - less, 0))), 2)
            told[less, :, :, depth] = np.repeat(both.reshape(len(n), 2 << depth), 8 >> depth, 1)
    total = n.sum(1)
    seen = np.searchsorted([1, 4, 32], np.stack((total, total - 1)), side="right").astype(np.uint8)
    return told.view("<u4")[..., 0], seen


class Online:
    """Weights for each text and gate, and each text's adaptive map, learned as its columns of bits are coded."""

    def __init__(self, texts: int, gates: int, first, unit: float = 1.0, side: int = 1):
        """unit: what a logit of one is given as; side: how many bits of a column lie side by side in a row, 1 or 4."""
        first = np.asarray(first, np.float32)
        self.gates, self.k, self.unit, self.side = gates, len(first), unit, side
        self.w = np.repeat(first[:, None], texts * gates, 1)
        self.power = np.full(self.w.shape, EVIDENCE)
        p = 1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))
        self.ones, self.seen = np.tile(p * PRIOR, texts), np.full(texts * BINS, PRIOR)
        self.begin(texts)

    def begin(self, live: int) -> None:
        """What a run of the first texts is predicted by, and nothing learned of it yet."""
        self.live, gates, cells = live, live * self.gates, live * BINS
        self.step, self.met = np.zeros((self.k, gates)), np.zeros(2 * cells, np.int64)
        self.scaled = self.wide(self.w[:, :gates] * np.float32(self.unit))
        self.first = self.wide(np.arange(0, 2 * cells, 2 * BINS, dtype=np.int32))
        self.curve = (self.ones[:cells] / self.seen[:cells]).astype(np.float32).repeat(2)

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Each four bytes as often as bits lie side by side, taken as one."""
        return x if self.side == 1 else np.repeat(x, self.side, -1).view(np.complex128)

    def folded(self, x: np.ndarray, of) -> np.ndarray:
        """One for the bits that lie side by side."""
        return x if self.side == 1 else of((half := of(x[..., ::2], x[..., 1::2]))[..., ::2], half[..., 1::2])

    def predict(self, doc: np.ndarray, gate: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 probability of each column of bits, and to the run's what they teach."""
        own = doc * self.gates + gate
        z = np.einsum("kjn,kn->jn", s, self.scaled.take(own, 1, mode="clip").view(np.float32))
        np.maximum(z, np.float32(-12), out=z)
        np.minimum(z, np.float32(12), out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        z += 8.25
        z *= (BINS - 1) / 16
        np.maximum(z, np.float32(0), out=z)
        np.minimum(z, np.float32(BINS - 1), out=z)
        bit = z.astype(np.int32)
        bit += bit
        bit += y.astype(np.int32)
        bit += self.first.take(doc, mode="clip").view(np.int32)
        cell = bit.astype(np.int64)
        q = self.curve.take(cell, mode="clip")
        q += p
        q *= 0.5
        np.subtract(y, 1, out=z)
        q += z
        np.abs(q, out=q)  # never below 3e-6, as the mixed logit is bounded
        q = self.folded(q, np.multiply)
        cost = np.zeros(len(own))
        for a in range(0, len(q), 4 // self.side):  # of four at a time, which a float holds
            cost += np.log(np.multiply.reduce(q[a : a + 4 // self.side], 0))
        cost *= _LOG10
        g = np.subtract(y, p, out=p)
        for k, e in enumerate(self.folded(np.einsum("jn,kjn->kn", g, s), np.add)):
            self.step[k] += np.bincount(own, e, self.step.shape[1])
        self.met += np.bincount(cell.ravel(), minlength=len(self.met))
        return cost

    def learn(self, live: int | None = None) -> None:
        """The run is over: its steps and counts hold for the next, which has only the first of the texts if so many are given."""
        gates, cells = self.step.shape[1], len(self.met) // 2
        self.step *= self.unit
        power = self.power[:, :gates]
        power += self.step * self.step
        self.step *= RATE
        self.step /= np.sqrt(power)
        self.w[:, :gates] += self.step.astype(np.float32)
        self.ones[:cells] += self.met[1::2]
        self.seen[:cells] += self.met[::2]
        self.seen[:cells] += self.met[1::2]
        self.begin(self.live if live is None else live)

    def code(self, doc: np.ndarray, gate: np.ndarray, s, y: np.ndarray) -> np.ndarray:
        """log10 probability of each column of bits, all predicted by what is known before them; then they are learned."""
        cost = self.predict(doc, gate, np.asarray(s), y)
        self.learn()
        return cost


def runs(n: np.ndarray, first: int):
    """Of texts of so many rows, most first, one behind the other: the rows in order of run and then of text, the runs' bounds and texts."""
    start, live, end = np.cumsum(n) - n, len(n), 0
    begin, size, bounds, texts = [], [], [0], []
    while end < n[0]:
        low, end = end, end + max(first, end // 32)
        live = int(np.searchsorted(-n[:live], -low))  # those of more rows
        begin.append(start[:live] + low)
        size.append(np.minimum(n[:live], end) - low)
        bounds.append(bounds[-1] + int(size[-1].sum()))
        texts.append(live)
    begin, size = np.concatenate(begin), np.concatenate(size)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(bounds[-1]), bounds, [*texts, 0]


class Told:
    """What the predictors say of bytes of a stream."""

    def __init__(self, tables: list[np.ndarray], sizes: tuple[int, ...], stream: Stream):
        *self.tables, self.seen = tables
        self.sizes, self.stream = sizes, stream
        pair = np.arange(1 << 16)
        half = 16 << sizes[0]
        self.pairs = [np.concatenate((self.tables[0][slot], self.tables[0][slot + half])) for slot in slots(0, (pair >> 8).astype(np.uint64), nibbles(pair & 255), sizes)]

    def look(self, at: np.ndarray, spelled: np.ndarray, before: np.ndarray, taught: np.ndarray):
        """Of bytes at these places of the texts and of the distinct words, and the mixed words before them: the nibbles' bits, the bytes' gates, and
        of each predictor and nibble the four bits' logits; taught: whether the byte itself was counted."""
        here, last = self.stream.x.take(at, mode="clip").astype(np.int64), self.stream.last.take(at, mode="clip")
        so_far = self.stream.so_far.take(spelled, mode="clip")
        split = nibbles(here)
        out = np.empty((PREDICTORS, 2, len(at)), np.uint32)
        pair = (last & np.uint32(255)).astype(np.int64)
        pair <<= 8
        pair |= here
        pair += taught << 16
        for i in (0, 1):
            self.pairs[i].take(pair, mode="clip", out=out[0, i])
        before += so_far
        for k in range(1, PREDICTORS):
            half = taught << 4 + self.sizes[k]
            for i, slot in enumerate(slots(k, of_last(k, last) if k < 3 else so_far if k == 3 else before, split, self.sizes)):
                slot += half
                self.tables[k].take(slot, mode="clip", out=out[k, i])
                if k == 3 and not i:
                    slot >>= 4
                    gate = self.stream.place.take(spelled, mode="clip") + self.seen.take(slot, mode="clip")
        y = np.stack([_BITS.take(x, mode="clip") for x in (here >> 4, here & 15)])
        return y, gate, out


def spell(told: Told, texts: np.ndarray, hit: np.ndarray, train: np.ndarray) -> np.ndarray:
    """log10 probability of the bytes of all words of these texts that are no hits, by text. train: texts whose own counts are taken out."""
    stream = told.stream
    pick, n = stream.unhit(texts, hit)
    out = np.zeros(len(texts))
    if not len(pick):
        return out
    most = np.argsort(-n, kind="stable")
    pick, n = stream.unhit(texts[most], hit)
    order, bounds, live = runs(n, RUN)
    long = stream.long[pick]
    start = np.cumsum(long) - long
    # of each word from its place among the coded bytes: to its text's bytes, to the distinct words', and whose it is
    to_text, to_word, before, whose = stream.at[pick] - start, stream.begin[pick] - start, stream.mixed[pick], np.repeat(np.arange(len(n)), np.bincount(np.searchsorted(np.cumsum(n), start, side="right"), minlength=len(n)))
    number = np.repeat(np.arange(len(pick), dtype=np.int32), long)
    model = Online(len(texts), GATES, [FIRST] * PREDICTORS, 1 / SCALE, 4)
    taught = train[texts[most]].astype(np.int64)
    cost = np.zeros(len(texts))
    edges = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] + [[bounds[-1]]]))
    ready = run = 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > ready:  # of as many blocks as go into one look
            base, ready = a, max(b, int(edges[np.searchsorted(edges, a + LOOK, side="right") - 1]))
            pos = order[base:ready]
            word = number.take(pos, mode="clip").astype(np.int64)
            at, inner, mixed, own = (x.take(word, mode="clip") for x in (to_text, to_word, before, whose))
            at += pos
            inner += pos
            bits, gate, looked = told.look(at, inner, mixed, taught.take(own, mode="clip"))
        i, j = a - base, b - base
        s, y = looked[:, :, i:j].view(np.int8).astype(np.float32), bits[:, i:j].view(np.float32)
        cost += np.bincount(own[i:j], model.predict(own[i:j], gate[i:j], s, y), len(texts))
        if b == bounds[run + 1]:
            run += 1
            model.learn(live[run])
    out[most] = cost
    return out


def flags(logit: np.ndarray, gate: np.ndarray, hit: np.ndarray, doc: np.ndarray, texts: int, gates: int) -> np.ndarray:
    """log10 probability of flags in the order of their texts, summed by text: the corpus's logit and a constant, mixed as bits are."""
    out = np.zeros(texts)
    if not len(doc):
        return out
    n = np.bincount(doc, minlength=texts)
    most = np.argsort(-n, kind="stable")
    first, n = (np.cumsum(n) - n)[most], n[most]
    order, bounds, live = runs(n, FLAGS)
    own = np.repeat(np.arange(texts), n)[order]
    order += (first - np.cumsum(n) + n)[own]
    model = Online(texts, gates, [1.0, 0.0])
    cost = np.zeros(texts)
    for run, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for i in range(a, b, LOOK):
            j = min(i + LOOK, b)
            at, d = order[i:j], own[i:j]
            s = np.ones((2, 1, j - i), np.float32)
            s[0, 0] = logit[at]
            cost += np.bincount(d, model.predict(d, gate[at], s, hit[at][None].astype(np.float32)), texts)
        model.learn(live[run + 1])
    out[most] = cost
    return out

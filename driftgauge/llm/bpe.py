"""Byte-level BPE: batched numpy merge rounds, and decoding.

Words that are not in the worker's cache are encoded together: their bytes are one flat array of
symbols. In each round every adjacent pair is looked up by binary search in the sorted pair keys,
each word merges all occurrences of its lowest-ranked pair, and words without a pair leave.

Nulls and empty texts have no tokens; repeated rows are encoded each. A special token's own string in a text is that token, as in
the tokenizers library. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftgauge.llm.text import _BYTE as BYTE_HASH_ODD
from driftgauge.llm.text import batches, documents, mix, powers, string_bytes

BYTE_HASH = np.where(BYTE_HASH_ODD == 0, np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), BYTE_HASH_ODD)

#: Classes of characters that pieces are made of, as byte-level tokenizers split: contractions; runs of letters, digits
#: or others, each with a space before; white space.
LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 0
#: What follows the apostrophe in 's 't 'm 'd, and in 're 've 'll.
SHORT, LONG = np.frombuffer(b"stmd", np.uint8), np.array([ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
NONE = np.uint64(2**64 - 1)
#: Pieces that a worker's cache holds before it starts anew: some 12 MB.
CACHE = 400_000
#: Bytes of text that are encoded together, and of a piece beyond which it is cut where no merge can cross.
STEP, LONG_PIECE = 1 << 20, 64


def byte_letters() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The class of every code point."""
    global _kinds
    if _kinds is None:
        every = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
        _kinds = np.full(0x110000, OTHER, np.uint8)
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
            for m in regex.finditer(name, every):
                _kinds[m.start() : m.end()] = kind
        _kinds[0xD800:0xE000] = OTHER
    return _kinds


def lead_bytes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first byte of the character that each of these bytes belongs to."""
    at = at.copy()
    for _ in range(3):
        more = (buf[at] & 0xC0) == 0x80
        if not more.any():
            break
        at[more] -= 1
    return at


def byte_kinds(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = kinds()
    kind = table[:256][buf]
    high = np.flatnonzero(buf >= 0xC0)
    if len(high):
        b = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int32)
        x = b[high]
        one, two, three = (b[high + k] & 0x3F for k in (1, 2, 3))
        size = 2 + (x >= 0xE0) + (x >= 0xF0)
        point = np.where(size == 2, (x & 0x1F) << 6 | one, np.where(size == 3, (x & 0xF) << 12 | one << 6 | two, (x & 7) << 18 | one << 12 | two << 6 | three))
        own = table[point]
        for k in range(4):
            has = size > k
            kind[high[has] + k] = own[has]
    return kind


def safe_cuts(buf: np.ndarray, most: int, specials: tuple[bytes, ...] = ()):
    """(start, stop) of parts of some most bytes of a long text, cut only where a piece always begins.

    That is before white space that follows something else, and where a run of letters or digits ends at another class; what
    stands before the cut is no matter to the pieces behind it, and an apostrophe's letters are not cut from it. A special
    token is never cut. A stretch without such a place, as one word of any length, is one part."""
    at, n, edge = 0, len(buf), max(map(len, specials), default=1) - 1
    while at < n:
        low = at + most
        end = n
        while low < n:
            a, b = low - 4, min(low + most, n)
            while a > at and buf[a] & 0xC0 == 0x80:
                a -= 1
            while b < n and buf[b] & 0xC0 == 0x80:
                b += 1
            kind = byte_kinds(buf[a:b])
            was, now = kind[:-1], kind[1:]
            hits = np.flatnonzero((was != SPACE) & (was != now) & ((was != OTHER) | (now == SPACE))) + a + 1
            found = next((p for p in hits[hits >= low].tolist() if not any((k := buf[max(0, p - len(t) + 1) : p + len(t) - 1].tobytes().find(t)) >= 0 and k < min(p, len(t) - 1) for t in specials)), None)
            if found is not None:
                end = found
                break
            low = b
        yield at, end
        at = end


class Bpe:
    """A vocabulary and its merges, from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        both = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        pair = np.stack(both, 1).ravel()
        self.byte_pairs = self.rank_of(pair, np.repeat(np.arange(65536), 2), np.arange(0, 131072, 2)).astype(np.int32)
        flat = np.frombuffer(b"".join(self.bytes), np.uint8).astype(np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(self.lengths[self.lengths > 0])[:-1]] = False
        self.joined = np.zeros(65536, bool)
        self.joined[(flat[:-1] * 256 + flat[1:])[inner[1:]]] = True
        self.specials = [(t.encode(), i) for t, i in sorted(self.added.items(), key=lambda x: -len(x[0]))]
        self.reset()

    def reset(self):
        self.known = np.array(sorted(NONE - i for i in self.added.values()), np.uint64)
        self.at = np.array([len(self.added) - 1 - k for k in range(len(self.added))], np.int32)
        self.flat = np.array(sorted(self.added.values()), np.int32)
        self.sizes = np.ones(len(self.added), np.int32)

    def rank_of(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places, by binary search; the number of merges where there is none."""
        none = len(self.keys)
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[after]
        found = np.minimum(np.searchsorted(self.keys, key), none - 1)
        return np.where((self.keys[found] == key) & (word[at] == word[after]) & (after > at), self.ranks[found], none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, end to end, and their number for each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.of_byte[raw], np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        none = np.int32(len(self.keys))
        rank = np.full(len(sym), none, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], self.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]], none)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            if (over := best == none).any():
                gone = np.repeat(over, span)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                stay = ~gone
                sym, word, rank = sym[stay], word[stay], rank[stay]
                best, span = best[~over], span[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, span))
            if len(hit) > 1 and (np.diff(hit) == 1).any():  # of overlapping pairs, each second one from the left
                run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
                offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[offset % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the new symbols are now; only pairs with them have new ranks
            at = np.concatenate((at, at[at > 0] - 1))
            rank[at] = self.rank_of(sym, word, at)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the texts begin, and the ids of those that are special tokens, else -1."""
        n = len(buf)
        cut, inside = np.zeros(n + 1, bool), None
        cut[off] = True
        raw = buf.tobytes() if self.specials else b""
        found = []
        for token, i in self.specials:
            at = raw.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(off, at, side="right") == np.searchsorted(off, end - 1, side="right"):
                    found.append((at, end, i))
                at = raw.find(token, end)
        if found:
            inside = np.zeros(n, bool)
            for at, end, _ in found:
                cut[[at, end]] = True
                inside[at:end] = True
        kind = byte_kinds(buf)
        start = cut[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        ahead = np.append(space[1:] | cut[1:n], True) if n else space  # white space or the text's end follows
        last = space & ~ahead
        first = lead_bytes(buf, np.flatnonzero(last))  # the first byte of the character that ends the run
        start[first] = True
        plain = np.flatnonzero(last & (buf == 0x20))
        start[plain + 1] = False  # a space goes with what follows
        quote = np.flatnonzero((buf == 0x27) & start) if n else np.zeros(0, np.int64)
        if len(quote):
            pad = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int32)
            stop = np.concatenate((cut, np.ones(3, bool)))
            one = np.isin(pad[quote + 1], SHORT) & ~stop[quote + 1]
            two = np.isin(pad[quote + 1] * 256 + pad[quote + 2], LONG) & ~stop[quote + 1] & ~stop[quote + 2]
            for hit, step in ((quote[two & ~one], 3), (quote[one], 2)):
                start[hit + 1] = False
                if step == 3:
                    start[hit + 2] = False
                to = hit + step
                start[to[to < n]] = True
                start[to[(to < n) & ~cut[np.minimum(to, n)]]] = True
        if inside is not None:
            start[inside] = False
            start |= cut[:n]
        begin = np.flatnonzero(start)
        special = np.full(len(begin), -1, np.int64)
        for at, _, i in found:
            special[np.searchsorted(begin, at)] = i
        return begin, special

    def parted(self, buf: np.ndarray, begin: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of more than LONG_PIECE bytes, cut between bytes that no token holds side by side: no merge crosses there."""
        long = np.flatnonzero(np.diff(np.append(begin, len(buf))) > LONG_PIECE)
        if not len(long):
            return begin, special
        stop = np.append(begin, len(buf))
        more = [x[~self.joined[buf[x - 1].astype(np.int64) * 256 + buf[x]]] for i in long.tolist() if special[i] < 0 for x in [np.arange(begin[i] + 1, stop[i + 1])]]
        both = np.concatenate((begin, *more))
        order = np.argsort(both, kind="stable")
        return both[order], np.append(special, np.full(len(both) - len(begin), -1))[order]

    def encode_bytes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts in UTF-8, end to end, and n + 1 offsets."""
        if not len(buf):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        if len(off) == 2 and len(buf) > 2 * STEP:
            ids = np.concatenate([self._encode(buf[a:b], np.array([0, b - a]))[0].astype(np.int32) for a, b in safe_cuts(buf, STEP, tuple(t for t, _ in self.specials))])
            return ids, np.array([0, len(ids)])
        return self._encode(buf, off)

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self.reset()
        begin, special = self.pieces(buf, off)
        begin, special = self.parted(buf, begin, special)
        size = np.diff(np.append(begin, len(buf)))
        rel = np.arange(len(buf)) - np.repeat(begin, size)
        h = np.add.reduceat(BYTE_HASH[buf] * powers(int(size.max()))[rel], begin)
        h = mix(h + size.astype(np.uint64))
        named = special >= 0
        h[named] = NONE - special[named].astype(np.uint64)
        u, where, code = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
        have = self.known[at] == u if len(self.known) else np.zeros(len(u), bool)
        if not have.all():
            new = where[~have]
            raw = buf.tobytes()
            flat, sizes = self.merge([raw[begin[i] : begin[i] + size[i]] for i in new.tolist()])
            known = np.concatenate((self.known, u[~have]))
            index = np.concatenate((self.at, len(self.sizes) + np.arange(len(new), dtype=np.int32)))
            order = np.argsort(known, kind="stable")
            self.known, self.at = known[order], index[order]
            self.flat, self.sizes = np.concatenate((self.flat, flat.astype(np.int32))), np.concatenate((self.sizes, sizes.astype(np.int32)))
        word = self.at[np.searchsorted(self.known, u)][code]
        n = self.sizes[word]
        head = np.cumsum(self.sizes) - self.sizes
        total = np.cumsum(n)
        ids = self.flat[np.repeat(head[word] - (total - n), n) + np.arange(int(total[-1]))]
        return ids, np.concatenate(([0], total))[np.searchsorted(begin, off)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_bytes, for strings; null is empty."""
        return self.encode_bytes(*string_bytes(pa.array(texts, pa.large_string())))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decoded: bool = True) -> DataFrame:
    """Encode each text and decode its ids again: id, n_tokens, input_ids, decoded; with digests, their hashes in place
    of both; not decoded where that is not asked for.

    A narrow map without a shuffle. Other columns of df, whatever their names, are not read.
    """
    path = path or default_path()
    kind = df.schema[id_col].dataType.simpleString()
    both = digests or decoded
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "input_ids array<int>" + ", decoded string" * decoded

    def run(frames):
        bpe = load(path)
        for batch, buf, at in batches(frames, "text", STEP):
            ids, off = bpe.encode_bytes(buf, at)
            n = np.diff(off)
            small = ids.astype("<u4")
            a, b = [], []
            for i in range(len(n) if both else 0):
                x = small[off[i] : off[i + 1]]
                raw = bpe.decode_bytes(x).decode("utf-8", "replace")
                if digests:
                    a.append(hashlib.sha256(x.tobytes()).hexdigest())
                    b.append(hashlib.sha256(raw.encode()).hexdigest())
                else:
                    b.append(raw)
            a = pa.array(a, pa.string()) if digests else pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(small.astype(np.int32)))
            names = ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["input_ids", "decoded"])]
            cols = [batch.column("id"), pa.array(n, pa.int64()), a, *([pa.array(b, pa.string())] if both else [])]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])
        bpe.reset()

    from pyspark.sql import functions as F

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_tokens long, {tail}").withColumnRenamed("id", id_col)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digests=True)

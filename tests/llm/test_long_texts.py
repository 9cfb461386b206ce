"""Texts of some megabytes without spaces: encoded whole, as the tokenizers library does."""

import random

import numpy as np
import pytest

from driftgauge.llm import bpe


def chinese(n):
    rng = random.Random(1)
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.93 else "。" for _ in range(n))


def base64(n):
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
    return letters[rng.integers(0, 64, n)].tobytes().decode()


def minified(n):
    rng = random.Random(3)
    return "[" + ",".join('{"id":%d,"it\'s":"%s","k":[%d,null]}' % (i, "éa'llx"[: rng.randrange(7)], rng.randrange(10**6)) for i in range(n // 32)) + "]"


@pytest.mark.parametrize("text", [chinese(1_000_000), base64(3_000_000), minified(3_000_000), "a" * 2_300_000, "é" * 1_200_000, " " * 2_300_000 + "x", "<|endoftext|>" * 200_000, "!'s" * 900_000, "x's9'll" * 400_000], ids=lambda t: t[:8])
def test_long(text):
    from tokenizers import Tokenizer

    b = bpe.load(bpe.default_path())
    b.reset()
    ids, off = b.encode([text])
    want = Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids
    assert off.tolist() == [0, len(want)] and ids.tolist() == want
    assert b.decode(ids) == text


def test_cuts_change_nothing():
    """Parts of a few bytes give the ids of the whole."""
    rng, b = random.Random(5), bpe.load(bpe.default_path())
    letters = ["a", "b", "'s", "'ll", "re", "'", " ", "  ", "\n", "\t", "é", "½", "1", "23", "!", "?'", "　", "日本", "🎉", "<|endoftext|>", "<|", "|>", "xyzzy"]
    specials = tuple(t for t, _ in b.specials)
    for _ in range(1500):
        raw = np.frombuffer("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))).encode(), np.uint8)
        whole = b.encode_bytes(raw, np.array([0, len(raw)]))[0]
        parts = list(bpe.safe_cuts(raw, rng.randrange(4, 12), specials))
        assert parts[0][0] == 0 and parts[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert np.concatenate([b.encode_bytes(raw[s:e], np.array([0, e - s]))[0] for s, e in parts]).tolist() == whole.tolist(), raw.tobytes()

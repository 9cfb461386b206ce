"""Very long strings and texts: time and memory stay in proportion."""

import re
import time

from driftgauge.llm import secrets


def test_long_candidates_take_linear_time():
    for s in ("ab" + "-cd" * 10_000 + "9", "ab" + "-Cd" * 10_000 + "9x", "aA" * 15_000 + "9", "a1-" * 10_000 + "Z", "Ab" * 9000 + "_" * 9000 + "9-"):
        secrets.judged(s)
        began = time.perf_counter()
        secrets.judged(s)
        assert time.perf_counter() - began < 0.05
    assert secrets.candidate("ab" + "-cd" * 45 + "9") == ()


def test_allow_list_as_a_plain_pattern():
    import random

    rng, name = random.Random(1), "(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+)"
    allow = re.compile(r"[a-z_/=+-]+|[A-Z_/=+-]+|[0-9_=+/-]+|[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
    again, readable = re.compile(r"(.{1,4}?)\1+.{0,3}"), re.compile(f"[-_/=+]*{name}(?:[-_/=+]+{name})*[-_/=+]*")
    for _ in range(20_000):
        letters = rng.choice(["ab-_A9", "aA1", "ab-", "Ab/C", "aXx"])
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 14)))
        if rng.random() < 0.2:
            s = s[:3] * 4 + s[: rng.randrange(4)]
        assert bool(secrets.ALLOW.fullmatch(s)) == bool(allow.fullmatch(s)), s
        assert bool(secrets.READABLE.fullmatch(s)) == bool(readable.fullmatch(s)), s
        assert secrets.repeats(s) == bool(again.fullmatch(s)), s

"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least WINDOW token characters. A window slides over it; the counts of its
characters, and with them the entropy, change by one character leaving and one entering at each
step. A candidate with a window at or above the threshold of its character class (hex; letters of
one case, as in base32 and base36; both cases, as in base64) is a span as a whole. What reads as
words and numbers joined by signs must reach BASE64_BITS, whatever its case. Allow-listed candidates
(UUIDs, runs of letters of one case, digits only, repeated placeholders, published example keys) are
suppressed. Patterns read a candidate once along, so a string of any length takes linear time. The base patterns' spans always stay.

Positions are code points. Null and empty texts have no spans; texts are scanned whole. Each row is
scanned by itself: repeated rows give equal results, and ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import documents, frugal, trim

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The window in characters, and bits of entropy a character that a window of hex and of readable names must reach.
WINDOW, HEX_BITS, BASE64_BITS = 20, 3.0, 3.9
#: The same for letters of one case and of both: under 1 % of random tokens of one window have less.
SINGLE_BITS, MIXED_BITS = 3.3, 3.6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]++")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Each of these is read once along the string: the quantifiers are possessive, so that none is tried again.
ALLOW = re.compile(r"[a-z_/=+-]++|[A-Z_/=+-]++|[0-9_=+/-]++|(?:[A-Z]?[a-z]++[-_/])*+[A-Z]?[a-z]++|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", re.A)
PLACEHOLDERS = ("EXAMPLE", "example", "placeholder", "XXXX", "xxxx")
_NAME = "(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[0-9]++)"
READABLE = re.compile(f"[-_/=+]*+{_NAME}(?:[-_/=+]++{_NAME})*+[-_/=+]*+", re.A)
_part = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    return sorted(out)


#: Characters of a candidate that are turned into arrays at once.
PIECE = 1 << 16


def passes(s: str, least: float, window: int = WINDOW) -> np.ndarray:
    """For each start of a window of s, whether its entropy is at least so many bits a character.

    The counts change by a character that enters and one that leaves: what n log2 n gains and loses
    is added up along the string, one class of equal characters at a time.
    """
    x = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    n = len(x) - window + 1
    if n <= 0:
        return np.zeros(0, bool)
    part = np.concatenate(([0.0], np.arange(1, window + 1) * np.log2(np.arange(1, window + 1))))
    total = np.zeros(n)  # the sum of n log2 n over the counts
    for c in np.unique(x):
        step = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x == c, out=step[1:])
        total += part[step[window:] - step[:-window]]
    return log2(window) - total / window >= least - 1e-9


def windows(s: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of s whose entropy is at least so many bits a character."""
    out: list[tuple[int, int]] = []
    for at in range(0, max(len(s) - window + 1, 0), PIECE):
        for i in np.flatnonzero(passes(s[at : at + PIECE + window - 1], least, window)).tolist():
            a, b = at + i, at + i + window
            if out and out[-1][1] >= a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def any_window(s: str, least: float) -> bool:
    """Whether a window of s has that much entropy: counts of the characters slide along it, and it stops at the first."""
    if len(s) > 512:
        return any(passes(s[at : at + PIECE + WINDOW - 1], least).any() for at in range(0, len(s) - WINDOW + 1, PIECE))
    count: dict[str, int] = {}
    total, enough = 0.0, (log2(WINDOW) - least + 1e-9) * WINDOW
    for i, c in enumerate(s):
        n = count.get(c, 0)
        total += _part[n + 1] - _part[n]
        count[c] = n + 1
        if i >= WINDOW:
            n = count[s[i - WINDOW]]
            total -= _part[n] - _part[n - 1]
            count[s[i - WINDOW]] = n - 1
        if i >= WINDOW - 1 and total <= enough:
            return True
    return False


def repeats(s: str) -> bool:
    """One to four characters over and over, with at most three more at the end."""
    ends = ((k, len(s) - r) for k in range(1, 5) for r in range(4))
    return any(n >= 2 * k and n % k == 0 and s[k:n] == s[: n - k] for k, n in ends)


def judged(s: str) -> tuple[tuple[int, int, int], ...]:
    if ALLOW.fullmatch(s) or any(p in s for p in PLACEHOLDERS) or repeats(s):
        return ()
    if HEXADECIMAL.fullmatch(s):
        return ((0, 3, len(s)),) if any_window(s, HEX_BITS) else ()
    if not (re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s)):
        return ()
    if READABLE.fullmatch(s):
        least = BASE64_BITS
    else:
        least = MIXED_BITS if re.search(r"[a-z]", s) and re.search(r"[A-Z]", s) else SINGLE_BITS
    return ((0, 4, len(s)),) if any_window(s, least) else ()


#: Candidates of usual length are often met again; longer ones are judged anew, so the cache is some 3 MB at most.
_judged = lru_cache(1 << 13)(judged)


def candidate(s: str) -> tuple[tuple[int, int, int], ...]:
    return _judged(s) if len(s) <= 100 else judged(s)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        out += [(a + at, k, b + at) for a, k, b in candidate(m[0])]
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the entropy spans, by start and then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def mask(text: str | None, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by a mark."""
    if not found:
        return text
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of each row. A narrow map; other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        frugal()
        for batch in frames:
            rows = []
            for text in batch.column("text"):
                base, found = spans(text.as_py())
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with the secrets of each text masked, and with size_col as the new text's length; the columns stay as they are."""
    schema = df.schema
    at = df.columns.index(text_col)

    def run(frames):
        frugal()
        for batch in frames:
            new = pa.array((mask(x, spans(x)[1]) for x in (t.as_py() for t in batch.column(at))), pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), new)
        trim()

    out = df.mapInArrow(run, schema)
    if size_col and size_col in df.columns:
        out = out.withColumn(size_col, F.coalesce(F.length(text_col), F.lit(0)).cast(schema[size_col].dataType))
    return out


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

"""op9's scores against a plain coder that goes bit by bit with dictionaries, and what the mixed predictors must do."""

import math
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest

from driftgauge.llm import contexts as C
from driftgauge.llm import scoring as S
from driftgauge.session import ship


def contexts_of(done, before, so_far):
    """The five contexts of a byte, by value: bytes of the text so far, the word before, the word so far."""
    return [done[-1:], done[-2:], done[-4:], so_far, (before, so_far)]


def coded(words):
    """Of each byte of the words: its word, place, contexts and value."""
    done, before = b"\0\0\0 ", None
    for i, w in enumerate(words):
        w = w.encode() + b" "
        for j in range(len(w)):
            yield i, j, contexts_of(done, before, w[:j]), w[j]
            done += w[j : j + 1]
        before = w


def runs(n, first):
    a = 0
    while a < n:
        b = a + max(first, a // 32)
        yield a, min(b, n)
        a = b


def plain_bits(rows, run, first):
    """log10 probability of rows of (gate, [(inputs, bit)]), weights and map learned run by run."""
    w = defaultdict(lambda: [float(x) for x in first])
    power = defaultdict(lambda: [C.EVIDENCE] * len(first))
    ones = [C.PRIOR / (1 + math.exp(-(-8 + 16 * i / (C.BINS - 1)))) for i in range(C.BINS)]
    seen, out = [C.PRIOR] * C.BINS, 0.0
    for a, b in runs(len(rows), run):
        steps, hits = defaultdict(lambda: [0.0] * len(first)), []
        for gate, bits in rows[a:b]:
            for s, y in bits:
                z = max(-12.0, min(12.0, sum(x * v for x, v in zip(s, w[gate], strict=True))))
                p = 1 / (1 + math.exp(-z))
                cell = int(max(0.0, min(C.BINS - 1, (z + 8.25) * (C.BINS - 1) / 16)))
                q = (p + ones[cell] / seen[cell]) / 2
                out += math.log10(max(q if y else 1 - q, 1e-6))
                hits.append((cell, y))
                for k, x in enumerate(s):
                    steps[gate][k] += (y - p) * x
        for gate, step in steps.items():
            for k, v in enumerate(step):
                power[gate][k] += v * v
                w[gate][k] += C.RATE * v / math.sqrt(power[gate][k])
        for cell, y in hits:
            ones[cell] += y
            seen[cell] += 1
    return out


def bit_nodes(v):
    """The bits of a byte, each with its nibble's number, the bits of the nibble before it, and what comes of the high nibble."""
    for d in range(8):
        yield (v >> 4 if d > 3 else None, d // 4, (v >> (8 - d)) & ((1 << d % 4) - 1), d % 4), (v >> (7 - d)) & 1


def plain_scores(rows):
    """{id: score} of texts without anchors that predict: the end's flags, and all bytes."""
    own = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    words = {i: brute.WORD.findall(brute.lower(t)) for i, t in rows}
    n_train, total = sum(own.values()), sum(len(words[i]) + 1 for i in own if own[i])
    count = defaultdict(lambda: [0, 0])
    for i, ws in words.items():
        for _, _, ctx, v in coded(ws) if own[i] else ():
            for node, y in bit_nodes(v):
                for k, c in enumerate(ctx):
                    count[k, c, node][y] += 1
    out = {}
    for i, ws in words.items():
        e = (n_train - own[i] + 0.5) / (total - own[i] * (len(ws) + 1) + 1)
        z = math.log(e / (1 - e))
        out[i] = plain_bits([(0, [((z, 1.0), int(at == len(ws)))]) for at in range(len(ws) + 1)], C.FLAGS, (1.0, 0.0))
        lines = []
        for _, j, ctx, v in coded(ws):
            bits = []
            for node, y in bit_nodes(v):
                s = []
                for k, c in enumerate(ctx):
                    n = list(count[k, c, node])
                    n[y] -= own[i]
                    logit = round(math.log((n[1] + C.DELTA) / (n[0] + C.DELTA)) * C.SCALE)
                    s.append(max(-127, min(127, logit)) / C.SCALE)
                bits.append((s, y))
            seen = sum(count[3, ctx[3], (None, 0, 0, 0)]) - own[i]
            lines.append(([0, 1, 2, 2, 3][min(j, 4)] * 4 + sum(seen >= x for x in (1, 4, 32)), bits))
        out[i] += plain_bits(lines, C.RUN, [C.FIRST] * C.PREDICTORS)
    return out


@pytest.fixture
def wide(monkeypatch):
    """So many lines that contexts do not meet."""
    monkeypatch.setattr(C, "MOST", (16, 18, 18, 18, 18))
    monkeypatch.setattr(C, "FEWEST", 18)


def test_mixed_score_against_plain(spark, wide):
    ship(spark)
    # fewer words than an anchor has, so that no word is foretold; and one longer text of words of its own
    texts = ["the cat sat", "the cat", "Émile sat on", "on the", None, "", "x", "the the the"] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + j, " ".join(f"{j}w{i * i}" for i in range(150))) for j in range(2)]
    got = {r.doc_id: r.score for r in S.mixed_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in plain_scores(rows).items():
        assert abs(got[i] - x) < 2e-3 * max(1, -x), (i, got[i], x)


def test_every_known_word_is_coded_by_the_predictors(spark):
    """Two held-out texts of the same known words, as often, in another order: the words before count, though none is foretold by an anchor."""
    ship(spark)
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, "red fox" if i % 2 else "blue jay") for i in free[:400]]
    rows += [(held[0], "red fox blue"), (held[1], "fox red blue")]
    got = {r.doc_id: r for r in S.mixed_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 0.3


def test_weights_learn_along_the_text(spark):
    """The later half of a text whose bits go against the corpus costs less than the first."""
    rng = np.random.default_rng(3)
    s = [rng.normal(0, 2, (8, 4000)).astype(np.float32) for _ in range(2)]
    y = (s[0] < 0).astype(np.float32)  # the first predictor is always wrong
    model, cost = C.Online(1, 1, [0.3, 0.3]), []
    for a in range(0, 4000, 100):
        at = slice(a, a + 100)
        zero = np.zeros(100, np.int64)
        cost.append(model.code(zero, zero, [x[:, at] for x in s], y[:, at]).sum())
    assert sum(cost[20:]) > 0.8 * sum(cost[:20]) and model.w[0][0] < 0


def test_mixed_scores_on_any_cluster(spark, sf):
    ship(spark)
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in S.mixed_score(df.repartition(n)).collect()} for n in (1, 17))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-6 * max(1, -one[i]) for i in one)


def test_slots_grow_with_the_texts():
    assert C.line_bits(0) == (8,) * 5 and C.line_bits(1 << 14) < C.line_bits(1 << 18) < C.line_bits(1 << 40) == C.MOST

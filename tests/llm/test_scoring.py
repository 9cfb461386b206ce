"""The language model's score against a plain one, its order and settings, and what repeats."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from driftgauge.llm import scoring as S
from driftgauge.session import ship


def word_hash(w):
    return int(S.hashes(np.frombuffer(w.encode(), np.uint8), np.array([len(w.encode())]))[0])


def mix(x):
    return int(S.mix(np.array([x % 2**64], np.uint64))[0])


def plain_anchors(h):
    """(place, words, key) of a text's anchors."""
    keys = [mix(sum(h[i + j] * int(S._SALT[j + 1]) for j in range(3))) for i in range(len(h) - 3)]
    at = sorted({min(range(i, min(i + S.SPAN, len(keys))), key=lambda j: (keys[j], j)) for i in range(len(keys))})
    ends = [a + 3 for a in at[1:]] + [len(h)]
    return [(a, e - a - 3, keys[a]) for a, e in zip(at, ends, strict=False)]


def plain(rows, spelled, odds_of):
    """{id: score}: predictions, lexicon and flags by dictionaries; spelled costs and hit odds are given."""
    own = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    words = {i: brute.WORD.findall(brute.lower(t)) for i, t in rows}
    n_train = sum(own.values())
    c = Counter(w for i, ws in words.items() if own[i] for w in ws)
    total, once = sum(c.values()) + n_train, sum(x == 1 for x in c.values())
    votes, of, counts = defaultdict(Counter), {}, np.zeros(S.CELLS * 2)
    for i, ws in words.items():
        h = [word_hash(w) for w in ws]
        seen, of[i] = set(), []
        for a, n, key in plain_anchors(h):
            first = own[i] and key not in seen
            seen.add(key)
            ahead = ws[a + 3 : a + 3 + n]
            of[i].append((a, ahead, key, first))
            if first:
                for j, p in enumerate(ahead):
                    votes[key, j][p] += 1
    guesses = {}
    for i, found in of.items():
        for a, ahead, key, first in found:
            before = 0
            for j, p in enumerate(ahead):
                v = votes[key, j] - Counter([p] if first else [])
                if not v:
                    before = 0
                    continue
                n, _, best = min((-n, word_hash(q), q) for q, n in v.items())
                n, rest = -n, sum(v.values())
                kind = (2 if n == rest else 1 if 2 * n > rest else 0) + S.AGREE * min(int(math.log2(n)), S.SUPPORT - 1)
                cell = (kind * S.STATES + before) * S.SPAN + j
                guesses[i, a + 3 + j] = (cell, best == p)
                before = 1 + (best == p)
                if first:
                    counts[2 * cell + (best == p)] += 1
    odds = odds_of(counts)
    out = {}
    for i, ws in words.items():
        tf, left = Counter(ws), max(total - (len(ws) + 1 if own[i] else 0), 1)
        start = min(max((once + 0.5) / (total + 1), 1e-6), 1 - 1e-6)
        score, coded, new = 0.0, 0, 0
        for at, w in enumerate(ws):
            if (i, at) in guesses:
                cell, hit = guesses[i, at]
                score += math.log10(odds[cell] if hit else 1 - odds[cell])
                if hit:
                    continue
            rest = c[w] - (tf[w] if own[i] else 0)
            q = (new + S.PRIOR * start) / (coded + S.PRIOR)
            score += math.log10(1 - q) + math.log10(rest / left) if rest else math.log10(q) + spelled(w)
            coded, new = coded + 1, new + (rest == 0)
        out[i] = score + math.log10(max(n_train - own[i], 0.5) / left)
    return out, c


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(40) for _ in range(3)]
    rows = [(i, " ".join([line(rng.randrange(0, 60)), rng.choice([*shared, ""]), line(rng.randrange(0, 20)), rng.choice([*shared, ""])])) for i in range(70)]
    return [*rows, (70, None), (71, ""), (72, "X"), (73, "new words only here"), (74, rows[0][1]), (75, rows[0][1] + " x")]


def wanted(rows):
    """Scores by the plain form; what spelling costs comes from the byte predictors, trained on the rows' training words."""
    tables = S.fresh()
    own = [(i, brute.WORD.findall(brute.lower(t))) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    known = sorted({w for _, ws in own for w in ws}, key=word_hash)
    arrays = lambda ws: (np.frombuffer("".join(ws).encode(), np.uint8), np.array([len(w.encode()) for w in ws]))
    S.count_words(tables, *arrays(known))
    model, mixer = S.logits(tables), S.Mixer()
    _, x, slots = S.steps(*arrays(known))
    mixer.learn(*S.inputs(model, slots), x)
    final = S.Mixer(mixer.w, S.Mixer().apm + np.rint(mixer.apm - S.Mixer().apm))
    return plain(rows, lambda w: float(np.float32(S.word_logs(model, final, *arrays([w]))[0])), S.hit_odds)[0]


def test_score_against_plain(spark, texts):
    ship(spark)
    got = {r.doc_id: r for r in S.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, x in wanted(texts).items():
        assert abs(got[i].score - x) < 1e-4 * max(1, -x), (i, got[i].score, x)
        text = dict(texts)[i] or ""
        assert abs(got[i].bits_per_byte + x / math.log10(2) / (len(text.encode()) + 1)) < 1e-3 * max(1, got[i].bits_per_byte)


def test_order_and_repeats_count(spark, texts):
    ship(spark)
    rng = random.Random(5)
    words = brute.WORD.findall(texts[0][1])
    rng.shuffle(words)
    rows = [*texts, (200, " ".join(words))]
    got = {r.doc_id: r for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[74].bits_per_byte < 0.5 * got[200].bits_per_byte


def test_same_scores_on_any_cluster(spark, texts):
    ship(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r.doc_id: r.score for r in S.score(df.repartition(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        many = {r.doc_id: r.score for r in S.score(df.repartition(17)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-6 * max(1, -one[i]) for i in one)


def test_a_word_that_shares_hash_bits_is_no_hit(spark, texts):
    """A known passage with one word replaced by an unseen one whose hash begins as the word's own: it costs what the plain form, which knows
    words and no hashes, says, and much more than the passage itself."""
    ship(spark)
    passage = [f"w{i}" for i in range(60)]
    rows, begins = [*texts, *((300 + i, " ".join(passage)) for i in range(12))], {}
    for i in range(400_000):
        begins.setdefault(word_hash(f"q{i:06d}") >> 48, f"q{i:06d}")
    held = [i for i in range(1000, 4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    twins = [(held.pop(), " ".join([*passage[:at], begins[word_hash(passage[at]) >> 48], *passage[at + 1 :]])) for at in range(5, 60, 5) if word_hash(passage[at]) >> 48 in begins]
    whole = held.pop()
    rows += [*twins, (whole, " ".join(passage))]
    got = {r.doc_id: r.score for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = wanted(rows)
    assert len(twins) >= 5 and all(abs(got[i] - want[i]) < 1e-4 * max(1, -want[i]) for i in got)
    assert all(got[i] < got[whole] - 12 for i, _ in twins)

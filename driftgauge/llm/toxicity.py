"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of lower-cased code points, present or not. From the training rows each
feature gets r = log((p + a) / |p|) - log((q + a) / |q|), p and q its document counts in both
classes; the features with the largest likelihood ratio G2 are kept, and a logistic regression over
x * r with an L2 penalty gives the weights. Only the text is an input of a score.

Training uses at most MAX_TRAIN labelled rows, those of least hash of their id (ties by id): a
documented bound; of repeated rows of an id the least text is read. Features are counted by tasks;
the kept features of these rows, a bounded matrix, are fitted on the driver, and the model, of a fixed
size, is broadcast. Held-out is false for a null id, which no label can name.
Null and empty texts score the intercept alone. Labels that are null or of unknown documents are
not used; of repeated labels of a document the largest counts. Without rows of both labels the
score is the share of label 1 (0.5 with no rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.text import checkpoint, documents, frugal, lean, trim

#: Labelled rows that the fit uses at most.
MAX_TRAIN = 8000
#: Sizes of the n-grams, hash bits, features kept, and smoothing of the counts.
SIZES, BITS, FEATURES, ALPHA = (4, 5, 6), 20, 30_000, 0.5  # at most 65,536 features
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of a text, repeated ones included; its ends count as spaces."""
    x = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    x = np.where((x < 33) | (x == 160), np.uint32(32), x)
    x = (x ^ (x >> np.uint32(7))) * np.uint32(0x7FEB352D)
    out, acc = [], x * _MUL[0]
    for k in range(1, max(SIZES)):
        if len(x) <= k:
            break
        acc = acc[:-1] + (x[k:] ^ np.uint32(k)) * _MUL[k]
        if k + 1 in SIZES:
            h = (acc ^ np.uint32((k * 0x5BD1E995) & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
            out.append((h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of label 1 and of label 0 have each hashed feature."""
    both = np.zeros((2, 1 << BITS), np.int32)
    for x, label in zip(rows, y, strict=True):
        both[0 if label else 1, x] += 1
    return both[0], both[1]


def select(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of largest G2, in order of hash, and the log-count ratio of each."""
    r = np.log((df1 + ALPHA) / (df1 + ALPHA).sum()) - np.log((df0 + ALPHA) / (df0 + ALPHA).sum())
    total, n = df1 + df0, n1 + n0
    g2 = np.zeros(len(df1))
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, row, col in ((df1, total, n1), (df0, total, n0), (n1 - df1, n - total, n1), (n0 - df0, n - total, n0)):
            g2 += np.where(seen > 0, seen * np.log(seen * n / (row * col)), 0)
    g2[total < 3] = 0
    kept = np.sort(np.argsort(-g2, kind="stable")[:FEATURES])
    kept = kept[g2[kept] > 0]
    return kept.astype(np.int32), r[kept]


def columns(text: str | None, kept: np.ndarray) -> np.ndarray:
    """Which of the kept features a text has."""
    x = np.unique(grams(text)).astype(np.int32)
    if not len(kept) or not len(x):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(kept, x), len(kept) - 1)
    return at[kept[at] == x].astype(np.int32)


def regress(cols: list[np.ndarray], y: np.ndarray, scale: np.ndarray, steps: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the kept features and the intercept, by Adam over all rows."""
    y = np.asarray(y, np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    size = np.array([len(c) for c in cols])
    row, col = np.repeat(np.arange(len(cols), dtype=np.int32), size), np.concatenate(cols) if size.sum() else np.zeros(0, np.int32)
    back = np.argsort(col, kind="stable")
    turned, k = row[back], len(scale)  # the rows of each feature, end to end
    many = np.bincount(col, minlength=k)
    norm = max(np.sqrt((many * scale**2).sum() / len(cols)), 1e-9)
    scale = scale / norm
    full, used = np.flatnonzero(size), np.flatnonzero(many)
    heads, tails = (np.cumsum(size) - size)[full], (np.cumsum(many) - many)[used]
    w, b, v, vb, m, mb = np.zeros(k), float(np.log(n1 / n0)), np.zeros(k), 0.0, np.zeros(k), 0.0
    for t in range(1, steps + 1):
        z, gw = np.full(len(cols), b), np.zeros(k)
        if len(col):
            z[full] += np.add.reduceat((w * scale).astype(np.float32)[col], heads)
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        if len(col):
            gw[used] = np.add.reduceat(g.astype(np.float32)[turned], tails)
        gw = gw * scale / len(cols) + penalty * w / len(cols)
        gb = g.mean()
        m, mb, v, vb = 0.9 * m + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * v + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 / (1 + t / 60)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return w * scale, float(b)


def share(n1: float, n0: float) -> float:
    """The intercept where only one label, or none, is there."""
    p = min(max((n1 + 0.5) / (n1 + n0 + 1), 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit(texts: list[str | None], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all hashed features, and the intercept, in this process."""
    y, weights = np.asarray(y), np.zeros(1 << BITS, np.float32)
    n1, n0 = int((y == 1).sum()), int((y != 1).sum())
    if not n1 or not n0:
        return weights, share(n1, n0)
    kept, scale = select(*counts([np.unique(grams(t)) for t in texts], y), n1, n0)
    w, b = regress([columns(t, kept) for t in texts], y, scale)
    weights[kept] = w
    return weights, b


def score(texts: list[str | None], weights: np.ndarray, b: float) -> np.ndarray:
    """Probability of label 1; each feature of a text counts once."""
    out, seen = np.empty(len(texts)), np.zeros(len(weights), np.float32)
    for i, t in enumerate(texts):
        g = grams(t.as_py() if isinstance(t, pa.Scalar) else t)
        w = weights[g]
        live = w != 0
        g = g[live]
        seen[g] = w[live]
        once = g[np.flatnonzero(seen[g])]
        once = np.unique(once)
        out[i] = seen[once].sum(dtype=np.float64)
        seen[g] = 0
    return 1 / (1 + np.exp(-np.clip(out + b, -40, 40)))


#: Rows of a task that counts features, and features of a piece of the counts.
TASK_ROWS, PIECE = 500, 1 << 14


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0; docs holds their texts.

    Tasks count features and pick out the kept ones; the last step sees bounded numbers alone.
    """
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, so it can be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = checkpoint(rows.repartition(max(1, -(-most // TASK_ROWS)), "id"))
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return weights, share(n1, n0) if n1 or n0 else 0.0

    def count(frames):
        frugal()
        both = np.zeros((2, 1 << BITS), np.int32)
        for batch in frames:
            for text, label in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                both[0 if label else 1, np.unique(grams(text.as_py()))] += 1
        for i in range(0, both.shape[1], PIECE):
            part = both[:, i : i + PIECE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i // PIECE], pa.int32()), "c": [part.astype("<u2").tobytes()]})
        trim()

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), "<u2").astype(np.int32) for c in t.column("c"))
        return pa.table({"piece": t.column("piece")[:1], "c": [total.astype("<i4").tobytes()]})

    both = np.zeros((2, 1 << BITS), np.int32)
    for row in rows.select("text", "y").mapInArrow(count, "piece int, c binary").groupBy("piece").applyInArrow(lean(add), "piece int, c binary").collect():  # of the size of the hash
        both[:, row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(row["c"], "<i4").reshape(2, -1)
    kept, scale = select(both[0], both[1], int(n1), int(n0))
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def pick(frames):
        frugal()
        for batch in frames:
            found = [columns(t.as_py(), sent.value).astype("<u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.binary())], ["id", "y", "cols"])
        trim()

    kind = rows.schema["id"].dataType.simpleString()
    picked = rows.select("id", "y", "text").mapInArrow(pick, f"id {kind}, y int, cols binary").orderBy("id").toArrow()  # at most `most` rows of kept features
    w, b = regress([np.frombuffer(c.as_py(), "<u2").astype(np.int32) for c in picked.column("cols")], picked.column("y").to_numpy(), scale)
    weights[kept] = w
    return weights, b


def classify(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score of each text as a column, in place of one of that name; a narrow map."""
    df = df.drop(score_col)
    at = np.flatnonzero(model[0]).astype(np.uint32)
    sent = df.sparkSession.sparkContext.broadcast((at, model[0][at], model[1]))
    schema = df.select("*", F.lit(0.0).alias(score_col)).schema
    place = df.columns.index(text_col)

    def run(frames):
        where, values, b = sent.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[where] = values
        frugal()
        for batch in frames:
            s = score(batch.column(place), weights, b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, score_col])
        trim()

    return df.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, documents(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

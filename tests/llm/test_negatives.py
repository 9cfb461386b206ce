"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import negatives
from driftgauge.session import ship


def plain(rows, every=100, positives=5, k=10):
    """Rows are (id, label, vector); Python integers throughout."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in good if len(w) == len(v)]
        near = sorted(((-s, j) for s, j, m in score if m == lab and j != i))[:positives]
        for s, j in near:
            far = sorted((-t, n) for t, n, m in score if m != lab and 30 * -s <= 100 * t <= 90 * -s)[:k]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(far, 1)]
    return sorted(out)


def made(n, dim, labels, seed, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, dim))
    return [(i, int(c := rng.integers(labels)), (centers[c] * rng.choice([0.0, 1.0]) + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def mined(spark, rows, kind="double", **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, label long, embedding array<{kind}>, data int")
    return sorted(tuple(r) for r in negatives.mine(df, **more).collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 4096, "few": 2}, {"block": 2048, "slab": 300, "few": 1}])
def test_all_rows(spark, sizes):
    ship(spark)
    rows = made(900, 6, 4, 1)
    got = mined(spark, rows, **sizes)
    assert got == plain(rows) and len(got) > 100


def test_ties_hot_labels_and_awkward_rows(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i, 1 if i % 3 else int(i % 5), rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(700)]
    rows += [(None, 1, [1.0] * 3), (1000, None, [1.0] * 3), (1100, 1, None), (1200, 1, [1.0, None, 1.0]), (1300, 1, [float("nan")] * 3), (1400, 1, [float("inf"), 0.0, 0.0]), (1500, 7, [1.0] * 3), (1600, 1, []), (1700, 1, [1.0, 2.0]), (1701, 1, [1.0, 2.0]), (1702, 2, [0.5, 0.7]), (1800, 1, [0.0] * 3), (5, 1, [1.0] * 3), (200, 2, [1.0, 1.0, -1.0])]
    got = mined(spark, rows, block=1024, few=3)
    assert got == plain(rows) and any(r[0] == 1700 for r in got)


def test_long_vectors_are_exact(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), (rng.normal(size=5) * 2.0**19).tolist()) for i in range(300)]
    assert mined(spark, rows) == plain(rows) and max(abs(r[4]) for r in plain(rows)) > 1 << 53
    assert mined(spark, [*rows, (400, 1, [2.0**30] * 5)]) == plain(rows)


def test_op13(spark, sf):
    import duckdb

    ship(spark)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(negatives.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in negatives.op13_negatives(spark, sf).collect())
    rows = [(r.vec_id, r.label if r.vec_id % 7 or r.label is None else (r.label + 1) % 10, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == want == plain(rows) and got


def test_no_rows_and_other_anchors(spark):
    ship(spark)
    rows = made(120, 4, 3, 5)
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")
    assert negatives.mine(df.where("false")).count() == 0 and negatives.mine(df.where("vec_id % 100 <> 0")).count() == 0
    single = [(i, lab, np.float32(v).astype(float).tolist()) for i, lab, v in rows]
    assert sorted(tuple(r) for r in negatives.mine(df, anchor=F.col("vec_id") % 10 == 0, positives=2, negatives=3).collect()) == plain(single, 10, 2, 3)


def test_bounds_hold_and_prune():
    """No pair that a bound rules out has a score in reach, and groups of anchors are ruled out whole."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 8)) * 20 + 400 * rng.normal(size=8) for _ in range(6)]).astype(np.int32)
    labels = np.zeros(len(x), np.int64)
    a, c = negatives.Ball(x[::7], np.arange(len(x))[::7], labels[::7], 8), negatives.Ball(x, np.arange(len(x)), labels, 16)
    score = a.x.astype(np.int64) @ c.x.astype(np.int64).T
    need = np.sort(score, 1)[:, -5]
    low = a.least(need).astype(float)
    seen = 0
    tested = []

    def use(i, j, lo, up):
        for p, q, s, t in zip(i, j, lo, up, strict=True):
            own = score[a.start[p] : a.end[p], c.start[q] : c.end[q]]
            assert s <= own.min() and own.max() <= t
        tested.append(len(i))
        return up >= low[i]

    kept = negatives.meet(a, c, use)
    for p, q, _ in zip(*kept, strict=True):
        seen += int((score[a.start[p] : a.end[p], c.start[q] : c.end[q]] >= need[a.start[p] : a.end[p], None]).sum())
    leaves = (a.left < 0).sum() * (c.left < 0).sum()
    print(len(kept[0]), leaves, sum(tested))
    assert seen == (score >= need[:, None]).sum() and len(kept[0]) < leaves / 3 and sum(tested) < leaves

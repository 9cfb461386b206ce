"""What coding a byte costs: one look for each nibble and predictor; and counts that a task sends in parts."""

import numpy as np

from driftgauge.llm import contexts as C
from driftgauge.llm import scoring as S
from driftgauge.session import ship


class Looked(np.ndarray):
    def take(self, at, *args, **kwargs):
        LOOKS.append(len(at))
        return super().take(at, *args, **kwargs)


LOOKS: list[int] = []


def test_a_nibble_is_one_look_in_a_table():
    words = [f"w{i * i}" for i in range(300)]
    raw, size = np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words])
    count = np.array([100, 200])
    stream = C.Stream(raw, size, S.hashes(raw, size), np.arange(300), count)
    sizes, own = C.line_bits(len(raw)), np.array([True, False])
    counted = C.fresh(sizes)
    C.count_bytes(counted, stream, np.arange(100), np.where(np.arange(300) < 100, 1, 0), sizes)
    told = [C.paths(t) for t in counted]
    tables = [t.ravel() for t, _ in told] + [told[3][1].ravel()]
    predictors = C.Told(tables, sizes, stream)
    predictors.tables = [t.view(Looked) for t in tables[:-1]]
    LOOKS.clear()
    out = C.spell(predictors, np.arange(2), np.zeros(300, bool), own)
    coded = int(stream.long.sum())
    assert 0 < sum(LOOKS) <= 2 * C.PREDICTORS * coded and (out < 0).all()
    alone = [C.spell(predictors, np.array([i]), np.zeros(300, bool), own)[0] for i in (0, 1)]
    assert np.allclose(out, alone, rtol=1e-9)


def test_counts_sent_in_parts(spark, monkeypatch):
    ship(spark)
    rows = [(i, f"word{i % 7} and another {i % 11} here") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    whole = {r.doc_id: r.score for r in S.mixed_score(df).collect()}
    n_bytes, texts, *_ = S.gather(df, "doc_id", "text", 1, 5)
    sizes = C.line_bits(n_bytes)
    frames = [texts.select("train", "count", "code", "c", "size", "raw").toArrow().combine_chunks().to_batches()]
    total = []
    for most in (1 << 31, 1):
        monkeypatch.setattr(S, "COUNTED", most)
        parts = [b for b in S._count_contexts(sizes, frames[0])]
        sums = {}
        for b in parts:
            for k, piece, v in zip(*(b.column(c).to_pylist() for c in ("k", "piece", "v")), strict=True):
                sums[k, piece] = sums.get((k, piece), 0) + np.frombuffer(S.opened(v), np.int32).astype(np.int64)
        total.append((len(parts), sums))
    assert len(whole) == 60 and total[1][0] > total[0][0]
    assert total[0][1].keys() == total[1][1].keys() and all((total[0][1][x] == total[1][1][x]).all() for x in total[0][1])

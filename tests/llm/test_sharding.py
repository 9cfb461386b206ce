"""Shards of indivisible groups: balance against plain differencing, slots, awkward rows."""

import heapq
import random
import zlib

import pytest

from driftgauge.llm import sharding
from driftgauge.session import ship


def plain(sizes, k):
    """Sums of textbook differencing over whole tuples."""
    heap = [(-x, i, [x] + [0] * (k - 1)) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        v = [x + y for x, y in zip(sorted(a), sorted(b, reverse=True), strict=True)]
        n += 1
        heapq.heappush(heap, (min(v) - max(v), n, v))
    return sorted(heap[0][2])


def test_differencing_is_the_textbook_one():
    rng = random.Random(1)
    for _ in range(60):
        k, sizes = rng.randrange(2, 9), sorted({rng.randrange(1, 10**6) for _ in range(rng.randrange(1, 60))}, reverse=True)
        sums, places = sharding.difference([[float(x)] for x in sizes], [False] * len(sizes), [0] * k)
        own = [0] * k
        for x, p in zip(sizes, places, strict=True):
            own[p[0]] += x
        assert own == sums
        assert max(sums) - min(sums) <= max(plain(sizes, k)) - min(plain(sizes, k)) + max(sizes) * 0.05


def test_differencing_beats_greedy():
    rng, won = random.Random(4), 0
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 10**6) for _ in range(200)), reverse=True)
        sums, _ = sharding.difference([[float(x)] for x in sizes], [False] * 200, [0] * 8)
        greedy = [0] * 8
        for x in sizes:
            heapq.heapreplace(greedy, greedy[0] + x)
        won += max(sums) - min(sums) < max(greedy) - min(greedy)
    assert won >= 28


def test_fixed_places_move_within_their_class():
    rng = random.Random(2)
    for _ in range(40):
        classes = [rng.randrange(3) for _ in range(6)]
        vectors = [[rng.random() for _ in range(6)] for _ in range(5)]
        sums, places = sharding.difference(vectors, [True] * 5, classes)
        own = [0.0] * 6
        for v, p in zip(vectors, places, strict=True):
            assert sorted(p) == list(range(6)) and all(classes[i] == classes[p[i]] for i in range(6))
            for i, x in enumerate(v):
                own[p[i]] += x
        assert own == pytest.approx(sums)


def test_level():
    assert sharding.filled([10.0, 0.0, 1.0], 7.0) == [4.0, 0.0, 1.0]
    assert sharding.filled([1.0, 2.0], 100.0) == [1.0, 2.0]


@pytest.mark.parametrize(("per", "fan"), [(1 << 14, 4096), (20, 3)])
def test_assign(spark, per, fan):
    ship(spark)
    rng = random.Random(3)
    texts = ["x" * rng.randrange(1, 400) + str(i) for i in range(500)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(1000 + i, "a hot text " * 9, 0) for i in range(300)] + [(5000, None, 0), (5001, "", 0), (None, "null id", 0), (None, "null id", 0), (7, texts[7], 0), (6000, "é" * 90, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int")
    got = sharding.assign(df, 8, per=per, fan=fan).collect()
    assert sorted(((r.doc_id, r.text_crc32, r["size"]) for r in got), key=str) == sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in rows), key=str)
    shard, sums, slots = {}, [0] * 8, {}
    for r in got:
        assert shard.setdefault(r.text_crc32, r.shard) == r.shard
        sums[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = 300 * (99 + 16)
    rest = sorted(sums)[:-1]
    assert max(sums) == hot and max(rest) - min(rest) <= (64 if per > 1000 else 600)
    assert sharding.assign(df.where("false")).count() == 0


def test_same_rows_on_any_cluster(spark, sf):
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs, per=30, fan=2).collect()}
    assert one == {(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs.repartition(37), per=30, fan=2).collect()}


def test_repeated_rows_are_numbered_in_blocks(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(sharding, "BLOCK", 10)
    df = spark.createDataFrame([(1, "same")] * 95 + [(2, "other")] * 3, "doc_id long, text string")
    got = sharding.assign(df, 2).collect()
    assert sorted((r.shard, r.slot) for r in got if r.doc_id == 1)[-1][1] == 94 and len(got) == 98


def test_write(spark, tmp_path):
    ship(spark)
    df = spark.createDataFrame([(i, f"text {i % 7}", i) for i in range(50)], "doc_id long, text string, shard int")
    sharding.write(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {"doc_id", "text", "shard_", "shard"} == set(back.columns)
    assert back.groupBy("text").agg({"shard": "max"}).count() == 7 and back.select("text", "shard").distinct().count() == 7

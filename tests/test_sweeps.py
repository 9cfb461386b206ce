"""Directives: sweeps against all pairs, and time in proportion to their number."""

import random
import time

from pyspark.sql import functions as F

from driftgauge.operators import findings as G
from driftgauge.plans.scan import scan_frame
from driftgauge.pyparse.extract import extract, narrowest
from driftgauge.session import ship
from driftgauge.sources.config import Config


def test_narrowest_against_all_pairs():
    rng = random.Random(1)
    for _ in range(300):
        regions = [{"sl": a, "sc": rng.randrange(3), "el": a + rng.randrange(4), "ec": rng.randrange(9)} for a in (rng.randrange(20) for _ in range(rng.randrange(25)))]
        lines = sorted(rng.randrange(24) for _ in range(12))
        key = lambda r: (r["el"] - r["sl"], r["sl"], r["sc"], r["el"], r["ec"])
        assert narrowest(lines, regions) == [min((r for r in regions if r["sl"] <= x <= r["el"]), key=key, default=None) for x in lines]


def test_owners_against_all_pairs(spark):
    ship(spark)
    rng = random.Random(2)
    spot = lambda: (rng.randrange(12), rng.randrange(4))
    span = lambda: (lambda a, b: (*min(a, b), *max(a, b)))(spot(), spot())
    for n in (0, 1, 400):
        intervals = list({(rng.choice("pq"), rng.choice("rs"), *span()): str(i) for i in range(n)}.items())
        places = [(rng.choice("pqx"), rng.choice("rs"), *span()) for _ in range(600)]
        d = spark.createDataFrame([(*k, v) for k, v in intervals], "path string, rule_id string, sl int, sc int, el int, ec int, reason string")
        f = spark.createDataFrame(places, "path string, rule_id string, sl int, sc int, el int, ec int")
        got = {tuple(r)[:6]: (tuple(r.owner)[:4], r.owner.reason) for r in G.owners(f, d).collect()}
        want = {}
        for p in set(places):
            around = [(k[2:], v) for k, v in intervals if k[:2] == p[:2] and k[2:4] <= p[2:4] and p[4:] <= k[4:]]
            if around:
                want[p] = max(around)
        assert got == want


def source(n):
    return "".join(f"import cgi  # driftgauge: ignore[CPY0001] -- line {i}\n" for i in range(n))


def test_extraction_is_linear():
    took = {}
    for n in (3_000, 30_000):
        text = source(n)
        began = time.perf_counter()
        got = extract("a.py", text, (11, 12, 13))
        took[n] = time.perf_counter() - began
        assert len(got["directives"]) == n and got["directives"][n // 2]["statement"]["sl"] == n // 2 + 1
    assert took[30_000] < 20 * took[3_000]


def test_many_directives_and_findings(spark):
    n = 30_000
    files = spark.createDataFrame([("legacy.py", source(n)), ("b.py", "import cgi\n")], "path string, source string")
    s = scan_frame(spark, files, config=Config(baseline=11, horizon=13))
    got = s.findings.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.expr("suppression.kind = 'inline' and suppression.reason = concat('line ', sl - 1)")).alias("m")).collect()
    assert {r.path: (r.n, r.m) for r in got} == {"legacy.py": (n, n), "b.py": (1, 0)}

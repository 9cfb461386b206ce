"""Sets of versions as bits, held against lists, folds and evaluation version by version."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from driftgauge.functions import exprs as E
from driftgauge.operators import match as M
from driftgauge.pyparse import extract as X

EVENTS = "array<struct<py:int,impact:string>>"


def test_runs_and_members(spark):
    rng = random.Random(3)
    sets = [set(), {0}, {62}, set(range(63)), {0, 62}, set(range(0, 63, 2))] + [{v for v in range(63) if rng.random() < p} for p in (0.05, 0.3, 0.5, 0.9) for _ in range(50)]
    df = spark.createDataFrame([(sorted(s), E.held(s)) for s in sets], "vs array<int>, bits long")
    points = F.expr("transform(vs, v -> named_struct('v', v, 'state', 's'))")
    got = df.withColumn("points", points).select("vs", F.expr(E.members("bits")).alias("members"), F.expr(E.runs("bits")).alias("runs"), E.ranges("points").alias("ranges"), F.expr(E.lowest("bits")).alias("least")).collect()
    for r in got:
        assert r.members == r.vs and [(x["from"], x["through"]) for x in r.runs] == [(x["from"], x["through"]) for x in r.ranges]
        assert not r.vs or r.least == r.vs[0]


def test_states_are_those_of_the_fold(spark):
    rng = random.Random(5)
    versions = [10, 11, 12, 14, 15, 16]
    rows = []
    for _ in range(300):
        events = [(py, rng.choice(E.IMPACTS)) for py in sorted(rng.sample(range(8, 18), rng.randrange(4)))]
        rows.append((events, [v for v in range(9, 18) if rng.random() < 0.6]))
    df = spark.createDataFrame([(e, r, E.held(r)) for e, r in rows], f"events {EVENTS}, vs array<int>, bits long")
    df = df.withColumn("reachable", F.array_sort(F.array_intersect("vs", F.array(*map(F.lit, versions))))).withColumn("points", E.states("events", "reachable"))
    df = df.withColumn("phases", E.phases("events", versions)).withColumn("held", E.within("phases", "bits"))
    for r in df.select("points", E.ranges("points").alias("want"), E.spans("held").alias("got"), "held").collect():
        assert [tuple(x) for x in r.got] == [tuple(x) for x in r.want]
        worst = min((p.state for p in r.points), key=E.IMPACTS.index, default=None)
        assert (r.held[0].state if r.held else None) == worst


def test_too_wide():
    assert E.held([]) == 0 and E.held([0, 3, 3]) == 9
    with pytest.raises(ValueError):
        E.held([63])


def _plain(node: ast.AST, v: int):
    """The truth of a guard at one version, by the tables of three values."""
    if isinstance(node, ast.UnaryOp):
        return X.t_not(_plain(node.operand, v))
    if isinstance(node, ast.BoolOp):
        out = _plain(node.values[0], v)
        for x in node.values[1:]:
            out = (X.t_and if isinstance(node.op, ast.And) else X.t_or)(out, _plain(x, v))
        return out
    if isinstance(node, ast.Compare):
        op, bound = type(node.ops[0]), ast.literal_eval(node.comparators[0])
        return {ast.Lt: (3, v, 0) < bound, ast.GtE: (3, v, 0) >= bound, ast.NotEq: (3, v, 0) != bound}[op]
    return None


def test_guards_are_those_of_each_version():
    rng = random.Random(7)

    def guard(depth):
        kind = rng.randrange(5) if depth else rng.randrange(2)
        if kind == 0:
            return "unknown"
        if kind == 1:
            return f"sys.version_info {rng.choice(['<', '>=', '!='])} (3, {rng.randrange(9, 18)})"
        if kind == 2:
            return f"not ({guard(depth - 1)})"
        return "(" + rng.choice([" and ", " or "]).join(guard(depth - 1) for _ in range(rng.randrange(2, 4))) + ")"

    window = tuple(range(10, 17))
    for _ in range(300):
        text = guard(3)
        got = X.extract("m.py", f"import sys\nif {text}:\n    import yes\nelse:\n    import no\n", window)["imports"]
        truth = {v: _plain(ast.parse(text, mode="eval").body, v) for v in window}
        assert got[1]["reach"] == [v for v in window if truth[v] is not False] and got[2]["reach"] == [v for v in window if truth[v] is not True], text


def test_facts_hold_bits(spark):
    files = spark.createDataFrame([("m.py", "import sys\nif sys.version_info >= (3, 13, 1):\n    import a\nif sys.version_info >= (3, 12):\n    import b\n")], "path string, source string")
    row = M.parse(files, (11, 12, 13)).first()
    assert [f.reach for f in row.facts if f.use == "i"] == [E.held([11, 12, 13])] * 2 + [E.held([12, 13])]
    assert [p.active for p in row.patches] == [E.held([11, 12, 13])]

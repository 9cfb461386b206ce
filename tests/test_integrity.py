"""Violations of coverage manifests: of null keys and rules, and in tasks whose number follows from the entries."""

from driftgauge.operators import integrity as N

ENTRIES = "source string, source_key string, disposition string, rules array<string>, note string"


def test_nulls_equal_none(spark):
    entries = spark.createDataFrame([(None, "a", "implemented", ["R1"], "x"), ("s", None, "implemented", ["R1", None], "x"), ("s", "b", "implemented", ["R1", "R1"], "x"), ("s", "b", "implemented", ["R8"], "x")], ENTRIES)
    keys = spark.createDataFrame([(None, "a"), ("s", None), ("s", "b"), ("s", "b"), ("s", "c")], "source string, source_key string")
    rules = spark.createDataFrame([("R1",), ("R1",), ("R2",)], "rule_id string")
    got = sorted(map(tuple, N.violations(entries, keys, rules).collect()), key=str)
    want = [
        (None, "a", None, "is not classified"), (None, "a", None, "is not among the source keys"), ("s", None, None, "is not classified"), ("s", None, None, "is not among the source keys"),
        ("s", "c", None, "is not classified"), ("s", "b", None, "is classified more than once"), ("s", None, None, "names an unknown rule"), ("s", "b", "R8", "names an unknown rule"),
        ("s", "b", "R1", "names a rule more than once"), (None, None, "R2", "no source covers it"),
    ]
    assert got == sorted(want, key=str)


def test_tasks_follow_from_the_entries(spark, monkeypatch):
    """Whatever the session's number of shuffle partitions is."""
    monkeypatch.setattr(N, "TASK_ROWS", 500, raising=False)
    entries = spark.range(9_000).selectExpr("cast(id % 7 as string) as source", "cast(id as string) as source_key", "'implemented' as disposition", "array('R1', 'R1') as rules", "'x' as note")
    got = N.violations(entries, entries.select("source", "source_key"), spark.createDataFrame([("R1",)], "rule_id string")).where("problem = 'names a rule more than once'")
    parts = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(parts) == 9_000 and len(parts) >= 18 and max(parts) < 1_000

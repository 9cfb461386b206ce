"""Files are dealt to tasks by their number and size, and equal sources are parsed once, with the rows of each alone."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from driftgauge import queries as Q
from driftgauge.operators import match as M
from driftgauge.plans.corpus import TEMPLATES
from driftgauge.plans.scan import scan_frame
from driftgauge.pyparse import extract as X
from driftgauge.session import ship
from driftgauge.sources.config import Config

MANY = 3 * M.TASK_FILES


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_scan_of_one_partition_parses_in_many_tasks(spark):
    files = Q.corpus(spark.range(MANY).coalesce(1).withColumnRenamed("id", "k"), "k")
    for cached in (True, False):
        s = scan_frame(spark, files, config=Config(baseline=11, horizon=13), cached=cached)
        got = sizes(s.parsed.select("path"))
        assert sum(got) == MANY and len(got) >= 3 and max(got) <= 2 * M.TASK_FILES
        s.parsed.unpersist()


def test_few_large_files_are_dealt_and_few_small_ones_stay(spark):
    df = spark.range(6).coalesce(1).select(F.col("id").cast("string").alias("path"), F.expr(f"repeat('x', {M.TASK_BYTES // 2})").alias("source"))
    assert M.spread(df, F.octet_length("source")).rdd.getNumPartitions() >= 3
    assert M.spread(df).rdd.getNumPartitions() == 1
    assert M.spread(df.where("false"), F.octet_length("source")).count() == 0


def test_copies_are_parsed_as_each_alone(spark):
    ship(spark)
    sources = [*TEMPLATES, None, "", "import cgi, uu  # driftgauge: ignore[CPY0001]\n"]
    rows = [(None if i % 50 == 7 else f"p/m{i}.py" + "i" * (i % 5 == 0), sources[i * 7 % len(sources)]) for i in range(700)]
    got = M.parse(spark.createDataFrame(rows, "path string, source string").coalesce(1), (11, 12, 13)).collect()
    each = [M.parse(spark.createDataFrame([r for r in rows if r[0] == p][:1], "path string, source string"), (11, 12, 13)).first() for p in ("p/m0.pyi", "p/m8.py", "p/m16.py")]
    assert len(got) == len(rows) and Counter(r.path for r in got) == Counter(p for p, _ in rows)
    assert all(next(r for r in got if r.path == x.path) == x for x in each)
    want = Counter((p, len(f["facts"]), f["status"], len(f["directives"]), len(f["diagnostics"])) for p, s in rows for f in [M.flat(X.extract(p, s or "", (11, 12, 13), packed=True))])
    assert Counter((r.path, len(r.facts), r.status, len(r.directives), len(r.diagnostics)) for r in got) == want


def test_a_run_of_files_is_bounded():
    names, sources = [f"m{i}.py" for i in range(1_000)], [f"x = {i}\n" for i in range(250)] * 4
    runs = list(M.groups(names, sources))
    assert [a for a, _ in runs[1:]] == [b for _, b in runs[:-1]] and runs[0][0] == 0 and runs[-1][1] == 1_000
    assert all(len(set(sources[a:b])) <= M.STEP for a, b in runs)
    large = ["y" * (M.BYTES // 2)] * 5
    assert [b - a for a, b in M.groups(names[:5], large)] == [2, 2, 1]
    assert list(M.groups([], [])) == [] and list(M.groups(["m"], ["z" * (2 * M.BYTES)])) == [(0, 1)]


def test_equal_sources_are_parsed_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(X, "extract", lambda *a, _f=X.extract, **k: calls.append(a) or _f(*a, **k))

    class Files:  # what parse() does to a frame
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"path": [f"m{i}.py" for i in range(900)], "source": [TEMPLATES[i % 3] for i in range(900)]})
            return list(run(iter([batch])))

    out = M.parse(Files(), (11, 12, 13))
    assert sum(b.num_rows for b in out) == 900 and len(calls) == 3


def test_guard_truth_of_many_events(spark, tmp_path):
    """In many tasks, without an exchange behind the parser, and with rows for each event where ids repeat, as the SQL has it."""
    ship(spark)
    spark.range(MANY).union(spark.range(3)).coalesce(1).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = Q.guard_truth(spark, str(tmp_path))
    assert len(sizes(got)) >= 3
    assert got.count() == 3 * (MANY + 3) and got.where("event_id = 1").count() == 6

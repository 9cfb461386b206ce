"""Findings that come and go as files change."""

from driftgauge.sources.config import Config
from driftgauge.streaming.changes import follow


def test_new_and_resolved(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    seen = set()

    def arrive(*rows):
        spark.createDataFrame(list(rows), "path string, source string").coalesce(1).write.mode("append").parquet(src)
        follow(spark, spark.readStream.schema("path string, source string").parquet(src), target, str(tmp_path / "cp"), config=Config(baseline=11, horizon=13))
        now = {(r.step, r.path, r.change, r.subject) for r in spark.read.parquet(f"{target}/changes").collect()}
        fresh = now - seen
        seen.update(now)
        return sorted(fresh)

    assert arrive(("a.py", "import cgi\nimport uu\n"), ("b.py", "import nis\n"), ("c.py", "x = 1\n")) == [(0, "a.py", "new", "cgi"), (0, "a.py", "new", "uu"), (0, "b.py", "new", "nis")]
    assert arrive(("a.py", "\n\nimport cgi\n"), ("c.py", "import imp\n")) == [(1, "a.py", "resolved", "uu"), (1, "c.py", "new", "imp")]
    assert arrive(("b.py", None), ("a.py", "import cgi  # driftgauge: ignore[CPY0001] -- so\nimport uu\n")) == [(2, "a.py", "new", "uu"), (2, "a.py", "resolved", "cgi"), (2, "b.py", "resolved", "nis")]
    assert arrive(("a.py", "import uu\n")) == []
    assert arrive(("b.py", "import nis\n"), ("c.py", "(")) == [(4, "b.py", "new", "nis")]
    assert arrive(("c.py", "x = 1\n")) == [(5, "c.py", "resolved", "imp")]

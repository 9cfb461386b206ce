"""What the driver imports, with and without what may be missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(hidden):
    code = f"import sys\nfor m in {hidden!r}: sys.modules[m] = None\nimport __spark_entry__ as e\nprint('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    return (set(line.split()[1:]) for line in out.splitlines() if line.startswith(("NAMES", "SQL")))


def test_all_there():
    queries, sql = names([])
    assert sql <= queries and {"scan_findings", "asof_state"} <= sql


def test_a_missing_module_takes_only_its_queries():
    every, _ = names([])
    for hidden in ("zstandard", "regex"):
        left, _ = names([hidden])
        assert left <= every and len(every - left) <= 4, every - left


def test_without_the_corpus_operators():
    left, sql = names(["driftgauge.llm", "corpus_pipeline"])
    assert left and not any(n.startswith("op") or n == "pipeline" for n in left | sql)

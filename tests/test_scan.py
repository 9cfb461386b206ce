"""Scans on Spark: matching, merging, ordinals, states, suppression, reports, command line, streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from driftgauge import cli, report
from driftgauge.functions import exprs as E
from driftgauge.operators import findings as G
from driftgauge.plans.scan import scan, scan_frame
from driftgauge.sources import registry as R
from driftgauge.sources.config import Config
from driftgauge.streaming.rescan import rescan

POLICY = dict(baseline=11, horizon=13)


@pytest.fixture(scope="module")
def run(spark):
    def go(sources, modules=None, baseline=None, registry=None, **config):
        files = spark.createDataFrame(list(sources.items()), "path string, source string")
        return scan_frame(spark, files, registry, Config(**{**POLICY, "minimum_confidence": "medium", **config}), modules, baseline)

    return go


def rows(s, *cols):
    return sorted(tuple(r) for r in s.findings.select(*cols).collect())


def test_matchers(run):
    s = run({
        "a.py": "import cgi, cgix\nimport xml.cgi\nfrom distutils.core import setup\n",
        "b.py": "import shutil\nshutil.rmtree('x', onerror=None)\nshutil.rmtree('x', None, None)\nshutil.rmtree(*x)\nshutil.rmtree('x', onerror=1, **k)\n",
        "c.py": "import array\narray.array('u')\narray.array('i')\narray.array(typecode='u')\n",
        "d.py": "import ssl as s\ns.wrap_socket\ndef f(s):\n    return s.wrap_socket\n",
        "e.py": "__import__('uu')\n~True\n",
        "f.py": "if a:\n    from locale import format\nelse:\n    from other import format\nformat\n",
    }, horizon=16)
    got = rows(s, "path", "sl", "rule_id", "confidence")
    assert got == [
        ("a.py", 1, "CPY0001", "high"), ("a.py", 3, "CPY0023", "high"),
        ("b.py", 2, "CPY0094", "high"), ("b.py", 3, "CPY0094", "high"), ("b.py", 5, "CPY0094", "high"),
        ("c.py", 2, "CPY0097", "high"),
        ("d.py", 2, "CPY0026", "high"),
        ("e.py", 1, "CPY0021", "medium"), ("e.py", 2, "CPY0061", "high"),
        ("f.py", 5, "CPY0066", "medium"),
    ]


def test_further_names_of_a_rule(run):
    s = run({
        "a.py": "from urllib import parse\nparse.splitattr\nparse.splithost\nparse.splitquery\nparse.to_bytes\n",
        "b.py": "import ssl\nssl.OP_NO_TLSv1\nssl.OP_NO_TLSv1_1\nssl.PROTOCOL_TLSv1_2\n",
        "c.py": "import sre_parse\n",
        "d.py": "from pathlib import Path\nPath.relative_to(a, b)\nPath.relative_to(a, b, c)\n",
    }, horizon=16)
    assert rows(s, "path", "sl", "rule_id") == [
        ("a.py", 2, "CPY0127"), ("a.py", 3, "CPY0127"), ("a.py", 4, "CPY0127"), ("a.py", 5, "CPY0127"),
        ("b.py", 2, "CPY0121"), ("b.py", 3, "CPY0121"), ("b.py", 4, "CPY0122"),
        ("c.py", 1, "CPY0117"),
        ("d.py", 3, "CPY0047"),
    ]


def test_local_modules_withhold(run):
    s = run({"a.py": "import cgi\nimport uu\nimport importlib\nimportlib.import_module('cgi')\n"}, modules={"cgi": ["cgi.py"]})
    assert [r[2] for r in rows(s, "path", "sl", "rule_id")] == ["CPY0021"]
    assert sorted((r.code, r.sl) for r in s.inferences.collect()) == [("PYA2001", 1), ("PYA2001", 4)]
    every = run({"a.py": "import cgi\nimport uu\n"}, modules={"*": ["src"]})
    assert every.findings.count() == 0 and every.inferences.count() == 2


def test_strongest_match_merges(run, spark):
    m = R.Matcher
    rule = R.Rule("CPY9001", "t", "function", "a.b", ("runtime",), (("removed", 12, "released", "s", "breaking"),), (m("qualified-reference", "a.b"), m("qualified-call", "a.b"), m("call-shape", "a.b", min_pos=1)), "go")
    reg = R.Registry((rule,), ((11, "stable", None), (13, "stable", None)), "1", "0" * 64)
    s = run({"x.py": "import a\na.b(1)\na.b()\n"}, registry=reg)
    got = s.findings.orderBy("sl").collect()
    assert [(r.kind, r.ordinal) for r in got] == [("call-shape", 0), ("qualified-call", 1)]
    assert got[0].evidence["reference_context"] == ["read"] and got[0].evidence["positional_count"] == ["1"]


def test_fingerprints_do_not_move_with_filters(run):
    src = {"a.py": "import sys\nif sys.version_info < (3, 0):\n    import cgi\nimport cgi\n"}
    r = run(src).findings.collect()
    assert len(r) == 1 and r[0].ordinal == 1
    want = hashlib.sha256("\0".join([E.NAMESPACE, "CPY0001", "a.py", "<module>", "cgi", "1"]).encode()).hexdigest()
    assert r[0].fingerprint == want
    moved = run({"a.py": "\n\n" + src["a.py"]}).findings.collect()
    assert moved[0].fingerprint == want


def test_states_split_at_gaps(spark):
    df = spark.sql("select array(named_struct('py', 11, 'impact', 'deprecated'), named_struct('py', 13, 'impact', 'breaking')) as events, array(15, 10, 11, 13, 14) as reach")
    got = df.withColumn("pts", E.states("events", "reach")).select(E.ranges("pts").alias("r")).first().r
    assert [(x["from"], x["through"], x["state"]) for x in got] == [(11, 11, "deprecated"), (13, 15, "breaking")]
    got = df.withColumn("reach", F.array(F.lit(11), F.lit(13), F.lit(15))).withColumn("pts", E.states("events", "reach")).select(E.ranges("pts").alias("r")).first().r
    assert [(x["from"], x["through"]) for x in got] == [(11, 11), (13, 13), (15, 15)]


def test_suppression(run):
    s = run({
        "a.py": "import cgi  # driftgauge: ignore[CPY0001] -- why\nimport uu\nimport nis  # driftgauge: ignore[CPY9999]\n",
        "b.py": "x = [\n  1,  # driftgauge: ignore[CPY0061]\n  ~True,\n]\n~True\n",
        "gen/c.py": "import cgi\n",
    }, per_file_ignores={"gen/**": ["CPY0001", "NOPE"]}, horizon=16)
    got = {(r.path, r.sl, r.rule_id): r.suppression for r in s.findings.collect()}
    assert got["a.py", 1, "CPY0001"].reason == "why" and got["a.py", 2, "CPY0021"] is None and got["a.py", 3, "CPY0012"] is None
    assert got["b.py", 3, "CPY0061"].kind == "inline" and got["b.py", 5, "CPY0061"] is None
    assert got["gen/c.py", 1, "CPY0001"].pattern == "gen/**"
    assert sorted(r.code for r in s.diagnostics.collect()) == ["PYA3001", "PYA3001"]
    x = s.summary().first()
    assert x.suppressed == 3 and x.gate_failed and x.exit_code == 1


def test_gates_and_baseline(run):
    src = {"a.py": "import cgi\nimport uu\n", "b.py": "import shutil\nshutil.rmtree(x, onerror=y)\n"}
    first = run(src)
    known = [r.fingerprint for r in first.findings.where("rule_id = 'CPY0001'").collect()]
    s = run(src, baseline=known, fail_new_only=True)
    assert rows(s, "rule_id", "baseline_status") == [("CPY0001", "existing"), ("CPY0021", "new"), ("CPY0094", "new")]
    assert s.summary().first().gate_failed
    every = [r.fingerprint for r in first.findings.collect()]
    assert not run(src, baseline=every, fail_new_only=True).summary().first().gate_failed
    only = {"b.py": src["b.py"]}
    assert [run(only, fail_on=f).summary().first().exit_code for f in ("never", "breaking", "risk", "deprecated", "any")] == [0, 0, 0, 1, 1]
    assert run({**only, "c.py": "("}).summary().first().exit_code == 3
    assert run({**only, "c.py": "("}, allow_incomplete=True).summary().first().exit_code == 0
    assert run(only, show_unscheduled=False).findings.count() == 0


def test_order(run):
    s = run({"a/b.py": "import imp\n", "a-b.py": "import imp\nimport cgi\n", "z.py": "import shutil\nshutil.rmtree(x, onerror=y)\n"})
    assert [(r.action_version, r.impact, r.path) for r in G.ordered(s.findings).collect()] == [(12, "breaking", "a/b.py"), (12, "breaking", "a-b.py"), (12, "deprecated", "z.py"), (13, "breaking", "a-b.py")]


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([("a.py", None), ("b.py", "")], "path string, source string")
    s = scan_frame(spark, files, config=Config(**POLICY))
    assert s.findings.count() == 0 and s.summary().first().exit_code == 0
    assert scan_frame(spark, files.where("false"), config=Config(**POLICY)).findings.count() == 0


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "legacy.py").write_text("import cgi\n")
    (tmp_path / "ok.py").write_text("x = 1\n")
    return tmp_path


def test_reports(spark, tree):
    s = scan(spark, str(tree), baseline="3.11", horizon="3.13")
    parts = report.collect(s)
    text = report.text(s, parts)
    assert "Python 3.13 — 1 upgrade blocker" in text and "CPY0001  legacy.py:1:1  cgi (breaking; high confidence)" in text
    assert "States: deprecated on 3.11 through 3.12; breaking on 3.13" in text
    assert text.endswith("Result: 1 finding (1 breaking); 2 files analyzed; 0 files incomplete.\n")
    doc = json.loads(report.dumps(report.document(s, parts)))
    f = doc["findings"][0]
    assert f["location"]["region"] == {"start": {"line": 1, "column": 1}, "end": {"line": 1, "column": 11}}
    assert f["match"]["evidence"] == {"bound_names": ["cgi"], "imported_module": "cgi", "resolution": "no-competing-project-module", "source_roots": [".", "src"], "syntax": "import"}
    assert f["states"] == [{"from": "3.11", "through": "3.12", "state": "deprecated"}, {"from": "3.13", "through": "3.13", "state": "breaking"}] and doc["gate"]["failed"]
    sarif = report.sarif(s, parts)
    assert sarif["runs"][0]["results"][0]["level"] == "error" and sarif["runs"][0]["tool"]["driver"]["semanticVersion"] == "0.1.0-alpha.1"
    assert report.dumps(report.document(s)) == report.dumps(report.document(scan(spark, str(tree), baseline="3.11", horizon="3.13")))


def test_command_line(spark, tree, capsys):
    args = ["check", "--root", str(tree), "--baseline-python", "3.11", "--horizon-python", "3.13"]
    assert cli.main([*args, "--quiet"], spark) == 1
    assert capsys.readouterr().out == "Result: 1 finding (1 breaking); 2 files analyzed; 0 files incomplete.\n"
    base = str(tree / "base.json")
    assert cli.main(["baseline", "create", *args[1:], "--output", base], spark) == 0
    assert cli.main([*args, "--baseline-file", base, "--fail-new-only", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["findings"][0]["baseline_status"] == "existing"
    assert cli.main([*args, "--fail-new-only"], spark) == 2 and cli.main(["check", "--root", str(tree / "none")], spark) == 2
    assert cli.main(["explain", "CPY0001"]) == 0 and "module-import cgi" in capsys.readouterr().out
    assert cli.main(["explain", "NOPE"]) == 2 and cli.main(["registry", "validate"]) == 0 and cli.main(["registry", "list"]) == 0 and cli.main(["version"]) == 0


def test_stream_reports_each_finding_once(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows_):
        spark.createDataFrame(rows_, "path string, source string").coalesce(1).write.mode("append").parquet(src)
        rescan(spark, spark.readStream.schema("path string, source string").parquet(src), target, str(tmp_path / "cp"), config=Config(**POLICY)).awaitTermination()

    arrive([("a.py", "import cgi\n")])
    arrive([("a.py", "\nimport cgi\n"), ("b.py", "import uu\n")])
    assert sorted((r.path, r.batch) for r in spark.read.parquet(target).select("path", "batch").collect()) == [("a.py", 0), ("b.py", 1)]


def test_plan_has_no_wide_python(run):
    s = run({"a.py": "import cgi\n"})
    plan = s.findings._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "BroadcastHashJoin" in plan

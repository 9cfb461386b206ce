"""Reports streamed from partitions: the same bytes as the small form."""

import json

import pytest

from driftgauge import cli, report
from driftgauge.plans.scan import scan

SOURCES = {
    "a/legacy.py": "import cgi\nimport uu  # driftgauge: ignore[CPY0021] -- kept: “so”\nimport nis\n", "a-b.py": "import imp, asyncore\nx = ~True\n", "é.py": "import telnetlib\n", "bad.py": "(",
    "q.py": "import shutil\nshutil.rmtree(x, onerror=y)  # driftgauge: ignore[NOPE]\n", "nis.py": "import sys\nif sys.version_info >= (3, 12, 1):\n    import imp\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_same_bytes(spark, tree, monkeypatch):
    monkeypatch.setattr(report, "CHUNK", 300)
    for more in ({}, {"show_suppressed": True, "minimum_confidence": "medium"}):
        s = scan(spark, str(tree), baseline="3.11", horizon="3.16", **more)
        p = report.collect(s)
        assert len(p["findings"]) > 4 and p["diagnostics"] and p["inferences"]
        small = {"text": report.text(s, p), "json": report.dumps(report.document(s, p)), "sarif": report.dumps(report.sarif(s, p)), "baseline": report.dumps(report.baseline(s))}
        for kind, want in small.items():
            assert b"".join(report.parts(s, kind)).decode() == want, kind
        doc, sarif = json.loads(small["json"]), json.loads(small["sarif"])["runs"][0]
        assert [r["ruleId"] for r in sarif["results"]] == [f["rule_id"] for f in doc["findings"]] and all(sarif["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in sarif["results"])
        notes = sarif["invocations"][0]["toolExecutionNotifications"]
        assert len(notes) == len(doc["diagnostics"]) + len(doc["inferences"]) and all(sarif["tool"]["driver"]["notifications"][n["descriptor"]["index"]]["id"] == n["descriptor"]["id"] for n in notes)
        assert ("suppressed inline" in small["text"]) == bool(more) and "Evidence: guard_granularity=patch" in small["text"]
        s.release()


def test_nothing_found(spark, tmp_path):
    (tmp_path / "ok.py").write_text("x = 1\n")
    s = scan(spark, str(tmp_path), baseline="3.11", horizon="3.13")
    p = report.collect(s)
    for kind, want in (("text", report.text(s, p)), ("json", report.dumps(report.document(s, p))), ("sarif", report.dumps(report.sarif(s, p))), ("baseline", report.dumps(report.baseline(s)))):
        assert b"".join(report.parts(s, kind)).decode() == want
    assert "not proof" in report.text(s, p) and json.loads(report.dumps(report.baseline(s)))["findings"] == []


def test_output_is_bounded_by_the_root(spark, tree, tmp_path_factory, capsys):
    args = ["check", "--root", str(tree), "--baseline-python", "3.11", "--horizon-python", "3.13", "--format", "json", "--output"]
    assert cli.main([*args, str(tree / "r.json")], spark) == 3 and json.loads((tree / "r.json").read_text())["findings"]
    assert cli.main([*args, str(tmp_path_factory.mktemp("out") / "r.json")], spark) == 2 and "beneath the root" in capsys.readouterr().err

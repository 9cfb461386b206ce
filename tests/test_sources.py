"""Registry, discovery, configuration, baselines."""

import json
import os

import pytest

from driftgauge.sources import config as C
from driftgauge.sources import discovery as D
from driftgauge.sources import registry as R

RULE = """schema_version: 1
id: CPY9001
title: "t"
summary: "s"
scope: {ecosystem: python, runtime: cpython, contexts: [runtime]}
subject: {kind: module, name: old}
timeline:
  - {event: deprecated, python: "3.11", certainty: released, source: s}
  - {event: removed, python: "3.13", certainty: released, source: s}
impact: {on_deprecation: deprecated, on_removal: breaking}
matchers:
  - {kind: module-import, module: old}
  - {kind: call-shape, qualified_name: a.b, min_positional_args: 1, literal_arguments: [{position: 0, equals: null}]}
remediation: {summary: "go"}
sources: [{id: s, title: S, url: "https://example.org"}]
tags: [stdlib]
aliases: [OLD]
"""


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def registry_at(root, rule=RULE):
    (root / "index.yaml").write_text('schema_version: 1\nrelease: "1"\nreleases: r.yaml\nrules: [a.yaml]\n')
    (root / "r.yaml").write_text('schema_version: 1\nreleases:\n  - {python: "3.11", status: stable}\n  - {python: "3.13", status: planned}\n')
    (root / "a.yaml").write_text(rule)
    return str(root)


def test_bundled_registry():
    r = R.load()
    assert len(r.rules) == 133 and r.window == tuple(range(11, 17)) and r.horizon == 15 and r.find("CPY0001").subject == "cgi"
    assert R.load().revision == r.revision


def test_bundled_matchers():
    import collections

    kinds = collections.Counter(m.kind for r in R.bundled().rules for m in r.matchers)
    assert kinds == {"qualified-reference": 283, "call-shape": 109, "module-import": 30, "literal-dynamic-import": 30, "builtin-pattern": 1, "qualified-call": 1}


def test_registry_directory(tmp_path):
    r = R.load(registry_at(tmp_path))
    assert r.find("OLD").id == "CPY9001" and r.rules[0].matchers[1].literals == ((0, None, "null", "None"),) and r.horizon == 11


CLOSED = [
    RULE + "more: 1\n",
    RULE.replace("kind: module-import", "kind: module-export"),
    RULE.replace("module: old}\n  - {kind: call", "module: old, pattern: x}\n  - {kind: call"),
    RULE.replace("min_positional_args: 1", "min_positional_args: -1"),
    RULE.replace("min_positional_args: 1", "min_positional_args: 2, max_positional_args: 1"),
    RULE.replace("{position: 0, equals: null}", "{position: 0, keyword: k, equals: null}"),
    RULE.replace("on_removal: breaking", "on_removal: fatal"),
    RULE.replace(", on_removal: breaking", ""),
    RULE.replace("certainty: released", "certainty: sure"),
    RULE.replace("https://example.org", "http://example.org"),
    RULE.replace("contexts: [runtime]", "contexts: []"),
    RULE.replace("id: CPY9001", "id: cpy1"),
    RULE.replace('title: "t"\n', ""),
]


@pytest.mark.parametrize("bad", [*CLOSED, RULE.replace('"3.13"', '"3.11"'), RULE + "id: X\n", RULE.replace("source: s}", "source: zz}"), RULE.replace('{summary: "go"}', '{summary: *x}'), RULE.replace('"3.11"', '"3.011"')])
def test_bad_registry(tmp_path, bad):
    with pytest.raises(R.RegistryError):
        R.load(registry_at(tmp_path, bad))


COVERAGE = """schema_version: 1
source: {id: s, title: S, url: "https://example.org", checked_on: "2026-01-01"}
source_keys: [one, two]
entries:
  - {source_key: one, disposition: implemented, rules: [CPY9001]}
  - {source_key: two, disposition: not-applicable, note: "no"}
"""


@pytest.mark.parametrize("text,says", [
    (COVERAGE, None),
    (COVERAGE.replace("[one, two]", "[one, two, three]"), "three is not classified"),
    (COVERAGE.replace("[one, two]", "[one]"), "two is not among"),
    (COVERAGE.replace("CPY9001", "CPY9009"), "unknown rule CPY9009"),
    (COVERAGE.replace("implemented, rules: [CPY9001]", "duplicate"), "no source covers"),
    (COVERAGE.replace("not-applicable", "unknown"), "must be one of"),
])
def test_coverage(tmp_path, text, says):
    from driftgauge.cli import coverage

    registry_at(tmp_path)
    (tmp_path / "index.yaml").write_text('schema_version: 1\nrelease: "1"\nreleases: r.yaml\nrules: [a.yaml]\ncoverage: [c.yaml]\n')
    (tmp_path / "c.yaml").write_text(text)
    if says:
        with pytest.raises(R.RegistryError, match=says):
            R.load(str(tmp_path))
    else:
        shown = coverage(R.load(str(tmp_path)))
        assert "implemented: 1" in shown and "partial: 0" in shown and "covered rules: 1" in shown


def test_any_field_changes_the_revision(tmp_path):
    def revision(rule=RULE, text=COVERAGE, index=""):
        registry_at(tmp_path, rule)
        (tmp_path / "index.yaml").write_text('schema_version: 1\nrelease: "1"\nreleases: r.yaml\nrules: [a.yaml]\ncoverage: [c.yaml]\n')
        (tmp_path / "c.yaml").write_text(text)
        return R.load(str(tmp_path)).revision

    changes = [("old}", "older}"), ('"t"', '"u"'), ("kind: module, name", "kind: function, name"), ("released", "scheduled"), ("[runtime]", "[typing]"), ("[stdlib]", "[other]"), ("[OLD]", "[ELD]"), ("min_positional_args: 1", "min_positional_args: 2"), ('"go"', '"stay"'), ("on_deprecation: deprecated", "on_deprecation: risk")]
    seen = [revision(), revision(text=COVERAGE.replace('"no"', '"yes"')), revision(text=COVERAGE.replace("title: S", "title: T")), *(revision(RULE.replace(a, b, 1)) for a, b in changes)]
    assert len(set(seen)) == len(seen) and revision() == seen[0]


@pytest.mark.parametrize("bad,says", [
    (COVERAGE.replace("not-applicable, note", "not-applicable, rules: [CPY9001], note"), "may not name rules"), (COVERAGE.replace(', note: "no"', ""), "needs a note"), (COVERAGE.replace("[CPY9001]", "[CPY9001, CPY9001]"), "twice"),
    (COVERAGE.replace("source_key: two", "source_key: one"), "more than once"), (COVERAGE.replace("implemented, rules: [CPY9001]", 'duplicate, note: "x"'), "names no rule"),
])
def test_dispositions(tmp_path, bad, says):
    registry_at(tmp_path)
    (tmp_path / "index.yaml").write_text('schema_version: 1\nrelease: "1"\nreleases: r.yaml\nrules: [a.yaml]\ncoverage: [c.yaml]\n')
    (tmp_path / "c.yaml").write_text(bad)
    with pytest.raises(R.RegistryError, match=says):
        R.load(str(tmp_path))


def test_registry_stays_in_its_folder(tmp_path):
    (tmp_path / "in").mkdir()
    registry_at(tmp_path / "in")
    (tmp_path / "a.yaml").write_text(RULE)
    for name in ("../a.yaml", "link/a.yaml"):
        (tmp_path / "in" / "index.yaml").write_text(f'schema_version: 1\nrelease: "1"\nreleases: r.yaml\nrules: [{name}]\n')
        if not (tmp_path / "in" / "link").exists():
            (tmp_path / "in" / "link").symlink_to(tmp_path)
        with pytest.raises(R.RegistryError, match="outside"):
            R.load(str(tmp_path / "in"))


def test_schema_and_details_on_the_command_line(capsys):
    from driftgauge.cli import main

    for name in ("rule", "index", "releases", "coverage"):
        assert main(["registry", "schema", "--document", name]) == 0
        shown = json.loads(capsys.readouterr().out)
        assert shown["title"] == name and shown["additionalProperties"] is False
    assert main(["explain", "CPY0094"]) == 0
    assert "with onerror" in capsys.readouterr().out


@pytest.mark.parametrize("pattern,path,hit", [
    ("*.py", "a/b.py", True), ("/a.py", "a.py", True), ("/a.py", "x/a.py", False), ("build/", "x/build/", True), ("build/", "build", False), ("a/**/b.py", "a/x/y/b.py", True), ("a/**/b.py", "a/b.py", True),
    ("**/t", "x/t", True), ("a?.py", "ab.py", True), ("[ab].py", "a.py", True), ("[!ab].py", "a.py", False), ("src", "src/", True), ("a/*", "a/b/c", True), ("a/**", "a/b/c", True),
])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.fullmatch(D.glob_regex(pattern), path)) is hit


def test_discovery(tmp_path):
    write(tmp_path, **{"a.py": "", "b.txt": "", "c.pyi": "", "sub__d.py": "", "sub__skip.py": "", "sub__keep.py": "", "venv__x.py": "", "gen__y.py": "", "a-b__z.py": "", "a__b.py": ""})
    (tmp_path / ".gitignore").write_text("gen/\nskip.py\nkeep.py\n")
    (tmp_path / "sub" / ".gitignore").write_text("!keep.py\n")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    os.symlink("/etc/hostname", tmp_path / "out.py")
    (tmp_path / "big.py").write_text("x" * 100)
    d = D.discover(str(tmp_path), max_bytes=50)
    assert d.files == ["a/b.py", "a-b/z.py", "a.py", "c.pyi", "sub/d.py", "sub/keep.py"]
    assert [(p, c) for p, c, _ in d.issues] == [("big.py", "PYA1005"), ("link", "PYA1004"), ("out.py", "PYA1004")]
    assert "gen/y.py" in D.discover(str(tmp_path), gitignore=False).files
    assert D.discover(str(tmp_path), ["sub/d.py"]).files == ["sub/d.py"]
    assert D.discover(str(tmp_path), include=["sub/**"], exclude=["sub/keep.py"]).files == ["sub/d.py"]
    for bad in (["../x"], ["b.txt"], ["none.py"]):
        with pytest.raises(D.DiscoveryError):
            D.discover(str(tmp_path), bad)


def test_directory_that_cannot_be_listed(tmp_path, monkeypatch):
    write(tmp_path, **{"a.py": "", "shut__b.py": ""})
    real = os.listdir

    def listdir(path):
        if path.endswith("shut"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "listdir", listdir)
    d = D.discover(str(tmp_path))
    assert d.files == ["a.py"] and d.issues == [("shut", "PYA1001", "directory cannot be listed: Permission denied")]


def test_reading(tmp_path):
    (tmp_path / "l.py").write_bytes("# coding: latin-1\nx = 'é'\r\n".encode("latin-1"))
    (tmp_path / "u.py").write_bytes(b"\xff\xfe")
    assert D.read_source(str(tmp_path), "l.py")[0].endswith("'é'\n")
    assert D.read_source(str(tmp_path), "u.py")[1][0] == "PYA1002" and D.read_source(str(tmp_path), "none.py")[1][0] == "PYA1002"
    assert D.read_source(str(tmp_path), "l.py", 3)[1][0] == "PYA1005"


def test_project_modules():
    found = D.Discovered(files=["cgi.py", "src/pkg/__init__.py", "src/pkg/a.py", "x-y/z.py"], links=["src"])
    m = D.project_modules(found, [".", "src"])
    assert m["cgi"] == ["cgi.py"] and m["pkg"] == ["src/pkg/__init__.py", "src/pkg/a.py"] and m["*"] == ["src"] and "x-y" not in m


def test_configuration(tmp_path):
    r = R.load()
    (tmp_path / "pyproject.toml").write_text('[project]\nrequires-python = ">=3.12"\n[tool.driftgauge]\nfail-on = "any"\nper-file-ignores = {"a/*" = ["CPY0001"]}\n')
    c = C.resolve(str(tmp_path), r, per_file_ignores={"a/*": ["CPY0002"], "b": ["CPY0003"]}, fail_on="risk")
    assert (c.baseline, c.horizon, c.fail_on) == (12, 15, "risk") and c.per_file_ignores == {"a/*": ["CPY0001", "CPY0002"], "b": ["CPY0003"]}
    assert c.provenance == {"baseline-python": "inferred:requires-python", "horizon-python": "default:newest-release"}
    for text in ('[tool.driftgauge]\nunknown = 1\n', '[tool.driftgauge]\nfail-on = 1\n', '[tool.driftgauge]\nminimum-confidence = "low"\nbaseline-python = "3.11"\n', ""):
        (tmp_path / "pyproject.toml").write_text(text)
        with pytest.raises(C.ConfigurationError):
            C.resolve(str(tmp_path), r)
    with pytest.raises(C.ConfigurationError):
        C.resolve(str(tmp_path), r, baseline="3.13", horizon="3.12")


@pytest.mark.parametrize("spec,want", [(">=3.11", 11), (">=3.12.4", 12), ("~=3.13.0", 13), ("<3.11", None), ("==3.14.*", 14)])
def test_requires_python(spec, want):
    assert C.infer_baseline(spec, tuple(range(11, 17))) == want


def test_baseline_file(tmp_path):
    good = {"schema_version": 1, "created_by": "x", "registry_revision": "y", "findings": [{"fingerprint": "a" * 64, "rule_id": "R", "path": "p", "subject": "s"}]}
    path = tmp_path / "b.json"
    path.write_text(json.dumps(good))
    assert C.load_baseline(str(path)) == ["a" * 64]
    for bad in (json.dumps({**good, "more": 1}), '{"schema_version": 1, "schema_version": 1}', json.dumps({**good, "findings": [{**good["findings"][0], "path": "/abs"}]}), json.dumps({**good, "findings": good["findings"] * 2}), "["):
        path.write_text(bad)
        with pytest.raises(C.ConfigurationError):
            C.load_baseline(str(path))

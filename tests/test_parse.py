"""The parser alone: scopes, guards, literals, directives."""

import pytest

from driftgauge.pyparse.extract import extract, t_and, t_not, t_or

WINDOW = tuple(range(11, 17))


def parse(source, path="m.py", **more):
    return extract(path, source, WINDOW, **more)


def reach(source):
    return {i["sl"]: i["reach"] for i in parse(source)["imports"]}


def names(source):
    return [sorted(n["name"] for n in r["names"]) for r in parse(source)["refs"]]


@pytest.mark.parametrize("guard,yes", [
    ("sys.version_info < (3, 13)", [11, 12]),
    ("sys.version_info >= (3, 13)", [13, 14, 15, 16]),
    ("(3, 13) > sys.version_info", [11, 12]),
    ("sys.version_info[:2] == (3, 12)", [12]),
    ("sys.version_info[:2] <= (3, 12)", [11, 12]),
    ("sys.version_info <= (3, 12)", [11]),
    ("sys.version_info != (3, 13)", [11, 12, 13, 14, 15, 16]),
    ("not (sys.version_info < (3, 13))", [13, 14, 15, 16]),
    ("sys.version_info >= (3, 13) and unknown", [13, 14, 15, 16]),
    ("sys.version_info >= (3, 13) or unknown", [11, 12, 13, 14, 15, 16]),
    ("sys.version_info >= (3, 12) and sys.version_info < (3, 14)", [12, 13]),
    ("sys.version_info > (3,)", [11, 12, 13, 14, 15, 16]),
])
def test_guards(guard, yes):
    assert reach(f"import sys\nif {guard}:\n    import cgi\n")[3] == yes


def test_elif_takes_what_is_left():
    r = reach("import sys\nif sys.version_info < (3, 12):\n    import a\nelif sys.version_info < (3, 13):\n    import b\nelif sys.version_info[:2] == (3, 13):\n    import c\nelse:\n    import d\n")
    assert (r[3], r[5], r[7], r[9]) == ([11], [12], [13], [14, 15, 16])


def test_patch_guard_is_unknown_and_told():
    r = parse("import sys\nif sys.version_info >= (3, 12, 1):\n    import cgi\n")
    assert r["imports"][1]["reach"] == list(WINDOW) and len(r["patches"]) == 1


def test_alias_and_shadowed_guard():
    assert reach("from sys import version_info as v\nif v < (3, 13):\n    import cgi\n")[3] == [11, 12]
    assert reach("import sys\nsys = 1\nif sys.version_info < (3, 13):\n    import cgi\n")[4] == list(WINDOW)


def test_truth_tables():
    assert [t_not(x) for x in (True, False, None)] == [False, True, None]
    v = (True, False, None)
    assert [t_and(a, b) for a in v for b in v] == [True, False, None, False, False, False, None, False, None]
    assert [t_or(a, b) for a in v for b in v] == [True, True, True, True, False, None, True, None, None]


def test_typing_contexts():
    source = "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import a\nelse:\n    import b\nif not TYPE_CHECKING:\n    import c\n"
    got = {i["module"]: i["ctx"] for i in parse(source)["imports"]}
    assert got["a"] == [] and got["b"] == ["runtime"] and got["c"] == ["runtime"]
    stub = {i["module"]: i["ctx"] for i in parse(source, "m.pyi")["imports"]}
    assert stub["a"] == ["typing"] and stub["b"] == []
    blocked = {i["module"]: i["ctx"] for i in parse(source, blocked=frozenset({"typing"}))["imports"]}
    assert blocked["a"] == ["runtime"]


@pytest.mark.parametrize("source,want", [
    ("import a.b as c\nc.d\n", [["a.b.d"], ["a.b"]]),
    ("from a import b\ndef f(b):\n    b.c\n", []),
    ("from a import b\ndef f():\n    b.c\n", [["a.b.c"], ["a.b"]]),
    ("if x:\n    from a import q\nelse:\n    from b import q\nq\n", [["a.q", "b.q"]]),
    ("from a import b\nclass K:\n    b = 1\n    def f(self):\n        return b\n", [["a.b"]]),
    ("import a\ndef f():\n    global a\n    return a.b\n", [["a.b"], ["a"]]),
    ("import a\n[a.b for a in x]\n", []),
    ("from a import *\nq\n", []),
    ("import a\na().b\n", [["a.b"], ["a"]]),
    ("from .a import b\nb\n", [[".a.b"]]),
])
def test_names(source, want):
    assert names(source) == want


def test_reference_contexts_and_scopes():
    r = parse("import m\n@m.d\nclass A(m.B):\n    x: m.T = m.v\n    def f(self, y: m.T = m.e) -> m.R:\n        return m.z\n")
    got = {x["names"][0]["name"]: (x["ref_ctx"], x["scope"]) for x in r["refs"] if "." in x["names"][0]["name"]}
    assert got == {"m.d": ("decorator", "<module>"), "m.B": ("base-class", "<module>"), "m.T": ("annotation", "A"), "m.v": ("read", "A"), "m.e": ("read", "A"), "m.R": ("annotation", "A"), "m.z": ("read", "A.f")}


def test_columns_are_code_points():
    r = parse("import m\nx = 'é🎉', m.z\n")["refs"][0]
    assert (r["sl"], r["sc"], r["ec"]) == (2, 11, 14)


@pytest.mark.parametrize("call,module", [
    ("importlib.import_module('cgi')", "cgi"), ("importlib.import_module(name='cgi')", "cgi"), ("importlib.import_module('.cgi', 'x')", None), ("importlib.import_module(n)", None),
    ("importlib.import_module('c' 'gi')", "cgi"), ("importlib.import_module('a', name='b')", None), ("importlib.import_module(*a)", None), ("__import__('cgi')", "cgi"), ("__import__('cgi', level=0)", "cgi"),
    ("__import__('cgi', level=1)", None), ("__import__('cgi', {}, {}, [], 0)", "cgi"), ("importlib.import_module(b'cgi')", None),
])
def test_dynamic_imports(call, module):
    assert [c["module"] for c in parse(f"import importlib\n{call}\n")["calls"]][0] == module


def test_literals_keep_their_type():
    c = parse("import m\nm.f(1, True, 1.0, None, -2, +3.5, 'a', b'x', x)\n")["calls"][0]["positional"]
    assert [(p["type"], p["value"]) for p in c] == [("int", "1"), ("bool", "True"), ("float", "1.0"), ("null", "None"), ("int", "-2"), ("float", "3.5"), ("str", "a"), ("", ""), ("", "")]


def test_patterns():
    assert len(parse("~True\n~False\n~x\n-True\n")["unary"]) == 2


def test_directives():
    r = parse("f(\n  1,  # driftgauge: ignore[R1, R2,, R1] -- why\n)\nx = '# driftgauge: ignore[R3]'\n# driftgauge: ignore[]\n# driftgauge: nonsense\n@d  # driftgauge: ignore[R4]\ndef g():\n    pass\n")
    d = r["directives"]
    assert [(x["ids"], x["reason"]) for x in d] == [(["R1", "R2"], "why"), (["R4"], None)]
    assert (d[0]["statement"]["sl"], d[0]["statement"]["el"]) == (1, 3)
    assert [x["code"] for x in r["diagnostics"]] == ["PYA3002", "PYA3002"]


@pytest.mark.parametrize("source", ["(" * 300, "def f(:\n", "x = " + "-" * 400 + "1\n", "\0", "if x:\npass\n", "x = " + "a." * 400 + "b\n"])
def test_what_cannot_be_parsed_is_told(source):
    r = parse(source)
    assert r["status"] == "incomplete" and r["diagnostics"][0]["code"] == "PYA1003"


def test_a_file_without_a_path_is_a_diagnostic():
    got = extract(None, "import cgi\n", (11, 12, 13))
    assert got["status"] == "incomplete" and got["imports"] == [] and [d["code"] for d in got["diagnostics"]] == ["PYA1001"]

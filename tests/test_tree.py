"""The tree source and the ignore rules on Spark, against discovery on one machine."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from driftgauge.operators import ignores as I
from driftgauge.plans.scan import admitted, scan, scan_frame
from driftgauge.sources import config as C
from driftgauge.sources import discovery as D
from driftgauge.sources import paths as P
from driftgauge.sources import tree as T

POLICY = dict(baseline="3.11", horizon="3.13")


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def taken(spark, root, paths=None, **more):
    config = C.Config(**more)
    rows = admitted(T.entries(spark, str(root), config.max_file_size_bytes, contents=False), str(root), paths, config).collect()
    return sorted(r.path for r in rows if r.kind == "file"), sorted((r.path, r.code, r.message) for r in rows if r.kind != "file")


def plain(root, paths=None, include=(), exclude=(), respect_gitignore=True, max_file_size_bytes=D.MAX_BYTES):
    d = D.discover(str(root), paths, include, exclude, respect_gitignore, max_file_size_bytes)
    return sorted(d.files), sorted(d.issues)


CASES = [
    ({"src__keep.py": "", "src__ignored.py": "", "src__generated__drop.py": "", "tests__outside.py": "", ".gitignore": "src/ignored.py\n"}, {"include": ["src/**/*.py"], "exclude": ["src/generated/**"]}, ["src/keep.py"]),
    ({"drop.py": "", "keep.py": "", ".gitignore": "*.py\n!keep.py\n"}, {}, ["keep.py"]),
    ({"drop.py": "", "keep.py": "", ".gitignore": "*.py\n!keep.py\n"}, {"respect_gitignore": False}, ["drop.py", "keep.py"]),
    ({"pkg__legacy.py": "", "pkg__keep.py": "", "sibling__legacy.py": "", "pkg__.gitignore": "/legacy.py\n"}, {}, ["pkg/keep.py", "sibling/legacy.py"]),
    (
        {"drop.py": "", "pkg__keep.py": "", "pkg__nested__drop.py": "", "pkg__nested__keep.py": "", "blocked__keep.py": "", ".gitignore": "*.py\nblocked/\n", "pkg__.gitignore": "!keep.py\nnested/*.py\n", "pkg__nested__.gitignore": "!keep.py\n", "blocked__.gitignore": "!keep.py\n"},
        {}, ["pkg/keep.py", "pkg/nested/keep.py"],
    ),
    ({"a__b.py": "", "a__c.py": ""}, {"exclude": ["a/*", "!a/c.py"]}, ["a/c.py"]),
    ({"a__b.py": "", "a__c.py": ""}, {"exclude": ["a/", "!a/c.py"]}, []),
    ({"a[b].py": "", "c&&d.py": "", "e f.py": "", "g.py": "", ".gitignore": "a[[]b].py\n[c]&&d.py\ne\\ f.py\n"}, {}, ["g.py"]),
]


@pytest.mark.parametrize(("files", "options", "want"), CASES)
def test_rules(spark, tmp_path, files, options, want):
    put(tmp_path, **files)
    assert taken(spark, tmp_path, **options) == plain(tmp_path, **options) == (want, [])


def test_random_trees(spark, tmp_path):
    rng = random.Random(9)
    lines = ["*.py", "!a.py", "/a.py", "b/", "b", "c/*", "**/d", "!d/", "a/**", "?.py", "[!a].py", "", "# b", "!c/a.py", "d.py", "b/c/"]
    for n in range(2):
        root = tmp_path / str(n)
        for _ in range(60):
            folder = root.joinpath(*[rng.choice("abcd") for _ in range(rng.randrange(4))])
            folder.mkdir(parents=True, exist_ok=True)
            (folder / (rng.choice("abcd") + rng.choice([".py", ".py", ".pyi", ".txt"]))).write_text("x" * rng.randrange(4)) if not (folder / "a.py").is_dir() else None
            if rng.random() < 0.3:
                (folder / ".gitignore").write_text("\n".join(rng.choice(lines) for _ in range(rng.randrange(4))))
        if not (root / "l").exists():
            os.symlink(root, root / "l")
        for options in ({}, {"include": rng.sample(lines, 2), "exclude": rng.sample(lines, 2)}, {"max_file_size_bytes": 2, "paths": sorted(x for x in ("a", "b") if (root / x).is_dir())}):
            assert taken(spark, root, **options) == plain(root, **options), (n, options)


def test_requested_paths_obey_all_rules(spark, tmp_path):
    put(tmp_path, **{"a__x.py": "", "a__venv__y.py": "", "a__z.py": "", "b__w.py": "", ".gitignore": "z.py\nb/\n"})
    os.symlink(tmp_path / "a", tmp_path / "alias")
    os.symlink(tmp_path.parent, tmp_path / "up")
    for paths, want in ((["a"], ["a/x.py"]), (["a/venv"], []), (["a/venv/y.py"], []), (["a/z.py"], []), (["b"], []), (["b/w.py", "a/x.py"], ["a/x.py"])):
        assert taken(spark, tmp_path, paths) == plain(tmp_path, paths) == (want, [])
    for paths in (["alias"], ["alias/x.py"]):
        got = taken(spark, tmp_path, paths)
        assert got == plain(tmp_path, paths) and got[0] == [] and [(p, c) for p, c, _ in got[1]] == [("alias", "PYA1004")]
    for bad in (["up"], ["../x.py"], ["none.py"], [".gitignore"]):
        for f in (lambda p: taken(spark, tmp_path, p), lambda p: plain(tmp_path, p)):
            with pytest.raises(D.DiscoveryError):
                f(bad)


@pytest.mark.parametrize(("make", "error"), [
    (lambda p: p.write_bytes(b"\xff*.py"), D.DiscoveryError), (lambda p: os.mkfifo(p), D.DiscoveryError), (lambda p: p.write_bytes(b"#" * (D.MAX_IGNORE_BYTES + 1)), D.DiscoveryIncompleteError),
])
def test_ignore_files_at_fault(spark, tmp_path, make, error):
    put(tmp_path, **{"a.py": "import cgi\n", "in__b.py": ""})
    make(tmp_path / "in" / ".gitignore")
    for f in (taken, lambda s, *a, **k: plain(*a, **k)):
        with pytest.raises(error):
            f(spark, tmp_path)
        assert f(spark, tmp_path, ["a.py"])[0] == ["a.py"] and f(spark, tmp_path, respect_gitignore=False)[0] == ["a.py", "in/b.py"]
    (tmp_path / ".gitignore").write_text("in/\n")  # an ignored directory's own file does not count
    assert taken(spark, tmp_path)[0] == plain(tmp_path)[0] == ["a.py"]


def test_incomplete_rules_stop_the_scan(spark, tmp_path):
    put(tmp_path, **{"a.py": "import cgi\n", ".gitignore": "#" * (D.MAX_IGNORE_BYTES + 1)})
    s = scan(spark, str(tmp_path), **POLICY)
    assert s.findings.count() == 0 and [r.code for r in s.diagnostics.collect()] == ["PYA1001"] and s.summary().first().exit_code == 3
    os.unlink(tmp_path / ".gitignore")
    os.symlink("/etc/hostname", tmp_path / ".gitignore")  # a link is never followed
    assert scan(spark, str(tmp_path), **POLICY).findings.count() == 1


def test_modules(spark, tmp_path):
    names = ["cgi.py", "src/widget/__init__.py", "src/widget/api.py", "src/cgi.pyi", "bad-name.py", "x-y/z.py", "a/b/c.py", "src/__init__.py", "é/f.py", "lib/p/q.py", "n2/2x.py"]
    for n in names:
        put(tmp_path, **{n: ""})
    os.makedirs(tmp_path / "t")
    for link in ("src/w", "t/v", "o-k"):
        os.symlink(tmp_path / "a", tmp_path / link)
    for roots, inferred in (([".", "src"], True), ([".", "src"], False), (["lib", "src/w/in"], False), ([], False)):
        listing = T.entries(spark, str(tmp_path), contents=False)
        got = {}
        for r in T.modules(listing, roots, inferred).collect():
            got.setdefault(r.key, []).append(r.path)
        assert {k: sorted(v) for k, v in got.items()} == D.project_modules(D.discover(str(tmp_path), gitignore=False), roots, inferred), roots


def test_only_what_is_asked_for_is_entered(spark, tmp_path):
    put(tmp_path, **{"a__b__c.py": "x = 1\n", "a__d.py": "", "e__f.py": "", "g.py": ""})
    rows = lambda *under: sorted((r.path, r.source) for r in T.entries(spark, str(tmp_path), under=under).collect())
    assert rows("a/b/c.py") == [("a/b/c.py", "x = 1\n")] and [p for p, _ in rows("g.py", "a/d.py")] == ["a/d.py", "g.py"] and len(rows()) == 4
    reader = T.TreeReader({"root": str(tmp_path), "under": "a/b"})
    assert [d for d in ("a", "a/b", "a/b/x", "a/x", "e") if reader.near(d)] == ["a", "a/b", "a/b/x"]
    e = T.entries(spark, str(tmp_path), contents=False)  # two scans of one frame, each with its own filter
    assert e.where("path = 'g.py'").select("kind").join(e.where("path <> 'g.py'").select("kind", "path"), "kind").count() == 3


def test_nothing_is_read_through_a_link(tmp_path):
    put(tmp_path, **{"in__a__x.py": "inside\n", "out__x.py": "outside\n"})
    root = str(tmp_path / "in")
    assert D.read_source(root, "a/x.py")[0] == "inside\n"
    os.rename(tmp_path / "in/a", tmp_path / "in/b")
    os.symlink(tmp_path / "out", tmp_path / "in/a")  # the directory is swapped after it was listed
    assert D.read_source(root, "a/x.py")[0] is None
    os.symlink("b/x.py", tmp_path / "in/y.py")
    assert D.read_source(root, "y.py")[0] == "inside\n"
    os.symlink("../out/x.py", tmp_path / "in/z.py")
    assert D.read_source(root, "z.py")[1][0] == "PYA1004"
    for bad in ("../out/x.py", "/etc/hostname", "b/../../out/x.py"):
        with pytest.raises(P.Unsafe):
            P.open_file(root, bad)
    os.mkfifo(tmp_path / "in/p.py")
    assert D.read_source(root, "p.py")[1][0] == "PYA1004"


def test_baseline_lies_beneath_the_root(tmp_path):
    put(tmp_path, **{"in__x": "", "b.json": "{}"})
    with pytest.raises(C.ConfigurationError, match="outside"):
        C.load_baseline(str(tmp_path / "b.json"), str(tmp_path / "in"))
    os.symlink(tmp_path / "b.json", tmp_path / "in/b.json")
    with pytest.raises(C.ConfigurationError):
        C.load_baseline("b.json", str(tmp_path / "in"))


def test_scan_of_a_tree_is_the_scan_of_its_files(spark, tmp_path):
    put(tmp_path, **{"a.py": "import cgi\nimport uu\nimport nis\n", "uu.py": "import cgi\n", "gen__c.py": "import cgi\n", "bad.py": "(", "sub__.gitignore": "/n.py\n", "sub__n.py": "import imp\n", "sub__o.pyi": "import imp\n", ".gitignore": "gen/\n", "latin.py": ""})
    (tmp_path / "latin.py").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "sub", tmp_path / "nis")
    s = scan(spark, str(tmp_path), minimum_confidence="medium", **POLICY)
    found = D.discover(str(tmp_path))
    modules = D.project_modules(D.discover(str(tmp_path), gitignore=False), [".", "src"])
    read = [(p, *D.read_source(str(tmp_path), p)) for p in found.files]
    files = spark.createDataFrame([(p, t) for p, t, f in read if not f], "path string, source string")
    one = scan_frame(spark, files, s.registry, s.config, modules, None, [*found.issues, *((p, *f) for p, _, f in read if f)])
    for name in ("findings", "inferences", "diagnostics"):
        a, b = ([r.asDict(True) for r in getattr(x, name).collect()] for x in (s, one))
        assert sorted(map(repr, a)) == sorted(map(repr, b)) and a, name
    assert s.discovered == len(found.files) + len(found.issues) == 6


def test_ignored_of_a_frame(spark):
    """Paths that repeat, the empty one, and a base without rules."""
    listing = spark.createDataFrame([("a/b.py",), ("a/b.py",), ("c.py",), ("",), ("a/x/y/z",)], "path string")
    rules = spark.createDataFrame([("", D.glob_rules(["*.py", "x/"])), ("a", D.glob_rules(["!b.py"])), ("a/x", D.glob_rules(["!*"]))], "base string, rules array<struct<again:boolean,regex:string>>")
    assert sorted(r.path for r in I.ignored(listing, rules).collect()) == ["a/x/y/z", "c.py"]
    assert I.ignored(listing, rules.where("false")).count() == 0 and I.ignored(listing.where("false"), rules).count() == 0
    specs = {r.base: [(again, re.compile(x)) for again, x in r.rules] for r in rules.collect()}
    assert [p for p in ("a/b.py", "c.py", "a/x/y/z") if D.ignored(p, specs)] == ["c.py", "a/x/y/z"]

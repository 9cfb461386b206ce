"""Finding and admitting source files, and the modules that a project itself provides.

list_directory() looks at one directory by its descriptor. tree.py walks with it in tasks and Spark holds its rows against
the ignore rules; discover() is the same for one tree on one machine, without Spark.
"""

from __future__ import annotations

import os
import re
import stat
import tokenize
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import NamedTuple

from driftgauge.sources import paths as P

SUFFIXES = (".py", ".pyi")
# Directories that are never entered.
EXCLUDED = (".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "site-packages", "venv")
MAX_BYTES, MAX_IGNORE_BYTES = 2 << 20, 1 << 20
IGNORE = ".gitignore"


class DiscoveryError(ValueError):
    pass


class DiscoveryIncompleteError(OSError):
    """Something that decides on other files could not be read, so no list of files would be right."""


@dataclass
class Discovered:
    files: list[str] = field(default_factory=list)
    issues: list[tuple[str, str, str]] = field(default_factory=list)  # path, code, message
    links: list[str] = field(default_factory=list)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of one ignore line over a POSIX path (directories end in /), or None for blanks and comments."""
    p = pattern.rstrip("\n")
    while p.endswith(" ") and not p.endswith("\\ "):
        p = p[:-1]
    if not p or p.startswith("#"):
        return None
    p = p.removeprefix("!")
    only_dir, p = p.endswith("/"), p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            whole = i == 0 or p[i - 1] == "/"
            while i + 1 < len(p) and p[i + 1] == "*":
                i += 1
            i += 1
            out += "[^/]+" if whole and (i == len(p) or p[i] == "/") else "[^/]*"  # a component is never empty
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/" if only_dir else "/?") + ("" if only_dir else "") + ("(?:.*)?" if only_dir else "(?:(?<=/).*)?")


def glob_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(re-includes, regular expression) of the lines that are patterns."""
    return [(line.startswith("!"), r) for line in lines if (r := glob_regex(line)) is not None]


def compile_lines(lines: list[str]) -> list[tuple[bool, re.Pattern]]:
    return [(again, re.compile(r)) for again, r in glob_rules(lines)]


def decided(specs: list[tuple[bool, re.Pattern]], path: str) -> bool | None:
    """Whether the last matching pattern ignores the path; None where none matches."""
    for again, r in reversed(specs):
        if r.fullmatch(path):
            return not again
    return None


class Entry(NamedTuple):
    """What a directory holds. kind: file, issue (a source that cannot be read), link (to a directory), rules (an ignore file)."""

    path: str
    kind: str
    size: int | None = None
    code: str | None = None
    message: str | None = None
    rules: list[tuple[bool, str]] | None = None


def ignore_rules(fd: int, rel: str) -> Entry | None:
    """The ignore file of an open directory, if it has one that counts. code error: it is at fault; incomplete: it could not be read."""
    own = f"{rel}/{IGNORE}" if rel else IGNORE
    try:
        seen = os.stat(IGNORE, dir_fd=fd, follow_symlinks=False)
    except FileNotFoundError:
        return None
    except OSError:
        return Entry(rel, "rules", None, "incomplete", f"unable to inspect {own}")
    if stat.S_ISLNK(seen.st_mode):  # never followed
        return None
    if not stat.S_ISREG(seen.st_mode):
        return Entry(rel, "rules", None, "error", f"{own} must be a regular file")
    try:
        file = os.open(IGNORE, P.FILE, dir_fd=fd)
        try:
            raw = P.read_open(file, MAX_IGNORE_BYTES, seen)
        finally:
            os.close(file)
    except P.TooLarge:
        return Entry(rel, "rules", None, "incomplete", f"{own} exceeds the {MAX_IGNORE_BYTES}-byte ignore-file limit")
    except OSError as e:
        return Entry(rel, "rules", None, "incomplete", f"{own} {e}" if isinstance(e, P.Unsafe) else f"unable to read {own}")
    try:
        got = glob_rules(raw.decode("utf-8").splitlines())
        for _, r in got:
            re.compile(r)
    except UnicodeError:
        return Entry(rel, "rules", None, "error", f"{own} must be valid UTF-8")
    except re.error:
        return Entry(rel, "rules", None, "error", f"{own} contains an invalid pattern")
    return Entry(rel, "rules", len(raw), rules=got)


def inspect(root: str, fd: int, own: str, name: str, max_bytes: int) -> Entry:
    """A source file of an open directory; a link to a file beneath the root counts as that file under its own name."""
    try:
        s = os.stat(name, dir_fd=fd, follow_symlinks=False)
        if stat.S_ISLNK(s.st_mode):
            target = P.resolved(root, own)
            file = P.open_file(root, target)
            try:
                s = os.fstat(file)
            finally:
                os.close(file)
    except P.Unsafe as e:
        return Entry(own, "issue", None, "PYA1004", str(e))
    except OSError as e:
        return Entry(own, "issue", None, "PYA1002", f"cannot be read: {e.strerror}")
    if not stat.S_ISREG(s.st_mode):
        return Entry(own, "issue", None, "PYA1004", "not a regular file")
    if s.st_size > max_bytes:
        return Entry(own, "issue", s.st_size, "PYA1005", f"larger than {max_bytes} bytes")
    return Entry(own, "file", s.st_size)


def list_directory(root: str, rel: str, max_bytes: int = MAX_BYTES) -> tuple[list[Entry], list[str]]:
    """(entries, directories to enter) of a directory beneath the root, in order of name. Directories that are never entered are left out."""
    out, inner = [], []
    try:
        fd = P.open_directory(root, rel)
    except OSError as e:
        return [Entry(rel or ".", "issue", None, "PYA1001", f"directory cannot be listed: {e.strerror}")], []
    try:
        try:
            names = sorted(os.listdir(os.path.join(root, rel)))
        except OSError as e:
            return [Entry(rel or ".", "issue", None, "PYA1001", f"directory cannot be listed: {e.strerror}")], []
        if (rules := ignore_rules(fd, rel)) is not None:
            out.append(rules)
        for name in names:
            own = f"{rel}/{name}" if rel else name
            try:
                mode = os.stat(name, dir_fd=fd, follow_symlinks=False).st_mode
                leads = stat.S_ISLNK(mode) and stat.S_ISDIR(os.stat(name, dir_fd=fd).st_mode)
            except OSError:
                mode, leads = 0, False
            if stat.S_ISDIR(mode) or leads:
                if name in EXCLUDED:
                    continue
                if leads:
                    out.append(Entry(own, "link", None, "PYA1004", "a symbolic link to a directory is not followed"))
                else:
                    inner.append(own)
            elif name.endswith(SUFFIXES):
                out.append(inspect(root, fd, own, name, max_bytes))
    finally:
        os.close(fd)
    return out, inner


def walk(root: str, starts: list[str], max_bytes: int = MAX_BYTES, within=None):
    """Entries of directories and all below them; within(directory): whether it is entered."""
    todo = list(reversed(starts))
    while todo:
        entries, inner = list_directory(root, todo.pop(), max_bytes)
        yield from entries
        todo += [d for d in reversed(inner) if within is None or within(d)]


def above(path: str) -> list[str]:
    """The directories that a path lies in, from the root's, which is empty, down."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts))]


def ignored(path: str, specs: dict[str, list[tuple[bool, re.Pattern]]]) -> bool:
    """Whether a path or a directory that it lies in is ignored: of the files from the root down, the last line that matches decides."""
    for node, is_dir in [*((d, True) for d in above(path)[1:]), (path, False)]:
        verdict = False
        for base in above(node):
            got = decided(specs.get(base, []), node[len(base) + 1 if base else 0 :] + "/" * is_dir)
            verdict = verdict if got is None else got
        if verdict:
            return True
    return False


def selected(path: str, include: list, exclude: list) -> bool:
    """Whether the include patterns take a path and the exclude patterns neither it nor a directory that it lies in."""
    if include and not decided_in(include, path):
        return False
    return not any(decided_in(exclude, x) for x in [*(d + "/" for d in above(path)[1:]), path])


def decided_in(specs: list[tuple[bool, re.Pattern]], path: str) -> bool:
    return bool(decided(specs, path))


def requests(root: str, paths: list[str] | None) -> tuple[list[tuple[str, bool]], list[str]]:
    """((path, is a file) to take, links in the way) of requested paths, which must lie beneath the root. A path in a directory that is
    never entered takes nothing."""
    take, links = [], []
    for p in paths or ["."]:
        full = os.path.normpath(os.path.join(root, p))
        if full != root and not full.startswith(root + os.sep):
            raise DiscoveryError(f"{p}: outside the root")
        rel = "" if full == root else os.path.relpath(full, root)
        if not os.path.lexists(full):
            raise DiscoveryError(f"{p}: no such file")
        is_dir = os.path.isdir(full)
        real = os.path.realpath(full)
        if (is_dir or os.path.exists(full)) and real != root and not real.startswith(root + os.sep) and P.first_link(root, rel if is_dir else os.path.dirname(rel)):
            raise DiscoveryError(f"{p}: outside the root")
        if not is_dir and not full.endswith(SUFFIXES):
            raise DiscoveryError(f"{p}: not a Python source file")
        link = P.first_link(root, rel if is_dir else os.path.dirname(rel))
        if link is not None:
            links.append(link)
        elif not set(rel.split("/") if is_dir else rel.split("/")[:-1]) & set(EXCLUDED):
            take.append((rel, not is_dir))
    return take, links


def discover(root: str, paths: list[str] | None = None, include: list[str] = (), exclude: list[str] = (), gitignore: bool = True, max_bytes: int = MAX_BYTES) -> Discovered:
    """Files in order of their path parts; links, specials and files over the limit are issues. Requested paths obey all rules."""
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise DiscoveryError(f"not a directory: {root}")
    out, found, specs = Discovered(), {}, {}
    inc, exc = compile_lines(list(include)), compile_lines(list(exclude))
    take, links = requests(root, paths)

    def taken(path: str) -> bool:
        return any(path == rel or not is_file and (not rel or path.startswith(rel + "/")) for rel, is_file in take)

    def near(directory: str) -> bool:
        return any(directory == rel or not rel or directory.startswith(rel + "/") or rel.startswith(directory + "/") for rel, _ in take)

    entries = [e for link in links for e in [Entry(link, "link", None, "PYA1004", "a symbolic link to a directory is not followed")]]
    entries += [e for e in walk(root, [""], max_bytes, near) if e.kind == "rules" or taken(e.path) or e.path == "."]
    for e in entries:
        if e.kind == "rules" and gitignore and not (e.path and ignored(e.path + "/x", specs)):
            if e.code:
                raise (DiscoveryError if e.code == "error" else DiscoveryIncompleteError)(e.message)
            specs[e.path] = [(again, re.compile(r)) for again, r in e.rules]
    for e in entries:
        if e.kind == "rules" or e.code != "PYA1001" and (gitignore and ignored(e.path, specs) or not selected(e.path, inc if e.kind != "link" else [], exc)):
            continue
        if e.code == "PYA1001" and e.path != "." and (gitignore and ignored(e.path + "/x", specs) or not selected(e.path + "/x", [], exc)):
            continue
        found[e.path] = None if e.kind == "file" else (e.code, e.message)
        if e.kind == "link":
            out.links.append(e.path)
    for rel in sorted(found, key=lambda x: PurePosixPath(x).parts):
        if found[rel] is None:
            out.files.append(rel)
        else:
            out.issues.append((rel, *found[rel]))
    return out


def read_source(root: str, rel: str, max_bytes: int = MAX_BYTES) -> tuple[str | None, tuple[str, str] | None]:
    """(text, None) or (None, (code, message)); decoded as the file's own declaration says. A link leads to a file beneath the root or is
    refused; nothing else on the way may be a link."""
    try:
        root = os.path.realpath(root)
        own = P.resolved(root, rel) if os.path.islink(os.path.join(root, rel)) else rel
        raw = P.read(root, own, max_bytes)
        lines = iter(raw.splitlines(True))
        encoding, _ = tokenize.detect_encoding(lambda: next(lines, b""))
        return raw.decode(encoding).replace("\r\n", "\n").replace("\r", "\n"), None
    except P.TooLarge as e:
        return None, ("PYA1005", str(e))
    except P.Unsafe as e:
        return None, ("PYA1004", str(e))
    except (OSError, SyntaxError, UnicodeError, LookupError) as e:
        return None, ("PYA1002", f"cannot be read: {e}"[:200])


def module_names(path: str, roots: list[str], inferred: bool = True) -> list[str]:
    """Dotted names under which a file can be imported from the source roots; of inferred roots src comes before the tree's own."""
    out = []
    for root in roots if path.endswith(".py") else ():
        base = "" if root in (".", "") else root.strip("/") + "/"
        if not path.startswith(base) or (inferred and root == "." and "src" in roots and path.startswith("src/")):
            continue
        parts = path[len(base) :].rsplit(".", 1)[0].split("/")
        if parts[-1] == "__init__":
            parts = parts[:-1]
        if parts and all(p.isidentifier() for p in parts):
            out.append(".".join(parts))
    return out


def link_names(path: str, roots: list[str], inferred: bool = True) -> list[str]:
    """Names that a link to a directory may stand for; * where it hides a source root."""
    if inferred:
        parts = path.split("/")
        if parts == ["src"]:
            return ["*"]
        parts = parts[1:] if parts[0] == "src" else parts
        return [".".join(parts)] if all(p.isidentifier() for p in parts) else []
    out = []
    for root in roots:
        root = "" if root in (".", "") else root.strip("/")
        if root == path or root.startswith(path + "/"):
            out.append("*")
        elif not root or path.startswith(root + "/"):
            parts = (path[len(root) + 1 :] if root else path).split("/")
            out += [".".join(parts)] if all(p.isidentifier() for p in parts) else []
    return sorted(set(out))


def project_modules(found: Discovered, roots: list[str], inferred: bool = True) -> dict[str, list[str]]:
    """Top-level local names -> paths that provide them; * for links that could provide any."""
    out: dict[str, set[str]] = {}
    named = [(p, module_names(p, roots, inferred)) for p in [*found.files, *(p for p, *_ in found.issues if p not in found.links)]]
    for path, names in [*named, *((link, link_names(link, roots, inferred)) for link in found.links)]:
        for name in names:
            out.setdefault(name.partition(".")[0], set()).add(path)
    return {k: sorted(v) for k, v in out.items()}

"""Project configuration, policy resolution, and baselines."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field

from driftgauge.sources import paths as P
from driftgauge.sources.registry import Registry, RegistryError, minor

MAX_BASELINE_BYTES = 64 << 20
KEYS = ("baseline-python", "horizon-python", "source-roots", "include", "exclude", "respect-gitignore", "minimum-confidence", "fail-on", "show-unscheduled", "allow-incomplete", "max-file-size-bytes", "per-file-ignores")


class ConfigurationError(ValueError):
    pass


@dataclass
class Config:
    baseline: int = 11
    horizon: int = 15
    provenance: dict = field(default_factory=dict)
    requires_python: str | None = None
    source_roots: list[str] = field(default_factory=lambda: [".", "src"])
    roots_provenance: str = "inferred:conventional-root-and-src-layout"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    minimum_confidence: str = "high"
    fail_on: str = "breaking"
    fail_new_only: bool = False
    show_unscheduled: bool = True
    show_suppressed: bool = False
    allow_incomplete: bool = False
    max_file_size_bytes: int = 2 << 20
    per_file_ignores: dict = field(default_factory=dict)

    @property
    def versions(self) -> list[int]:
        return list(range(self.baseline, self.horizon + 1))


def _table(root: str, path: str | None) -> dict:
    full = os.path.join(root, path or "pyproject.toml")
    if not os.path.isfile(full):
        if path:
            raise ConfigurationError(f"{path}: no such file")
        return {}
    try:
        with open(full, "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigurationError(f"{full}: {e}") from e


def infer_baseline(spec: str, window: tuple[int, ...]) -> int | None:
    """The lowest minor of which any patch meets a Requires-Python declaration."""
    from packaging.specifiers import InvalidSpecifier, SpecifierSet

    try:
        s = SpecifierSet(spec)
    except InvalidSpecifier as e:
        raise ConfigurationError(f"invalid requires-python: {e}") from e
    patches = {0, 1, 999_999}
    for m in re.finditer(r"3\.\d+\.(\d+)", spec):
        patches |= {max(0, int(m[1]) + d) for d in (-1, 0, 1)}
    return next((v for v in window if any(s.contains(f"3.{v}.{p}") for p in sorted(patches))), None)


def resolve(root: str, registry: Registry, path: str | None = None, **over) -> Config:
    """Command line over project over inferred or default; per-file ignores of both are merged."""
    doc = _table(root, path)
    own = doc.get("tool", {}).get("driftgauge", {})
    if not isinstance(own, dict) or set(own) - set(KEYS):
        raise ConfigurationError(f"unknown configuration: {sorted(set(own) - set(KEYS)) if isinstance(own, dict) else own}")
    c = Config()
    kinds = {"source-roots": list, "include": list, "exclude": list, "respect-gitignore": bool, "show-unscheduled": bool, "allow-incomplete": bool, "max-file-size-bytes": int, "per-file-ignores": dict, "minimum-confidence": str, "fail-on": str, "baseline-python": str, "horizon-python": str}
    for key, value in own.items():
        if type(value) is not kinds[key]:
            raise ConfigurationError(f"{key}: expected {kinds[key].__name__}")
    for key in KEYS[2:11]:
        name = key.replace("-", "_")
        if over.get(name) is not None:
            setattr(c, name, over[name])
        elif key in own:
            setattr(c, name, own[key])
    if over.get("source_roots") is not None or "source-roots" in own:
        c.roots_provenance = "command-line" if over.get("source_roots") is not None else "project-config"
    c.per_file_ignores = dict(own.get("per-file-ignores", {}))
    for pattern, ids in (over.get("per_file_ignores") or {}).items():
        c.per_file_ignores[pattern] = list(dict.fromkeys([*c.per_file_ignores.get(pattern, []), *ids]))
    for name in ("fail_new_only", "show_suppressed"):
        if over.get(name) is not None:
            setattr(c, name, over[name])
    if c.minimum_confidence not in ("high", "medium") or c.fail_on not in ("never", "breaking", "risk", "deprecated", "any") or c.max_file_size_bytes <= 0:
        raise ConfigurationError("minimum-confidence, fail-on or max-file-size-bytes has no valid value")
    c.requires_python = doc.get("project", {}).get("requires-python")
    try:
        for name, key in (("baseline", "baseline-python"), ("horizon", "horizon-python")):
            if over.get(name) is not None:
                setattr(c, name, minor(over[name]))
                c.provenance[key] = "command-line"
            elif key in own:
                setattr(c, name, minor(own[key]))
                c.provenance[key] = "project-config"
            elif name == "baseline":
                if not c.requires_python or (v := infer_baseline(c.requires_python, registry.window)) is None:
                    raise ConfigurationError("no baseline: give one, or declare requires-python")
                c.baseline, c.provenance[key] = v, "inferred:requires-python"
            else:
                c.horizon, c.provenance[key] = registry.horizon, "default:newest-release"
    except RegistryError as e:
        raise ConfigurationError(str(e)) from e
    if c.horizon < c.baseline or c.baseline not in registry.window or c.horizon not in registry.window:
        raise ConfigurationError(f"3.{c.baseline} through 3.{c.horizon} is not a window of the registry")
    return c


def project_root(start: str | None) -> str:
    """The given root, else the nearest directory with pyproject.toml, else with .git, else here."""
    if start:
        return os.path.realpath(start)
    here = os.path.realpath(os.getcwd())
    for mark in ("pyproject.toml", ".git"):
        at = here
        while True:
            if os.path.exists(os.path.join(at, mark)):
                return at
            if at == os.path.dirname(at):
                break
            at = os.path.dirname(at)
    return here


def load_baseline(path: str, root: str | None = None) -> list[str]:
    """Fingerprints of a baseline document; repeated members and unknown fields are errors. With a root, the file lies beneath it, and
    no link leads to it."""

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ConfigurationError(f"{path}: a member is repeated")
        return dict(pairs)

    full = os.path.normpath(os.path.join(root or os.getcwd(), path))
    base = os.path.realpath(root) if root else os.path.dirname(full)
    if root and not full.startswith(base + os.sep):
        full = os.path.join(os.path.realpath(os.path.dirname(full)), os.path.basename(full))
    try:
        if not full.startswith(os.path.join(base, "")):
            raise P.Unsafe("outside the root")
        doc = json.loads(P.read(base, os.path.relpath(full, base), MAX_BASELINE_BYTES).decode("utf-8"), object_pairs_hook=unique)
    except (OSError, ValueError) as e:
        if isinstance(e, ConfigurationError):
            raise
        raise ConfigurationError(f"{path}: {e}") from e
    if not isinstance(doc, dict) or set(doc) != {"schema_version", "created_by", "registry_revision", "findings"} or doc["schema_version"] != 1 or not isinstance(doc["findings"], list):
        raise ConfigurationError(f"{path}: not a baseline of version 1")
    out = []
    for f in doc["findings"]:
        if not isinstance(f, dict) or set(f) != {"fingerprint", "rule_id", "path", "subject"} or not re.fullmatch(r"[0-9a-f]{64}", str(f["fingerprint"])) or str(f["path"]).startswith("/") or ".." in str(f["path"]).split("/"):
            raise ConfigurationError(f"{path}: a finding is malformed")
        out.append(f["fingerprint"])
    if len(set(out)) != len(out):
        raise ConfigurationError(f"{path}: a fingerprint is repeated")
    return out

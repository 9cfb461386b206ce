"""Command line: check, explain, baseline create, registry validate/list/coverage, version. Exit codes 0 to 4."""

from __future__ import annotations

import argparse
import sys
import traceback
from collections import Counter

from driftgauge import report
from driftgauge.sources import config as C
from driftgauge.sources import discovery as D
from driftgauge.sources import registry as R
from driftgauge.sources import schema


def coverage(registry: R.Registry) -> str:
    """Sources, dispositions, covered rules and keys without an entry."""
    out, total, covered = [], Counter(), set()
    for name, doc in sorted(registry.coverage.items()):
        entries = doc.get("entries", [])
        total.update(e["disposition"] for e in entries)
        covered |= {r for e in entries if e["disposition"] in ("implemented", "partial") for r in e.get("rules", ())}
        missing = set(doc.get("source_keys", ())) - {e["source_key"] for e in entries}
        out.append(f"{name}: {len(entries)} entries, {len(missing)} unclassified")
    out += [f"{k}: {total[k]}" for k in schema.DISPOSITIONS]
    out.append(f"covered rules: {len(covered)}")
    return "\n".join(out) + "\n"


def listing(registry: R.Registry) -> str:
    return "".join(f"{r.id}  {','.join(sorted({m.kind for m in r.matchers}))}  {r.title}\n" for r in sorted(registry.rules, key=lambda r: r.id))


def predicates(m: R.Matcher) -> str:
    """What a matcher asks of a use, beside its name."""
    out = [f"confidence {m.confidence}"] if m.confidence != "high" else []
    out += [f"as {' or '.join(m.contexts)}"] if m.contexts else []
    for what, low, high in (("positional", m.min_pos, m.max_pos), ("keyword", m.min_kw, m.max_kw)):
        if low is not None or high is not None:
            out.append(f"{low if low is not None else 0} to {high if high is not None else 'any'} {what} arguments")
    out += [f"with {k}" for k in m.required] + [f"without {k}" for k in m.forbidden]
    out += [f"{keyword if position is None else f'argument {position}'} is the {kind} {value}" for position, keyword, kind, value in m.literals]
    return f" ({'; '.join(out)})" if out else ""


def explain(rule: R.Rule) -> str:
    out = [f"{rule.id}: {rule.title}", f"Subject: {rule.subject_kind} {rule.subject}", "Timeline:"]
    out += [f"  3.{v} {event} ({certainty}; {source}) -> {impact}" for event, v, certainty, source, impact in rule.events]
    out += [f"Contexts: {', '.join(rule.contexts)}", "Matchers:", *[f"  {m.kind} {m.name}{predicates(m)}" for m in rule.matchers], f"Remediation: {rule.remediation}", "Sources:", *[f"  {i}: {t} {u}" for i, t, u in rule.sources]]
    return "\n".join([*out, *([f"Aliases: {', '.join(rule.aliases)}"] if rule.aliases else []), *([f"Tags: {', '.join(rule.tags)}"] if rule.tags else [])]) + "\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftgauge")
    p.add_argument("--version", action="version", version=f"{report.TOOL} {report.VERSION}")
    p.add_argument("--verbose", action="store_true", help="the traceback of an internal error")
    sub = p.add_subparsers(dest="command", required=True)

    def options(q):
        q.add_argument("paths", nargs="*")
        q.add_argument("--root")
        q.add_argument("--registry")
        q.add_argument("--config")
        q.add_argument("--baseline-python", dest="baseline")
        q.add_argument("--horizon-python", dest="horizon")
        q.add_argument("--minimum-confidence", choices=("high", "medium"))
        q.add_argument("--fail-on", choices=("never", "breaking", "risk", "deprecated", "any"))
        q.add_argument("--include", action="append")
        q.add_argument("--exclude", action="append")
        q.add_argument("--source-root", action="append", dest="source_roots")
        q.add_argument("--per-file-ignore", action="append", default=[], metavar="PATTERN=RULE,...")
        q.add_argument("--no-gitignore", action="store_const", const=False, dest="respect_gitignore")
        q.add_argument("--hide-unscheduled", action="store_const", const=False, dest="show_unscheduled")
        q.add_argument("--show-suppressed", action="store_const", const=True)
        q.add_argument("--allow-incomplete", action="store_const", const=True)
        q.add_argument("--max-file-size-bytes", "--max-file-size", type=int, dest="max_file_size_bytes")
        q.add_argument("--output")

    check = sub.add_parser("check")
    options(check)
    check.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    check.add_argument("--quiet", action="store_true")
    check.add_argument("--baseline-file")
    check.add_argument("--fail-new-only", action="store_const", const=True)
    base = sub.add_parser("baseline").add_subparsers(dest="action", required=True).add_parser("create")
    options(base)
    one = sub.add_parser("explain")
    one.add_argument("rule")
    one.add_argument("--registry")
    reg = sub.add_parser("registry")
    reg.add_argument("action", choices=("validate", "list", "coverage", "schema"))
    reg.add_argument("--document", choices=tuple(schema.DOCUMENTS), default="rule")
    reg.add_argument("--registry")
    sub.add_parser("version")
    return p


def run(args, spark=None):
    """(exit code, what is to be printed: a text, or the parts of one)."""
    if args.command == "version":
        return 0, f"{report.TOOL} {report.VERSION}\n"
    if args.command == "registry" and args.action == "schema":
        return 0, report.dumps(schema.document(args.document))
    if args.command in ("registry", "explain"):
        registry = R.load(args.registry)
        if args.command == "explain":
            rule = registry.find(args.rule)
            if rule is None:
                raise C.ConfigurationError(f"unknown rule {args.rule}")
            return 0, explain(rule)
        return 0, {"list": listing, "coverage": coverage, "validate": lambda r: f"{len(r.rules)} rules are valid ({r.revision[:12]})\n"}[args.action](registry)
    from driftgauge.plans.scan import scan
    from driftgauge.session import session

    ignores = {}
    for item in args.per_file_ignore:
        pattern, _, ids = item.rpartition("=" if "=" in item else ":")
        if not pattern or not ids:
            raise C.ConfigurationError(f"not PATTERN=RULE: {item}")
        ignores.setdefault(pattern, []).extend(x.strip() for x in ids.split(",") if x.strip())
    names = ("baseline", "horizon", "minimum_confidence", "fail_on", "include", "exclude", "source_roots", "respect_gitignore", "show_unscheduled", "show_suppressed", "allow_incomplete", "max_file_size_bytes", "fail_new_only")
    over = {n: getattr(args, n, None) for n in names} | {"per_file_ignores": ignores}
    spark = spark or session(**{"spark.sql.shuffle.partitions": "8"})
    done = scan(spark, args.root, args.paths or None, args.registry, args.config, getattr(args, "baseline_file", None), **over)
    done.keep()
    out = getattr(args, "output", None)
    root = done.root
    try:
        if args.command == "baseline":
            if done.incomplete() and not done.config.allow_incomplete:
                return 3, ""
            if out:
                report.write(done, "baseline", out, root)
            return 0, "" if out else report.parts(done, "baseline")
        code = done.summary().first().exit_code
        if args.quiet and args.format == "text":
            return code, report.quiet(done)
        if out:
            report.write(done, args.format, out, root)
            return code, ""
        return code, report.parts(done, args.format)
    finally:
        if out:
            done.release()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        code, out = run(args, spark)
        if getattr(args, "output", None) and isinstance(out, str) and out:
            report.write_atomic(args.output, out)
        else:
            for part in [out] if isinstance(out, str) else out:
                sys.stdout.write(part if isinstance(part, str) else part.decode("utf-8"))
        return code
    except (C.ConfigurationError, R.RegistryError, D.DiscoveryError, OSError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 2
    except Exception as e:  # noqa: BLE001
        sys.stderr.write(f"PYA9000 internal error: {e}\n")
        if args.verbose:
            traceback.print_exc()
        return 4


if __name__ == "__main__":
    sys.exit(main())

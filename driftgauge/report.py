"""Deterministic reports of a scan: text, JSON, SARIF, baseline.

A report is a frame: what stands before, between and after its lists is built on the driver from counts alone, and the items of each
list are put in order by Spark's range partitions and rendered there. parts() streams them, one partition at a time, so that
no list is ever whole on the driver; write() takes them to a file. text(), document(), sarif() and baseline() give the same from
collect(), for a scan of few findings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.findings import ordered
from driftgauge.plans.scan import Scan
from driftgauge.sources import output

TOOL, VERSION = "driftgauge", "0.1.0a1"
ORDER = ("breaking", "risk", "deprecated", "informational")
SINGLE = {"imported_module", "resolution", "syntax", "reference_context", "positional_count", "dynamic_function", "pattern", "qualified_name", "guard_granularity", "reachability"}
LEVELS = {"breaking": "error", "risk": "warning", "deprecated": "warning", "informational": "note"}
#: Bytes of rendered text that a task gathers in one row.
CHUNK = 1 << 20

# The words of the text report, which its readers' tools look for.
NOUNS = {"breaking": "upgrade blocker", "deprecated": "deprecation debt item", "informational": "informational finding", "risk": "compatibility risk"}
MIXED, FINDING, FILE = "compatibility finding", "finding", "file"
POLICY, REGISTRY, PROVENANCE = "Policy: Python {} through {}", "Registry: {} ({})", "Policy provenance: baseline={}; horizon={}"
HEADING, FIRST = "Python {} — {}", "  {}  {}:{}:{}  {} ({}; {} confidence{})"
EXISTING, SUPPRESSED = "baseline existing", "suppressed {}"
EVIDENCE, TARGETS, CONTEXTS, STATES, TIMELINE = "    Match evidence: {}", "    Reachable targets: {}", "    Usage contexts: {}", "    States: {}", "    Timeline: {}"
UNSCHEDULED, GUIDANCE, REASON, PATTERN, SOURCE = "    Removal schedule: unscheduled (no authoritative removal event)", "    Guidance: {}", "    Suppression reason: {}", "    Suppression pattern: {}", "    Source: {} — {}"
NOTHING = ["No known compatibility findings for this registry and policy.", "This is not proof of compatibility.", ""]
DIAGNOSTICS, INFERENCES, DIAGNOSTIC, INFERENCE = "Diagnostics:", "Analysis inferences:", "  {}{}: {}", "    Evidence: {}"
RESULT, HIDDEN = "Result: {} ({}); {} analyzed; {} incomplete{}.", "; {} suppressed"


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}" + ("" if n == 1 else "s")


def v3(v: int) -> str:
    return f"3.{v}"


def evidence(e) -> dict:
    return {k: (v[0] if k in SINGLE else list(v)) for k, v in sorted(dict(e).items())}


def region(f: dict) -> dict:
    return {"start": {"line": f["sl"], "column": f["sc"]}, "end": {"line": f["el"], "column": f["ec"]}}


def location(f: dict) -> dict | None:
    return {"path": f["path"], "region": region(f)} if f.get("path") and f.get("sl") else None


def dumps(doc) -> str:
    return json.dumps(doc, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def semver(v: str) -> str:
    return re.sub(r"(?<=\d)(a|b|rc)(\d+)$", lambda m: f"-{ {'a': 'alpha', 'b': 'beta', 'rc': 'rc'}[m[1]] }.{m[2]}", v)


# --- one item -------------------------------------------------------------------------------------


def said(e) -> str:
    return "; ".join(f"{k}={v if isinstance(v, str) else '[' + ', '.join(v) + ']'}" for k, v in evidence(e).items())


def finding_text(f: dict, sources: dict) -> str:
    span = "; ".join(f"{s['state']} on {v3(s['from'])}" + (f" through {v3(s['through'])}" if s["through"] != s["from"] else "") for s in f["states"])
    own = f["suppression"] or {}
    notes = [EXISTING] * (f["baseline_status"] == "existing") + ([SUPPRESSED.format(own["kind"])] if own else [])
    out = [FIRST.format(f["rule_id"], f["path"], f["sl"], f["sc"], f["subject"], f["impact"], f["confidence"], "".join(f"; {n}" for n in notes)), f"    {f['title']}"]
    out += [EVIDENCE.format(said(f["evidence"])), TARGETS.format(", ".join(map(v3, f["reachable"]))), CONTEXTS.format(", ".join(f["usage_contexts"])), STATES.format(span)]
    out.append(TIMELINE.format("; ".join(f"{e['event']} in {v3(e['py'])} ({e['certainty']})" for e in f["timeline"])))
    out += [UNSCHEDULED] * bool(f["removal_unscheduled"]) + [GUIDANCE.format(f["remediation"])]
    out += [line.format(own[k]) for k, line in (("reason", REASON), ("pattern", PATTERN)) if own.get(k)]
    out += [SOURCE.format(t, u) for _, t, u in sources[f["rule_id"]]]
    return "\n".join([*out, "", ""])


def diagnostic_text(d: dict) -> str:
    return DIAGNOSTIC.format(d["code"], f" {d['path']}:{d['sl']}:{d['sc']}" if d["path"] and d["sl"] else f" {d['path']}" if d["path"] else "", d["message"]) + "\n"


def inference_text(i: dict) -> str:
    return diagnostic_text(i) + INFERENCE.format(said(i["evidence"])) + "\n"


def finding_document(f: dict, sources: dict, revision: str) -> dict:
    own = {k: v for k, v in (f["suppression"] or {}).items() if v is not None}
    return {
        "action_version": v3(f["action_version"]), "baseline_status": f["baseline_status"], "enclosing_scope": f["scope"], "fingerprint": f["fingerprint"], "impact": f["impact"], "location": location(f),
        "match": {"confidence": f["confidence"], "evidence": evidence(f["evidence"]), "kind": f["kind"]}, "reachable_versions": list(map(v3, f["reachable"])), "registry_revision": revision,
        "remediation": {"summary": f["remediation"]}, "removal_unscheduled": f["removal_unscheduled"], "rule_id": f["rule_id"], "sources": [dict(zip(("id", "title", "url"), x, strict=True)) for x in sources[f["rule_id"]]],
        "states": [{"from": v3(x["from"]), "through": v3(x["through"]), "state": x["state"]} for x in f["states"]], "subject": f["subject"], "suppressed": bool(own), **({"suppression": own} if own else {}),
        "timeline": [{"certainty": e["certainty"], "event": e["event"], "python": v3(e["py"]), "source": e["source"]} for e in f["timeline"]], "title": f["title"], "usage_contexts": list(f["usage_contexts"]),
    }


def place(f: dict) -> list[dict]:
    if not (f.get("path") and f.get("sl")):
        return []
    where = {"startLine": f["sl"], "startColumn": f["sc"], "endLine": f["el"], "endColumn": f["ec"]}
    return [{"physicalLocation": {"artifactLocation": {"uri": quote(f["path"], safe="/-._~"), "uriBaseId": "%SRCROOT%"}, "region": where}}]


def result(f: dict, index: dict[str, int]) -> dict:
    own = f["suppression"]
    out = {"ruleId": f["rule_id"], "ruleIndex": index[f["rule_id"]], "level": LEVELS[f["impact"]], "message": {"text": f"{f['title']}: {f['remediation']}"}, "locations": place(f), "partialFingerprints": {f"{TOOL}/v1": f["fingerprint"]}, "baselineState": {"new": "new", "existing": "unchanged"}[f["baseline_status"]]}
    out["properties"] = {"actionVersion": v3(f["action_version"]), "confidence": f["confidence"], "evidence": evidence(f["evidence"]), "impact": f["impact"], "reachableVersions": list(map(v3, f["reachable"])), "subject": f["subject"]}
    if own:
        why = own["reason"] or own["pattern"]
        out["suppressions"] = [{"kind": "inSource" if own["kind"] == "inline" else "external", **({"justification": why} if why else {})}]
    return out


def notification(d: dict, index: dict[str, int]) -> dict:
    level = "error" if d["code"].startswith("PYA1") else "note" if "kind" in d else "warning"
    more = {"properties": {"evidence": evidence(d["evidence"]), "kind": d["kind"]}} if "kind" in d else {}
    return {"descriptor": {"id": d["code"], "index": index[d["code"]]}, "level": level, "message": {"text": d["message"]}, **({"locations": x} if (x := place(d)) else {}), **more}


def baseline_entry(f: dict) -> dict:
    return {k: f[k] for k in ("fingerprint", "rule_id", "path", "subject")}


# --- what stands around the lists ---------------------------------------------------------------------


def in_order(scan: Scan) -> dict[str, DataFrame]:
    """The lists of a report, each in its order."""
    seen = scan.findings if scan.config.show_suppressed else scan.findings.where("suppression is null")
    return {
        "findings": ordered(seen), "inferences": scan.inferences.orderBy("path", "sl", "sc", "code", "kind", "message"),
        "diagnostics": scan.diagnostics.orderBy(F.coalesce("path", F.lit("")), "code", "message", "sl", "sc"),
    }


def totals(scan: Scan) -> dict:
    """Counts, and what is as small as the registry: nothing here grows with the findings."""
    scan.keep()
    lists = in_order(scan)
    discovered = max(scan.discovered, scan.parsed.count() + scan.skipped)
    bad = scan.incomplete()
    groups = lists["findings"].groupBy("action_version").agg(F.count("*").alias("n"), F.collect_set("impact").alias("impacts")).orderBy("action_version").collect()
    rules = sorted(r.rule_id for r in lists["findings"].select("rule_id").distinct().collect())
    first = {}  # of each code the first message; codes are few
    for name, order in (("inferences", ("path", "sl", "sc", "code", "kind", "message")), ("diagnostics", ("p", "message"))):
        rows = lists[name].withColumn("p", F.coalesce("path", F.lit("")))
        first |= {r.code: r.first.message for r in rows.groupBy("code").agg(F.min(F.struct(*order, *(["message"] if "message" not in order else []))).alias("first")).collect()}
    return {
        "lists": lists, "discovered": discovered, "incomplete": bad, "analyzed": discovered - bad, "summary": scan.summary().first().asDict(), "rules": rules, "codes": first,
        "groups": {r.action_version: (r.n, sorted(r.impacts)) for r in groups}, "n": {"findings": sum(r.n for r in groups), **{k: lists[k].count() for k in ("inferences", "diagnostics")}},
    }


def collect(scan: Scan) -> dict:
    """The parts of a report with its lists, for a scan of few findings."""
    t = totals(scan)
    return t | {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in t["lists"].items()}


def sources_of(scan: Scan) -> dict:
    return {r.id: r.sources for r in scan.registry.rules}


def heading(version: int, n: int, impacts: list[str]) -> str:
    return HEADING.format(v3(version), plural(n, NOUNS[impacts[0]] if len(impacts) == 1 else MIXED)) + "\n"


def preamble(scan: Scan) -> str:
    c = scan.config
    out = [f"{TOOL} {VERSION}", POLICY.format(v3(c.baseline), v3(c.horizon)), REGISTRY.format(scan.registry.release, scan.registry.revision[:12])]
    if any(v != "command-line" for v in c.provenance.values()):
        out.append(PROVENANCE.format(c.provenance.get("baseline-python"), c.provenance.get("horizon-python")))
    return "\n".join([*out, "", ""])


def closing(t: dict) -> str:
    s = t["summary"]
    impacts = ", ".join(f"{s[i]} {i}" for i in ORDER if s[i]) or "none"
    hidden = HIDDEN.format(plural(s["suppressed"], FINDING)) if s["suppressed"] else ""
    return RESULT.format(plural(sum(s[i] for i in ORDER), FINDING), impacts, plural(t["analyzed"], FILE), plural(t["incomplete"], FILE), hidden) + "\n"


def quiet(scan: Scan) -> str:
    """The text report's last line."""
    s, discovered, bad = scan.summary().first().asDict(), max(scan.discovered, scan.parsed.count() + scan.skipped), scan.incomplete()
    return closing({"summary": s, "analyzed": discovered - bad, "incomplete": bad})


def frame_document(scan: Scan, t: dict, findings, inferences, diagnostics) -> dict:
    c, s = scan.config, t["summary"]
    return {
        "configuration": {"allow_incomplete": c.allow_incomplete, "exclude": list(c.exclude), "fail_new_only": c.fail_new_only, "fail_on": c.fail_on, "include": list(c.include), "max_file_size_bytes": c.max_file_size_bytes, "minimum_confidence": c.minimum_confidence, "per_file_ignores": c.per_file_ignores, "respect_gitignore": c.respect_gitignore, "show_suppressed": c.show_suppressed, "show_unscheduled": c.show_unscheduled, "source_roots": list(c.source_roots), "source_roots_provenance": c.roots_provenance},
        "diagnostics": diagnostics, "findings": findings, "inferences": inferences,
        "gate": {"fail_on": c.fail_on, "failed": s["gate_failed"], "new_only": c.fail_new_only},
        "policy": {"baseline_python": v3(c.baseline), "horizon_python": v3(c.horizon), "provenance": {k.replace("-", "_"): v for k, v in c.provenance.items()}, "versions": list(map(v3, c.versions))},
        "registry": {"release": scan.registry.release, "revision": scan.registry.revision},
        "scan": {"files_analyzed": t["analyzed"], "files_discovered": t["discovered"], "files_incomplete": t["incomplete"], "root": "."},
        "schema_version": 1, "summary": {k: s[k] for k in (*ORDER, "new", "suppressed")}, "tool": {"name": TOOL, "version": VERSION},
    }


def frame_sarif(scan: Scan, t: dict, results, notes) -> dict:
    rules = [{"id": r.id, "shortDescription": {"text": r.title}, "help": {"text": r.remediation}, "properties": {"contexts": list(r.contexts), "subject": r.subject, "tags": list(r.tags)}, **({"helpUri": r.sources[0][2]} if r.sources else {})} for r in map(scan.registry.find, t["rules"])]
    driver = {"name": TOOL, "version": VERSION, "semanticVersion": semver(VERSION), "rules": rules, "notifications": [{"id": c, "shortDescription": {"text": t["codes"][c]}} for c in sorted(t["codes"])]}
    whole = t["incomplete"] == 0
    ran = {"executionSuccessful": whole or scan.config.allow_incomplete, "properties": {"filesAnalyzed": t["analyzed"], "filesDiscovered": t["discovered"], "filesIncomplete": t["incomplete"], "scanComplete": whole}, "toolExecutionNotifications": notes}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "columnKind": "unicodeCodePoints", "results": results, "invocations": [ran]}]}


def frame_baseline(scan: Scan, findings) -> dict:
    return {"schema_version": 1, "created_by": f"{TOOL} {VERSION}", "registry_revision": scan.registry.revision, "findings": findings}


# --- small reports --------------------------------------------------------------------------------


def text(scan: Scan, parts: dict | None = None) -> str:
    p, sources = parts or collect(scan), sources_of(scan)
    out, last = [preamble(scan)], None
    for f in p["findings"]:
        if f["action_version"] != last:
            last = f["action_version"]
            out.append(heading(last, *p["groups"][last]))
        out.append(finding_text(f, sources))
    out += [] if p["findings"] else ["\n".join(NOTHING) + "\n"]
    for title, rows, one in ((DIAGNOSTICS, p["diagnostics"], diagnostic_text), (INFERENCES, p["inferences"], inference_text)):
        out += [title + "\n", *map(one, rows), "\n"] if rows else []
    return "".join(out) + closing(p)


def document(scan: Scan, parts: dict | None = None) -> dict:
    p, sources, revision = parts or collect(scan), sources_of(scan), scan.registry.revision
    return frame_document(scan, p, [finding_document(f, sources, revision) for f in p["findings"]], [inference_document(i) for i in p["inferences"]], [diagnostic_document(d) for d in p["diagnostics"]])


def diagnostic_document(d: dict) -> dict:
    return {"code": d["code"], "message": d["message"], "location": location(d)}


def inference_document(i: dict) -> dict:
    return {**diagnostic_document(i), "kind": i["kind"], "evidence": evidence(i["evidence"])}


def indexes(t: dict) -> tuple[dict[str, int], dict[str, int]]:
    return {r: i for i, r in enumerate(t["rules"])}, {c: i for i, c in enumerate(sorted(t["codes"]))}


def sarif(scan: Scan, parts: dict | None = None) -> dict:
    p = parts or collect(scan)
    rules, codes = indexes(p)
    return frame_sarif(scan, p, [result(f, rules) for f in p["findings"]], [notification(d, codes) for d in (*p["diagnostics"], *p["inferences"])])


def recorded(scan: Scan) -> DataFrame:
    """The findings of a baseline document, in its order."""
    return scan.findings.where("suppression is null").select("fingerprint", "rule_id", "path", "subject").orderBy("fingerprint", "path", "rule_id", "subject")


def baseline(scan: Scan) -> dict:
    return frame_baseline(scan, [r.asDict() for r in recorded(scan).collect()])


# --- reports of any size ----------------------------------------------------------------------------


def rendered(rows: DataFrame, one: Callable[[dict], str], before: str = "", indent: int = 0) -> DataFrame:
    """(chunk) of the rows' texts in the rows' order, some bytes in a row. With an indent each text is an element of a JSON list of that
    depth, before it what parts it from the one before."""
    import pyarrow as pa

    names, pad = rows.columns, " " * indent

    def run(frames):
        held, size = [], 0
        for batch in frames:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    text = one(r)
                    text = (before + pad + text.rstrip("\n").replace("\n", "\n" + pad) if indent else text).encode("utf-8", "surrogatepass")
                    held.append(text)
                    size += len(text)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    return rows.select(*names).mapInArrow(run, "chunk binary")


def stream(chunks: DataFrame, skip: int = 0) -> Iterator[bytes]:
    """The chunks in order, one partition on the driver at a time; the first bytes are left out."""
    for r in chunks.toLocalIterator():
        yield bytes(r.chunk[skip:])
        skip = 0


def filled(doc: dict, slots: dict[str, list[tuple[DataFrame, Callable]]]) -> Iterator[bytes]:
    """A JSON document whose lists come from frames: doc has the slots' names in place of them."""
    rest = dumps(doc)
    for name in sorted(slots, key=lambda n: rest.index(json.dumps(n))):
        before, _, rest = rest.partition(json.dumps(name))
        yield before.encode()
        line = before.rpartition("\n")[2]
        depth, some = len(line) - len(line.lstrip()) + 2, False
        for rows, one in slots[name]:
            for chunk in stream(rendered(rows, lambda r, one=one: dumps(one(r)), ",\n", depth), 0 if some else 2):
                yield chunk if some else b"[\n" + chunk
                some = True
        yield b"\n" + b" " * (depth - 2) + b"]" if some else b"[]"
    yield rest.encode()


def text_parts(scan: Scan, t: dict) -> Iterator[bytes]:
    sources, groups = sources_of(scan), t["groups"]
    yield preamble(scan).encode()
    # headings are rows that come before all others of their version
    rows = t["lists"]["findings"]
    heads = scan.parsed.sparkSession.createDataFrame([(v,) for v in groups], "action_version int").select(*[F.col("action_version") if f.name == "action_version" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    both = ordered(rows.unionByName(heads))  # nulls come first
    yield from stream(rendered(both, lambda f: heading(f["action_version"], *groups[f["action_version"]]) if f["rule_id"] is None else finding_text(f, sources)))
    if not t["n"]["findings"]:
        yield ("\n".join(NOTHING) + "\n").encode()
    for title, name, one in ((DIAGNOSTICS, "diagnostics", diagnostic_text), (INFERENCES, "inferences", inference_text)):
        if t["n"][name]:
            yield (title + "\n").encode()
            yield from stream(rendered(t["lists"][name], one))
            yield b"\n"
    yield closing(t).encode()


def parts(scan: Scan, kind: str = "text", t: dict | None = None) -> Iterator[bytes]:
    """A report (text, json, sarif or baseline) piece by piece, the same bytes as the small form."""
    if kind == "baseline":
        yield from filled(frame_baseline(scan, "@findings"), {"@findings": [(recorded(scan), baseline_entry)]})
        return
    t = t or totals(scan)
    lists = t["lists"]
    if kind == "text":
        yield from text_parts(scan, t)
    elif kind == "json":
        sources, revision = sources_of(scan), scan.registry.revision
        doc = frame_document(scan, t, "@findings", "@inferences", "@diagnostics")
        yield from filled(doc, {"@findings": [(lists["findings"], lambda f: finding_document(f, sources, revision))], "@inferences": [(lists["inferences"], inference_document)], "@diagnostics": [(lists["diagnostics"], diagnostic_document)]})
    else:
        rules, codes = indexes(t)
        note = lambda d: notification(d, codes)
        yield from filled(frame_sarif(scan, t, "@results", "@notes"), {"@results": [(lists["findings"], lambda f: result(f, rules))], "@notes": [(lists["diagnostics"], note), (lists["inferences"], note)]})


def write(scan: Scan, kind: str, path: str, root: str | None = None) -> None:
    """A report to a file, in one step; with a root the file must lie beneath it."""
    output.write(path, parts(scan, kind), root)


def write_atomic(path: str, content: str, root: str | None = None) -> None:
    output.write(path, [content.encode()], root)

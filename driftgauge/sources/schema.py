"""The closed form of registry documents, as JSON Schema, and a check of documents against it.

One description serves both: `problems` checks the keywords that the description uses, `document`
gives it out for other tools. Unknown keys, values outside a closed set, and fields of another
matcher kind are problems; references between documents are the registry's to check.
"""

from __future__ import annotations

import re

# The closed sets and patterns of the registry form.
IMPACTS = ["deprecated", "risk", "breaking", "informational"]
CONFIDENCES = ["high", "medium", "low"]
CERTAINTIES = ["released", "scheduled", "provisional"]
EVENTS = {"deprecated": "on_deprecation", "removed": "on_removal", "signature_changed": "on_signature_change", "behavior_changed": "on_behavior_change", "syntax_changed": "on_syntax_change", "support_dropped": "on_support_drop"}
STATUSES = ["eol", "security", "stable", "prerelease", "planned"]
DISPOSITIONS = ["implemented", "partial", "not-statically-detectable", "dynamic-evidence-roadmap", "c-api-roadmap", "duplicate", "not-applicable"]
REFERENCES = ["read", "decorator", "base-class", "annotation"]
RULE_ID, SOURCE_ID, TAG = r"[A-Z]{3}[0-9]{4}", r"[a-z0-9][a-z0-9.-]*", r"[a-z0-9][a-z0-9-]*"
DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
MINOR, DAY, URL = r"3\.(?:0|[1-9][0-9]*)", r"[0-9]{4}-(?:[0-9]{2}-[0-9]{2}|[0-9]{2})", r"https://[A-Za-z0-9.-]+(?:/[^\s]*)?"


def text(pattern: str | None = None) -> dict:
    return {"type": "string", "minLength": 1} | ({"pattern": f"^(?:{pattern})$"} if pattern else {})


def one_of(values: list) -> dict:
    return {"enum": values}


def many(item: dict, least: int = 0) -> dict:
    return {"type": "array", "items": item, "minItems": least, "uniqueItems": True}


def record(required: dict, optional: dict | None = None, least: int = 0) -> dict:
    out = {"type": "object", "properties": {**required, **(optional or {})}, "required": list(required), "additionalProperties": False}
    return out | ({"minProperties": least} if least else {})


def kind(name: str, required: dict, optional: dict | None = None, least: int = 0) -> dict:
    return record({"kind": one_of([name]), **required}, optional, least)


COUNT = {"type": "integer", "minimum": 0}
LITERAL = {"type": ["string", "integer", "boolean", "null"]}
ARGUMENT = {"oneOf": [record({"equals": LITERAL, "position": COUNT}), record({"equals": LITERAL, "keyword": text(DOTTED)})]}
SHAPE = {"min_positional_args": COUNT, "max_positional_args": COUNT, "min_keyword_args": COUNT, "max_keyword_args": COUNT, "required_keywords": many(text(DOTTED), 1), "forbidden_keywords": many(text(DOTTED), 1), "literal_arguments": many(ARGUMENT, 1)}
MATCHER = {
    "oneOf": [
        kind("module-import", {"module": text(DOTTED)}),
        kind("literal-dynamic-import", {"module": text(DOTTED)}, {"confidence": one_of(CONFIDENCES)}),
        kind("qualified-reference", {"qualified_name": text(DOTTED)}, {"contexts": many(one_of(REFERENCES), 1)}),
        kind("qualified-call", {"qualified_name": text(DOTTED)}),
        kind("call-shape", {"qualified_name": text(DOTTED)}, SHAPE, 3),
        kind("builtin-pattern", {"pattern": text(TAG)}),
    ]
}
AUTOMATION = {"oneOf": [{"type": "null"}, record({"tool": text(), "rule": text()})]}
RULE = record(
    {
        "schema_version": one_of([1]),
        "id": text(RULE_ID),
        "title": text(),
        "summary": text(),
        "scope": record({"ecosystem": one_of(["python"]), "runtime": one_of(["cpython"]), "contexts": many(one_of(["runtime", "typing"]), 1)}),
        "subject": record({"kind": text(TAG), "name": text()}),
        "timeline": many(record({"event": one_of(list(EVENTS)), "python": text(MINOR), "certainty": one_of(CERTAINTIES), "source": text(SOURCE_ID)}), 1),
        "impact": record({}, {k: one_of(IMPACTS) for k in EVENTS.values()}, 1),
        "matchers": many(MATCHER, 1),
        "remediation": record({"summary": text()}, {"documentation_url": text(URL), "automation": AUTOMATION}),
        "sources": many(record({"id": text(SOURCE_ID), "title": text(), "url": text(URL)}), 1),
        "tags": many(text(TAG)),
    },
    {"aliases": many(text())},
)
INDEX = record({"schema_version": one_of([1]), "release": text(), "rules": many(text(), 1)}, {"coverage": many(text()), "releases": text(), "retired_ids": many(text(RULE_ID))})
RELEASES = record({"schema_version": one_of([1]), "releases": many(record({"python": text(MINOR), "status": one_of(STATUSES)}, {"expected_final_on": text(DAY), "released_on": text(DAY), "source": text(URL)}), 1)})
COVERAGE = record(
    {
        "schema_version": one_of([1]),
        "source": record({"id": text(SOURCE_ID), "title": text(), "url": text(URL), "checked_on": text(DAY)}),
        "source_keys": many(text(), 1),
        "entries": many(record({"source_key": text(), "disposition": one_of(DISPOSITIONS)}, {"rules": many(text(RULE_ID)), "note": text()}), 1),
    }
)
DOCUMENTS = {"rule": RULE, "index": INDEX, "releases": RELEASES, "coverage": COVERAGE}
_TYPES = {"string": str, "integer": int, "boolean": bool, "null": type(None), "array": list, "object": dict}


def _is(value, name: str) -> bool:
    return isinstance(value, _TYPES[name]) and not (name == "integer" and isinstance(value, bool))


def problems(value, shape: dict, at: str = "$") -> list[str]:
    """What of a value is not as described, with the place of each."""
    if "oneOf" in shape:
        tried = [problems(value, s, at) for s in shape["oneOf"]]
        fits = sum(not t for t in tried)
        if fits == 1:
            return []
        if fits:
            return [f"{at}: fits more than one form"]
        kinds = [t for s, t in zip(shape["oneOf"], tried, strict=True) if isinstance(value, dict) and value.get("kind") in s.get("properties", {}).get("kind", {}).get("enum", ())]
        return kinds[0] if kinds else [f"{at}: fits none of its forms"]
    if "enum" in shape:
        return [] if any(value == x and type(value) is type(x) for x in shape["enum"]) else [f"{at}: must be one of {shape['enum']}"]
    types = shape["type"] if isinstance(shape["type"], list) else [shape["type"]]
    if not any(_is(value, t) for t in types):
        return [f"{at}: must be {' or '.join(types)}"]
    if isinstance(value, str):
        if not value.strip() and shape.get("minLength"):
            return [f"{at}: is empty"]
        return [] if "pattern" not in shape or re.search(shape["pattern"].replace("$", r"\Z"), value) else [f"{at}: must match {shape['pattern']}"]
    if isinstance(value, list):
        out = [p for i, x in enumerate(value) for p in problems(x, shape["items"], f"{at}[{i}]")]
        if len(value) < shape.get("minItems", 0):
            out.append(f"{at}: needs {shape['minItems']} or more")
        if shape.get("uniqueItems") and len({repr(x) for x in value}) < len(value):
            out.append(f"{at}: holds one twice")
        return out
    if isinstance(value, dict):
        out = [f"{at}: lacks {k}" for k in shape["required"] if k not in value]
        out += [f"{at}: unknown key {k}" for k in value if k not in shape["properties"]]
        if len(value) < shape.get("minProperties", 0):
            out.append(f"{at}: needs more keys")
        return out + [p for k, x in value.items() if k in shape["properties"] for p in problems(x, shape["properties"][k], f"{at}.{k}")]
    return [f"{at}: below {shape['minimum']}"] if "minimum" in shape and value < shape["minimum"] else []


def document(name: str) -> dict:
    """The JSON Schema of one kind of document."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, **DOCUMENTS[name]}


def rule_problems(rule: dict) -> list[str]:
    """What JSON Schema cannot say of a rule: impacts for just its events, bounds in order, sources once."""
    out = []
    events = [e["event"] for e in rule["timeline"]]
    if {EVENTS[e] for e in events} - set(rule["impact"]):
        out.append("$.impact: lacks an event of the timeline")
    if len({s["id"] for s in rule["sources"]}) < len(rule["sources"]):
        out.append("$.sources: an id twice")
    if any(e in ("removed", "support_dropped") for e in events[:-1]):
        out.append("$.timeline: nothing can follow a removal")
    for i, m in enumerate(rule["matchers"]):
        for low, high in (("min_positional_args", "max_positional_args"), ("min_keyword_args", "max_keyword_args")):
            if low in m and high in m and m[low] > m[high]:
                out.append(f"$.matchers[{i}]: {low} is above {high}")
        if set(m.get("required_keywords", ())) & set(m.get("forbidden_keywords", ())):
            out.append(f"$.matchers[{i}]: a keyword is required and forbidden")
    return out


#: Dispositions whose entries name rules (the others may not), and those whose rules count as covered; all but implemented ones need a note.
RULE_BACKED, COVERING = ("implemented", "partial", "duplicate"), ("implemented", "partial")


def coverage_problems(manifests: dict[str, dict], ids: set[str]) -> list[str]:
    """What operators/integrity.py finds, for a registry that is being loaded; also sources with two manifests."""
    out, covered, seen = [], set(), set()
    for name, doc in manifests.items():
        keys, said = set(doc["source_keys"]), [e["source_key"] for e in doc["entries"]]
        if doc["source"]["id"] in seen:
            out.append(f"{name}: its source has a manifest already")
        seen.add(doc["source"]["id"])
        out += [f"{name}: {k} is not classified" for k in sorted(keys - set(said))]
        out += [f"{name}: {k} is not among the source keys" for k in sorted(set(said) - keys)]
        out += [f"{name}: {k} is classified more than once" for k in sorted({k for k in said if said.count(k) > 1})]
        for e in doc["entries"]:
            rules, kind, about = e.get("rules", ()), e["disposition"], f"{name}: {e['source_key']}"
            out += [f"{about} names unknown rule {r}" for r in sorted(set(rules)) if r not in ids]
            out += [f"{about} names a rule more than once"] * (len(set(rules)) != len(rules))
            if kind in COVERING:
                covered |= set(rules)
            out += [f"{about} names no rule"] * (kind in RULE_BACKED and not rules) + [f"{about} may not name rules"] * (kind not in RULE_BACKED and bool(rules))
            out += [f"{about} needs a note"] * (kind != "implemented" and not (e.get("note") or "").strip())
    return out + ([f"{r}: no source covers it" for r in sorted(ids - covered)] if manifests else [])

"""One source text to syntax facts: imports, references, calls, unary patterns, guards, directives."""

from __future__ import annotations

import ast
import heapq
import io
import re
import tokenize

from driftgauge.pyparse.scopes import BUILTIN, IMPORT, LEAVES, Scopes, Walk, chain, children, resolve

MAX_DEPTH, MAX_OPERATORS, MAX_TREE = 200, 256, 256
TOOL = "driftgauge"
VERSION_INFO, TYPE_CHECKING = "sys.version_info", "typing.TYPE_CHECKING"
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


class TooDeep(ValueError):
    pass


def check_nesting(source: str, tool: str = TOOL) -> list[tokenize.TokenInfo]:
    """Comment tokens where some may be directives; raises TooDeep before a parser would be asked for too much.

    A source without a directive's prefix, and with fewer brackets and operators than the limits, is not tokenized.
    """
    if f"{tool}:" not in source and sum(map(source.count, "([{")) <= MAX_DEPTH and sum(map(source.count, ("+", "-", "~", "*", "not", "await", "lambda"))) <= MAX_OPERATORS:
        return []
    comments, depth, run = [], 0, 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                comments.append(t)
            elif t.type == tokenize.OP:
                if t.string in _OPEN:
                    depth += 1
                    if depth > MAX_DEPTH:
                        raise TooDeep("delimiter nesting exceeds the limit")
                elif t.string in _CLOSE:
                    depth = max(0, depth - 1)
                run = run + 1 if t.string in "+-~**" else 0
            elif t.type == tokenize.NAME:
                run = run + 1 if t.string in ("not", "await", "lambda") else 0
            elif t.type != tokenize.NL:
                run = 0
            if run > MAX_OPERATORS:
                raise TooDeep("operator nesting exceeds the limit")
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass  # comments before the fault still count; parsing reports it
    return comments


def tree_depth(tree: ast.AST) -> int:
    """Levels of a tree, taken level by level; contexts and operators have no fields and count by their parents."""
    depth, level = 0, [tree]
    while level:
        depth, last = depth + 1, level
        level = [n for node in last for n in children(node)]
    return depth + any(LEAVES & set(n._fields) for n in last)


def literal(node: ast.AST) -> tuple[bool, str, str]:
    """(resolved, type, value) of a scalar literal."""
    if isinstance(node, ast.Constant) and not isinstance(node.value, (bytes, complex)) and node.value is not Ellipsis:
        kind = "null" if node.value is None else type(node.value).__name__
        return True, kind, repr(node.value) if kind != "str" else node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
        ok, kind, _ = literal(node.operand)
        if ok and kind in ("int", "float"):
            v = ast.literal_eval(node.operand) if isinstance(node.operand, ast.Constant) else float("nan")
            if v == v:
                return True, kind, repr(-v if isinstance(node.op, ast.USub) else v)
    return False, "", ""


def bits(versions) -> int:
    """A set of minor versions as the bits of a number."""
    return sum({1 << v for v in versions})


def minors(held: int) -> list[int]:
    """The minor versions of such a number, in order."""
    return [v for v in range(held.bit_length()) if held >> v & 1]


# The truth of a guard at one version; Guards keeps that of all versions as two sets, which obey the same tables.
def t_not(x):
    return None if x is None else not x


def t_and(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def t_or(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


class Guards:
    """Three-valued evaluation of version and typing guards, for all versions at once.

    A truth is two sets of versions as bits, those where the guard is true and those where it is false; elsewhere it is unknown. A guard
    is walked once, whatever the number of versions."""

    def __init__(self, scopes: Scopes, blocked: frozenset[str], window: int):
        self.scopes, self.blocked, self.window = scopes, blocked, minors(window)

    def is_name(self, node: ast.AST, name: str) -> bool:
        if isinstance(node, (ast.Call, ast.Subscript)) or resolve(self.scopes, node) != {(name, IMPORT)}:
            return False
        return name == VERSION_INFO or not self.blocked & {"*", name.partition(".")[0]}

    def shape(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Subscript) and self.is_name(node.value, VERSION_INFO):
            s = node.slice
            if isinstance(s, ast.Slice) and s.lower is None and s.step is None and isinstance(s.upper, ast.Constant) and type(s.upper.value) is int:
                return {2: "minor", 3: "patch"}.get(s.upper.value)
            return None
        return "plain" if self.is_name(node, VERSION_INFO) else None

    @staticmethod
    def version(node: ast.AST) -> tuple[tuple[int, int] | None, bool]:
        if not isinstance(node, ast.Tuple) or any(not isinstance(e, ast.Constant) or type(e.value) is not int for e in node.elts):
            return None, False
        v = tuple(e.value for e in node.elts)
        return (v if len(v) == 2 else None), len(v) > 2

    def compare(self, node: ast.Compare) -> tuple[int, int, bool]:
        if len(node.ops) != 1:
            return 0, 0, False
        left, right = self.shape(node.left), self.shape(node.comparators[0])
        patch = "patch" in (left, right)
        if (left is None) == (right is None):
            return 0, 0, patch
        value, long = self.version(node.comparators[0] if left else node.left)
        if patch or long:
            return 0, 0, True
        op = _COMPARE.get(type(node.ops[0]))
        if value is None or op is None:
            return 0, 0, False
        rest = (0,) if (left or right) == "plain" else ()
        met = {v: op((3, v, *rest), value) if left else op(value, (3, v, *rest)) for v in self.window}
        return bits(v for v in met if met[v]), bits(v for v in met if not met[v]), False

    def evaluate(self, node: ast.AST) -> tuple[int, int, bool]:
        """(where it is true, where it is false, whether a patch guard was met)."""
        if isinstance(node, ast.Compare):
            return self.compare(node)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            true, false, patch = self.evaluate(node.operand)
            return false, true, patch
        if isinstance(node, ast.BoolOp):
            true, false, patch = self.evaluate(node.values[0])
            for v in node.values[1:]:
                t, f, p = self.evaluate(v)
                true, false = (true & t, false | f) if isinstance(node.op, ast.And) else (true | t, false & f)
                patch = patch or p
            return true, false, patch
        return 0, 0, False

    def split(self, test: ast.AST, versions: int, contexts: frozenset[str]):
        """((versions, contexts) of the true and of the false branch, whether a patch guard was met)."""
        polarity = None
        if self.is_name(test, TYPE_CHECKING):
            polarity = True
        elif isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not) and self.is_name(test.operand, TYPE_CHECKING):
            polarity = False
        if polarity is not None:
            a, b = ("typing", "runtime") if polarity else ("runtime", "typing")
            return (versions, contexts & {a}), (versions, contexts & {b}), False
        true, false, patch = self.evaluate(test)
        if true | false and any(isinstance(n, (ast.Name, ast.Attribute)) and self.is_name(n, TYPE_CHECKING) for n in ast.walk(test)):
            true = false = 0
        return (versions & ~false, contexts), (versions & ~true, contexts), patch and versions != 0


class Extractor(Walk):
    """Facts of a tree. Places are taken only for what is kept, regions of statements only where directives need them."""

    def __init__(self, source: str, tree: ast.Module, window: int, contexts: frozenset[str], blocked: frozenset[str], places: bool = True):
        self.lines = [x.encode("utf-8") for x in re.split(r"\r\n|\r|\n", source)]
        self.scopes, self.places = Scopes(tree, "global" in source or "nonlocal" in source), places
        self.guards = Guards(self.scopes, blocked, window)
        self.reach, self.ref_ctx, self.seq = (window, contexts), "read", 0
        self.imports, self.refs, self.calls, self.unary, self.patches, self.regions = [], [], [], [], [], []
        self.visit(tree)

    def column(self, line: int, offset: int) -> int:
        return len(self.lines[line - 1][:offset].decode("utf-8", "replace")) + 1 if line <= len(self.lines) else offset + 1

    def region(self, node: ast.AST) -> dict:
        return {"sl": node.lineno, "sc": self.column(node.lineno, node.col_offset), "el": node.end_lineno, "ec": self.column(node.end_lineno, node.end_col_offset)}

    def common(self, node: ast.AST) -> dict:
        self.seq += 1
        scope = self.scopes.of.get(id(node)) or self.scopes.root
        return {"seq": self.seq, **self.region(node), "scope": scope.label, "reach": self.reach[0], "ctx": sorted(self.reach[1])}

    def statement(self, node: ast.stmt) -> None:
        self.regions.append(self.region(node))

    def header(self, node: ast.AST, body: list[ast.stmt]) -> None:
        """The lines of a compound statement before its body."""
        r = self.region(node)
        first = body[0]
        line = min([first.lineno, *[d.lineno for d in getattr(first, "decorator_list", [])]])
        if line == r["sl"]:
            r["el"], r["ec"] = node.end_lineno, 10**6
        else:
            r["el"], r["ec"] = max(r["sl"], self.header_end(node, line)), 10**6
        self.regions.append(r)

    def header_end(self, node: ast.AST, line: int) -> int:
        at = line - 1
        while at > node.lineno and (not self.lines[at - 1].strip() or self.lines[at - 1].lstrip().startswith(b"#")):
            at -= 1
        return at

    def visit(self, node: ast.AST):
        if isinstance(node, ast.stmt):
            was, self.ref_ctx = self.ref_ctx, "read"
            if self.places:
                self.place(node)
            super().visit(node)
            self.ref_ctx = was
            return
        if self.places and isinstance(node, (ast.ExceptHandler, ast.match_case)) and node.body and hasattr(node, "lineno"):
            self.header(node, node.body)
        super().visit(node)

    def place(self, node: ast.stmt) -> None:
        """The regions that a directive within a statement may stand for."""
        bodies = [b for b in (getattr(node, f, None) for f in ("body", "orelse", "finalbody")) if isinstance(b, list) and b]
        if isinstance(node, ast.Match) or bodies:
            if bodies:
                self.header(node, bodies[0])
            self.regions += [self.region(d) for d in getattr(node, "decorator_list", [])]
        else:
            self.statement(node)

    def within(self, ctx: str, *nodes) -> None:
        was = self.ref_ctx
        for n in nodes:
            if n is not None:
                self.ref_ctx = ctx
                self.visit(n)
        self.ref_ctx = was

    def visit_FunctionDef(self, node):  # noqa: N802
        self.within("decorator", *node.decorator_list)
        a = node.args
        for x in [*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg]:
            if x is not None:
                self.within("annotation", x.annotation)
        for d in [*a.defaults, *a.kw_defaults]:
            if d is not None:
                self.visit(d)
        self.within("annotation", node.returns)
        for n in [*getattr(node, "type_params", []), *node.body]:
            self.visit(n)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node):  # noqa: N802
        self.within("decorator", *node.decorator_list)
        self.within("base-class", *node.bases)
        for n in [*node.keywords, *getattr(node, "type_params", []), *node.body]:
            self.visit(n)

    def visit_AnnAssign(self, node):  # noqa: N802
        self.visit(node.target)
        self.within("annotation", node.annotation)
        if node.value:
            self.visit(node.value)

    def visit_If(self, node):  # noqa: N802
        self.visit(node.test)
        yes, no, patch = self.guards.split(node.test, *self.reach)
        if patch:
            self.patches.append({**self.region(node.test), "active": self.reach[0]})
        was = self.reach
        self.reach = yes
        for n in node.body:
            self.visit(n)
        self.reach = no
        for n in node.orelse:
            self.visit(n)
        self.reach = was

    def visit_Import(self, node):  # noqa: N802
        names: dict[str, list[str]] = {}
        for a in node.names:
            own = names.setdefault(a.name, [])
            bound = a.asname or a.name.partition(".")[0]
            if bound not in own:
                own.append(bound)
        for module, bound in names.items():
            self.imports.append({**self.common(node), "module": module, "syntax": "import", "bound_names": bound})

    def visit_ImportFrom(self, node):  # noqa: N802
        if node.level or not node.module:
            return
        self.imports.append({**self.common(node), "module": node.module, "syntax": "from-import", "bound_names": ["*"] if node.names[0].name == "*" else [a.asname or a.name for a in node.names]})

    def known(self, node: ast.AST) -> set[tuple[str, str]]:
        """The names of an expression whose first name is imported somewhere in the file, or the import function."""
        found = chain(node)
        if found is None or found[0].id not in self.scopes.imported:
            return set()
        return resolve(self.scopes, node)

    def reference(self, node):
        names = self.known(node)
        if any(s == IMPORT for _, s in names):
            self.refs.append({**self.common(node), "names": [{"name": n, "source": s} for n, s in sorted(names)], "ref_ctx": self.ref_ctx})

    def visit_Name(self, node):  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self.reference(node)

    def visit_Attribute(self, node):  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self.reference(node)
        self.visit(node.value)

    def visit_UnaryOp(self, node):  # noqa: N802
        if isinstance(node.op, ast.Invert) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, bool):
            self.unary.append({**self.common(node), "pattern": "bool-bitwise-inversion"})
        self.visit(node.operand)

    def visit_Call(self, node):  # noqa: N802
        names = self.known(node.func)
        if any(s in (IMPORT, BUILTIN) for _, s in names):
            positional = [x for x in node.args if not isinstance(x, ast.Starred)]
            keys = [k.arg for k in node.keywords if k.arg is not None]
            lit = lambda x: dict(zip(("resolved", "type", "value"), literal(x), strict=True))
            call = {
                **self.common(node),
                "names": [{"name": n, "source": s} for n, s in sorted(names)],
                "func": self.region(node.func),
                "positional": [lit(x) for x in positional],
                "keywords": [{"name": k.arg, **lit(k.value)} for k in node.keywords if k.arg is not None],
                "star": len(positional) != len(node.args),
                "star_star": len(keys) != len(node.keywords),
                "repeated": len(set(keys)) != len(keys),
            }
            call["module"] = self.dynamic_module(node, call)
            self.calls.append(call)
        self.visit(node.func)
        for x in [*node.args, *node.keywords]:
            self.visit(x)

    @staticmethod
    def dynamic_module(node: ast.Call, call: dict) -> str | None:
        """The absolute module that an import function is literally given."""
        if call["star"] or call["star_star"] or call["repeated"]:
            return None
        full = {n["name"] for n in call["names"]}
        params = ("name", "package") if "importlib.import_module" in full else ("name", "globals", "locals", "fromlist", "level") if "builtins.__import__" in full else None
        if params is None or len(node.args) > len(params):
            return None
        given = {k.arg: k.value for k in node.keywords}
        if any(k not in params or params.index(k) < len(node.args) for k in given):
            return None
        value = dict(zip(params, node.args, strict=False)) | given
        if "level" in value and literal(value["level"]) != (True, "int", "0"):
            return None
        ok, kind, name = literal(value["name"]) if "name" in value else (False, "", "")
        return name if ok and kind == "str" and not name.startswith(".") else None


def narrowest(lines: list[int], regions: list[dict]) -> list[dict | None]:
    """For each line, in order, the region around it of fewest lines; of equals the first. One sweep with a heap of open regions: those
    that have ended are dropped when they come to its top."""
    waiting = sorted(((r["sl"], r["sc"], r["el"], r["ec"]) for r in regions), reverse=True)
    opened: list[tuple[int, tuple[int, int, int, int]]] = []
    out = []
    for line in lines:
        while waiting and waiting[-1][0] <= line:
            r = waiting.pop()
            heapq.heappush(opened, (r[2] - r[0], r))
        while opened and opened[0][1][2] < line:
            heapq.heappop(opened)
        out.append(dict(zip(("sl", "sc", "el", "ec"), opened[0][1], strict=True)) if opened else None)
    return out


def directives(comments, regions: list[dict], tool: str = TOOL) -> tuple[list[dict], list[dict]]:
    """Suppression comments bound to the narrowest statement around them, and faults in them."""
    prefix = re.compile(rf"^#\s*{tool}:")
    whole = re.compile(rf"^#\s*{tool}:\s*ignore\[(?P<ids>[^\]]*)\](?:\s*--\s*(?P<reason>.*?))?\s*$")
    out, faults = [], []
    for n, c in enumerate(comments):
        if not prefix.match(c.string):
            continue
        where = {"sl": c.start[0], "sc": c.start[1] + 1, "el": c.end[0], "ec": c.end[1] + 1}
        m = whole.fullmatch(c.string)
        ids = list(dict.fromkeys(x.strip() for x in m["ids"].split(",") if x.strip())) if m else []
        if not ids:
            text = "a suppression must name at least one rule" if m else f"invalid suppression; write # {tool}: ignore[RULE] -- reason"
            faults.append({"code": "PYA3002", "message": text, **where})
            continue
        out.append({"seq": n, "ids": ids, "reason": (m["reason"] or "").strip() or None, "line": c.start[0], "col": c.start[1] + 1})
    for d, statement in zip(out, narrowest([d["line"] for d in out], regions), strict=True):  # comments are in order of their lines
        d["statement"] = statement
    return out, faults


def extract(path: str | None, source: str, window: tuple[int, ...], blocked: frozenset[str] = frozenset(), tool: str = TOOL, packed: bool = False) -> dict:
    """All facts of one file; what cannot be parsed, or has no path, is a diagnostic, never an exception. packed: sets of versions are
    given as bits, not as lists."""
    out = {"path": path, "status": "parsed", "imports": [], "refs": [], "calls": [], "unary": [], "patches": [], "directives": [], "diagnostics": []}
    at = {"sl": 1, "sc": 1, "el": 1, "ec": 1}
    comments, regions = [], []
    if path is None:
        out["status"] = "incomplete"
        out["diagnostics"].append({"code": "PYA1001", "message": "a source file has no path", **at})
        return out
    try:
        comments = check_nesting(source, tool)
        tree = ast.parse(source)
        if tree_depth(tree) > MAX_TREE:
            raise TooDeep("syntax tree nesting exceeds the limit")
        x = Extractor(source, tree, bits(window), frozenset({"typing"}) if path.endswith(".pyi") else frozenset({"runtime"}), blocked, bool(comments))
        regions = x.regions
        for k in ("imports", "refs", "calls", "unary", "patches"):
            out[k] = getattr(x, k)
            for fact in out[k] if not packed else ():
                fact.update({c: minors(fact[c]) for c in ("reach", "active") if c in fact})
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out["status"] = "incomplete"
        line, col = getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1
        out["diagnostics"].append({"code": "PYA1003", "message": f"cannot parse: {getattr(e, 'msg', None) or e}"[:200], **at, "sl": line, "el": line, "sc": max(col, 1), "ec": max(col, 1)})
    out["directives"], faults = directives(comments, regions, tool)
    out["diagnostics"] += faults
    return out

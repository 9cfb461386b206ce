"""Flow-insensitive name resolution over an ast: every binding of a name in its scope counts."""

from __future__ import annotations

import ast
import builtins

IMPORT, LOCAL, BUILTIN = "import", "local", "builtin"
_BUILTINS = frozenset(dir(builtins))
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


# Fields of contexts and operators, whose nodes have no fields.
LEAVES = frozenset({"ctx", "op", "ops"})
_fields: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """Nodes below a node in order, but for contexts and operators."""
    names = _fields.get(node.__class__)
    if names is None:
        names = _fields[node.__class__] = () if isinstance(node, (ast.Constant, ast.Name)) else tuple(f for f in node._fields if f not in LEAVES)
    out = []
    for name in names:
        value = getattr(node, name, None)
        if value.__class__ is list:
            out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


class Walk:
    """Visits a tree by methods named after classes, which are looked up once a class."""

    _methods: dict[type, object] = {}

    def __init_subclass__(cls):
        cls._methods = {}

    def visit(self, node: ast.AST) -> None:
        kind = node.__class__
        method = self._methods.get(kind)
        if method is None:
            method = self._methods[kind] = getattr(type(self), f"visit_{kind.__name__}", Walk.generic_visit)
        method(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for n in children(node):
            self.visit(n)


class Scope:
    def __init__(self, kind: str, parent: Scope | None, name: str | None = None):
        self.kind, self.parent, self.name = kind, parent, name
        self.bindings: dict[str, set[tuple[str, str]]] = {}
        self.outer: dict[str, str] = {}
        self.module = parent.module if parent else self
        self.label = ".".join(x for x in ((parent.label if parent and parent.label != "<module>" else ""), name or "") if x) or "<module>"

    def bind(self, name: str, qualified: str, source: str) -> None:
        where = self
        if self.outer.get(name) == "global":
            where = self.module
        elif self.outer.get(name) == "nonlocal":
            up = self.parent
            while up is not None and (up.kind != "function" or name not in up.bindings):
                up = up.parent
            where = up or self
        where.bindings.setdefault(name, set()).add((qualified, source))

    def local(self, name: str) -> None:
        self.bind(name, name if self.label == "<module>" else f"{self.label}.{name}", LOCAL)

    def lookup(self, name: str) -> set[tuple[str, str]]:
        scope: Scope | None = self.module if self.outer.get(name) == "global" else self
        first = True
        while scope is not None:
            if name in scope.bindings and (first or scope.kind != "class"):
                return scope.bindings[name]
            if scope.kind != "comprehension":
                first = False
            scope = scope.parent
        return {(f"builtins.{name}", BUILTIN)} if name in _BUILTINS else set()


def declared(body: list[ast.stmt]) -> dict[str, str]:
    """Names that global or nonlocal statements of this body itself declare; those of functions and classes in it are theirs."""
    out, todo = {}, list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.Global, ast.Nonlocal)):
            out.update(dict.fromkeys(node.names, "global" if isinstance(node, ast.Global) else "nonlocal"))
        elif isinstance(node, (ast.stmt, ast.ExceptHandler, ast.match_case)) and not isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            todo += [n for n in children(node) if isinstance(n, (ast.stmt, ast.ExceptHandler, ast.match_case))]
    return out


class Scopes(Walk):
    """The scope that each node is looked up in, and all bindings."""

    def __init__(self, tree: ast.Module, outer: bool = True):
        """outer: whether any global or nonlocal statement may be in the tree."""
        self.declares = outer
        self.of: dict[int, Scope] = {}
        self.imported = {"__import__"}
        self.scope = Scope("module", None)
        self.root = self.scope
        self.visit(tree)

    def visit(self, node: ast.AST):
        self.of[id(node)] = self.scope
        super().visit(node)

    def _inside(self, scope: Scope, *nodes) -> None:
        was, self.scope = self.scope, scope
        for node in nodes:
            for n in node if isinstance(node, list) else [node]:
                if n is not None:
                    self.visit(n)
        self.scope = was

    def _function(self, node, name: str | None) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
        self.of[id(a)] = self.scope
        for d in [*getattr(node, "decorator_list", []), *a.defaults, *[x for x in a.kw_defaults if x], *[x.annotation for x in every if x.annotation], *([node.returns] if getattr(node, "returns", None) else [])]:
            self.visit(d)
        if name:
            self.scope.local(name)
        inner = Scope("function", self.scope, name)
        if name and self.declares:
            inner.outer = declared(node.body)
        for x in every:
            self.of[id(x)] = inner
            inner.local(x.arg)
        self._inside(inner, getattr(node, "type_params", []), node.body)

    def visit_FunctionDef(self, node):  # noqa: N802
        self._function(node, node.name)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Lambda(self, node):  # noqa: N802
        self._function(node, None)

    def visit_ClassDef(self, node):  # noqa: N802
        for n in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(n)
        self.scope.local(node.name)
        inner = Scope("class", self.scope, node.name)
        if self.declares:
            inner.outer = declared(node.body)
        self._inside(inner, getattr(node, "type_params", []), node.body)

    def _comprehension(self, node):
        inner = Scope("comprehension", self.scope)
        inner.label = self.scope.label
        first, *rest = node.generators
        self.visit(first.iter)
        self.of[id(first)] = inner
        self._inside(inner, first.target, first.ifs, *rest, *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]))

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension  # noqa: N815

    def visit_NamedExpr(self, node):  # noqa: N802
        scope = self.scope
        while scope.kind == "comprehension":
            scope = scope.parent
        scope.local(node.target.id)
        self.of[id(node.target)] = self.scope
        self.visit(node.value)

    def visit_Name(self, node):  # noqa: N802
        if not isinstance(node.ctx, ast.Load):
            self.scope.local(node.id)

    def visit_ExceptHandler(self, node):  # noqa: N802
        if node.name:
            self.scope.local(node.name)
        self.generic_visit(node)

    def visit_MatchAs(self, node):  # noqa: N802
        if node.name:
            self.scope.local(node.name)
        self.generic_visit(node)

    def visit_MatchStar(self, node):  # noqa: N802
        if node.name:
            self.scope.local(node.name)

    def visit_MatchMapping(self, node):  # noqa: N802
        if node.rest:
            self.scope.local(node.rest)
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            top = a.name.partition(".")[0]
            self.imported.add(a.asname or top)
            self.scope.bind(a.asname or top, a.name if a.asname else top, IMPORT)

    def visit_ImportFrom(self, node):  # noqa: N802
        base = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name != "*":
                self.imported.add(a.asname or a.name)
                self.scope.bind(a.asname or a.name, f"{base}.{a.name}" if node.module else base + a.name, IMPORT)


def chain(node: ast.AST) -> tuple[ast.Name, list[str]] | None:
    """The leading name and attributes of a dotted expression; calls and subscripts inside count as what they are of."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Name):
            return node, parts[::-1]
        else:
            return None


def resolve(scopes: Scopes, node: ast.AST) -> set[tuple[str, str]]:
    """(qualified name, source) of every binding that an expression may name."""
    found = chain(node)
    if found is None:
        return set()
    name, rest = found
    scope = scopes.of.get(id(name)) or scopes.of.get(id(node)) or scopes.root
    return {(".".join((q, *rest)), s) for q, s in scope.lookup(name.id)}

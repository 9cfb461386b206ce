"""Column expressions that a scan and its stand-alone queries share. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "driftgauge-fingerprint-v1"
NUL = "\0"


def prefixes(name: Column | str) -> Column:
    """Every dotted prefix of a name: a.b.c -> a, a.b, a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def top(name: Column | str) -> Column:
    return F.substring_index(name, ".", 1)


def fingerprint(*fields: Column | str, namespace: str = NAMESPACE) -> Column:
    """SHA-256 over a namespace and fields, NUL between; null fields count as empty."""
    return F.sha2(F.concat_ws(NUL, F.lit(namespace), *[F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields]), 256)


#: A set of minor versions is the bits of a number, so versions stay below this.
WIDTH = 63
#: Impacts, the worst first.
IMPACTS = ("breaking", "risk", "deprecated", "informational")


def held(versions) -> int:
    """The number that a set of versions known beforehand is."""
    if any(not 0 <= v < WIDTH for v in versions):
        raise ValueError(f"versions must lie between 0 and {WIDTH - 1}")
    return sum({1 << v for v in versions})


def bit(version: str) -> str:
    return f"shiftleft(1L, cast({version} as int))"


def lowest(bits: str) -> str:
    """The least version of a set; of the empty set it has no meaning."""
    return f"cast(bit_count((({bits}) & -({bits})) - 1) as int)"


def members(bits: str) -> str:
    """The versions of a set, in order: only those between its least and its greatest are looked at."""
    none = "cast(array() as array<int>)"
    return f"if(({bits}) = 0, {none}, filter(sequence({lowest(bits)}, least({WIDTH - 1}, cast(log2({bits}) as int) + 1)), v -> ({bits}) & shiftleft(1L, v) <> 0))"


def runs(bits: str) -> str:
    """Runs of consecutive versions of a set (from, through): the k-th bit with none below it begins the run that the k-th with none above it ends."""
    first, last = members(f"({bits}) & ~shiftleft(({bits}), 1)"), members(f"({bits}) & ~shiftright(({bits}), 1)")
    return f"zip_with({first}, {last}, (a, b) -> named_struct('from', a, 'through', b))"


def phases(events: str, versions) -> Column:
    """The states of a timeline (state, bits), the worst first, each with those of the versions at which it is the last event's."""
    each = [f"named_struct('state', '{i}', 'bits', " + " | ".join(f"if(try_element_at(filter({events}, e -> e.py <= {v}), -1).impact = '{i}', {1 << v}L, 0L)" for v in sorted(set(versions))) + ")" for i in IMPACTS]
    return F.expr(f"filter(array({', '.join(each)}), x -> x.bits <> 0)")


def within(phases: str, bits: str) -> Column:
    """Those states that some version of a set has, with these versions."""
    return F.expr(f"filter(transform({phases}, p -> named_struct('state', p.state, 'bits', p.bits & {bits})), x -> x.bits <> 0)")


def spans(states: str) -> Column:
    """Runs of versions of equal state (from, through, state), in order, of states with their versions."""
    return F.expr(f"array_sort(flatten(transform({states}, p -> transform({runs('p.bits')}, r -> named_struct('from', r.from, 'through', r.through, 'state', p.state)))))")


def as_of(events: str, at: str, value: str = "impact", key: str = "py") -> Column:
    """value of the last of the sorted events whose key is at or before; null where there is none."""
    return F.expr(f"try_element_at(filter({events}, e -> e.{key} <= {at}), -1).{value}")


def states(events: str, versions: str) -> Column:
    """The state at each version, versions without one left out."""
    return F.expr(f"filter(transform(array_sort({versions}), v -> struct(v, try_element_at(filter({events}, e -> e.py <= v), -1).impact as state)), x -> x.state is not null)")


def ranges(points: str) -> Column:
    """Runs of consecutive versions of equal state: gaps and islands, folded within the row."""
    last = "element_at(acc, -1)"
    return F.expr(
        f"""aggregate({points}, cast(array() as array<struct<from:int,through:int,state:string>>), (acc, x) ->
        if(size(acc) > 0 and try_element_at(acc, -1).through = x.v - 1 and try_element_at(acc, -1).state = x.state,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', {last}.from, 'through', x.v, 'state', x.state))),
           concat(acc, array(named_struct('from', x.v, 'through', x.v, 'state', x.state)))))"""
    )


def rank(impact: str) -> str:
    return f"case {impact} when 'breaking' then 3 when 'risk' then 2 when 'deprecated' then 1 else 0 end"


def resolution(names: str, expected: str, *sources: str) -> Column:
    """How an expected name is met by names from the admitted sources; the confidence follows from it."""
    admitted = ", ".join(f"'{s}'" for s in sources)
    exact = "case when exists({0}, n -> n.source = 'import') and exists({0}, n -> n.source = 'builtin') then 'exact-import-or-builtin' when exists({0}, n -> n.source = 'builtin') then 'exact-builtin' else 'exact-import' end".format(names)
    return F.expr(
        f"""case when not exists({names}, n -> n.name = {expected} and n.source in ({admitted})) then 'unresolved'
        when exists({names}, n -> n.source not in ({admitted})) then 'lexically-shadowed'
        when forall({names}, n -> n.name = {expected}) then {exact} else 'ambiguous-import' end"""
    )


def confidence(resolved: str) -> Column:
    return F.expr(f"case when {resolved} like 'exact%' then 'high' when {resolved} = 'ambiguous-import' then 'medium' end")


def call_shape() -> Column:
    """Whether a call (positional, keywords, star, star_star, repeated) proves every predicate of a shape matcher."""
    return F.expr(
        """not repeated
        and not (star and (max_pos is not null or exists(literals, l -> l.position is not null)))
        and size(positional) >= coalesce(min_pos, 0) and size(positional) <= coalesce(max_pos, 2147483647)
        and size(keywords) >= coalesce(min_kw, 0) and size(keywords) <= coalesce(max_kw, 2147483647)
        and not (star_star and (max_kw is not null or size(forbidden) > 0))
        and size(array_except(required, transform(keywords, k -> k.name))) = 0
        and not arrays_overlap(forbidden, transform(keywords, k -> k.name))
        and forall(literals, l -> if(l.position is not null,
            coalesce(try_element_at(positional, l.position + 1).resolved and try_element_at(positional, l.position + 1).type = l.type and try_element_at(positional, l.position + 1).value = l.value, false),
            exists(keywords, k -> k.name = l.keyword and k.resolved and k.type = l.type and k.value = l.value)))"""
    )


def minor_text(v: str) -> Column:
    return F.concat(F.lit("3."), F.col(v).cast("string"))

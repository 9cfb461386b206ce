"""Facts joined with matchers. Every join is an equi-join on a name, the registry side broadcast.

The registry has a bounded size (its loader limits files and nodes), so its broadcasts are bounded.
Project modules are joined without a hint: their number grows with the source tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import exprs as E

COMMON = "seq:int,sl:int,sc:int,el:int,ec:int,scope:string,reach:bigint,ctx:array<string>"
R = "sl:int,sc:int,el:int,ec:int"
NAMES = "names:array<struct<name:string,source:string>>"
LIT = "resolved:boolean,type:string,value:string"
#: Sets of versions (reach, active) are the bits of a number. Uses: i import, r reference, c call (at its function), d literal dynamic import, u unary pattern.
PARSED = f"""path string, status string,
facts array<struct<use:string,{COMMON},{NAMES},module:string,pattern:string,syntax:string,bound_names:array<string>,ref_ctx:string,positional:array<struct<{LIT}>>,keywords:array<struct<name:string,{LIT}>>,star:boolean,star_star:boolean,repeated:boolean>>,
patches array<struct<{R},active:bigint>>,
directives array<struct<seq:int,ids:array<string>,reason:string,line:int,col:int,statement:struct<{R}>>>,
diagnostics array<struct<code:string,message:string,{R}>>"""
#: Matcher kind -> the use that it looks at.
USES = {"module-import": "i", "qualified-reference": "r", "qualified-call": "c", "call-shape": "c", "literal-dynamic-import": "d", "builtin-pattern": "u"}
#: What an inference says of a use.
SAYS = {"i": "import of", "r": "reference to", "c": "reference to", "d": "dynamic import of"}
#: Different files whose facts a worker makes at once, and the bytes of sources, copies included, that they may stand for.
STEP, BYTES = 100, 4 << 20
#: What one task is given to parse at most, where files are dealt: files, and bytes of their sources.
TASK_FILES, TASK_BYTES = 2_000, 8 << 20
BASE = ["path", "rule_id", "kind", "subject", "sl", "sc", "el", "ec", "scope", "seq", "reach", "ctx", "confidence", "evidence"]


def flat(out: dict) -> dict:
    """The facts of a file in one list, each with its use; a call that imports a literal name counts as both."""
    facts = [{"use": u, **x} for u, k in (("i", "imports"), ("r", "refs"), ("u", "unary")) for x in out[k]]
    for x in out["calls"]:
        if any(n["source"] == "import" for n in x["names"]):
            facts.append({"use": "c", **x, **x["func"]})
        if x["module"] is not None:
            facts.append({"use": "d", **x})
    return {"path": out["path"], "status": out["status"], "facts": facts, "patches": out["patches"], "directives": out["directives"], "diagnostics": out["diagnostics"]}


def spread(files: DataFrame, size: F.Column | None = None, key: str | list[str] = "path", most: int = TASK_FILES) -> DataFrame:
    """The rows dealt by key to as many tasks as their number, and the sum of their sizes, ask for: a small table in one file may
    stand for many files, and whoever reads it would parse them all in one task. Rows that one task can take stay where they are."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).cast("long")).first()
    tasks = max(-(-n // most), -(-total // TASK_BYTES))
    keys = [key] if isinstance(key, str) else key
    return files if tasks < 2 else files.repartition(max(tasks, files.sparkSession.sparkContext.defaultParallelism), *keys)


def groups(names: list, sources: list):
    """(a, b) of runs of files: at most STEP different ones, and of at most BYTES in all or one file."""
    a, size, seen = 0, 0, set()
    for b, (name, source) in enumerate(zip(names, sources, strict=True)):
        one = (same(name), source)
        if b > a and (size + len(source) > BYTES or len(seen) == STEP and one not in seen):
            yield a, b
            a, size, seen = b, 0, set()
        size += len(source)
        seen.add(one)
    if len(names) > a:
        yield a, len(names)


def same(path: str | None) -> str | None:
    """What a file's facts take from its path: whether there is one, and whether it is a stub's."""
    return path if path is None else path[-4:] if path.endswith(".pyi") else ""


def parse(files: DataFrame, window: tuple[int, ...], blocked: frozenset[str] = frozenset(), tool: str = "driftgauge") -> DataFrame:
    """files (path, source) to one row of facts each. The only Python of a scan; no shuffle. Equal sources that a task meets side by
    side are parsed once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PARSED)
    arrow = to_arrow_schema(schema)

    def run(frames):
        from driftgauge.pyparse.extract import extract

        for batch in frames:
            paths, sources = batch.column("path").to_pylist(), [s or "" for s in batch.column("source").to_pylist()]
            for a, b in groups(paths, sources):  # the facts of a few files at a time
                rows, at = [], {}
                for p, s in zip(paths[a:b], sources[a:b], strict=True):
                    if (same(p), s) not in at:
                        at[same(p), s] = len(rows)
                        rows.append(flat(extract(p, s, window, blocked, tool, packed=True)))
                out = pa.RecordBatch.from_pylist(rows, schema=arrow)
                if len(rows) < b - a:
                    out = out.take(pa.array([at[same(p), s] for p, s in zip(paths[a:b], sources[a:b], strict=True)], pa.int32()))
                    out = out.set_column(0, arrow.field(0), pa.array(paths[a:b], arrow.field(0).type))
                yield out

    return files.select("path", "source").mapInArrow(run, schema)


def facts(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select("path", F.explode(name).alias("f")).select("path", "f.*")


def _evidence(**columns) -> F.Column:
    pairs = []
    for key, value in sorted(columns.items()):
        pairs += [F.lit(key), value]
    return F.create_map(*pairs)


def _one(value) -> F.Column:
    return F.array(value if not isinstance(value, str) else F.lit(value))


def _names(column: str = "names") -> F.Column:
    return F.array_sort(F.array_distinct(F.expr(f"transform({column}, n -> n.name)")))


def match(parsed: DataFrame, rules: DataFrame, matchers: DataFrame, modules: DataFrame | None = None, source_roots: tuple[str, ...] = (".", "src")) -> tuple[DataFrame, DataFrame]:
    """(matches, inferences). modules: (key, candidates) of local modules that compete with a library's.

    All uses and all matchers meet in one join on (use, name); what a kind asks beyond the name is a condition on the pair.
    """
    roots = F.array(*map(F.lit, source_roots))
    use_of = F.create_map(*[F.lit(x) for pair in USES.items() for x in pair])
    m = matchers.join(F.broadcast(rules.select("rule_id", "subject")), "rule_id").withColumnsRenamed({"contexts": "ref_contexts", "confidence": "stated"}).withColumn("use", use_of[F.col("kind")])

    imported = F.expr("array_distinct(transform(filter(names, n -> n.source = 'import'), n -> n.name))")
    keys = F.when(F.col("use").isin("i", "d"), E.prefixes("module")).when(F.col("use") == "u", F.array("pattern")).otherwise(imported)
    function = F.expr("if(exists(names, n -> n.name = 'importlib.import_module' and n.source = 'import'), 'importlib.import_module', 'builtins.__import__')")
    met = facts(parsed, "facts").select("*", F.explode(keys).alias("name"), function.alias("function")).join(F.broadcast(m), ["use", "name"])
    met = met.where((F.col("kind") != "qualified-reference") | F.expr("size(ref_contexts) = 0 or array_contains(ref_contexts, ref_ctx)")).where((F.col("kind") != "call-shape") | E.call_shape())

    use = F.col("use")
    called = F.when(F.col("function") == "importlib.import_module", E.resolution("names", "function", "import")).otherwise(E.resolution("names", "function", "builtin", "import"))
    resolution = F.when(use == "i", "no-competing-project-module").when(use == "u", "builtin-pattern").when(use == "d", called).otherwise(E.resolution("names", "name", "import"))
    met = met.withColumn("resolution", resolution).withColumn("resolved", E.confidence("resolution")).where("resolved is not null or use in ('i', 'u')")

    one = {k: _one(F.col(k)) for k in ("resolution", "module", "syntax", "ref_ctx", "function", "pattern")}
    evidence = F.when(use == "i", _evidence(bound_names=F.col("bound_names"), imported_module=one["module"], resolution=one["resolution"], source_roots=roots, syntax=one["syntax"]))
    evidence = evidence.when(use == "r", _evidence(qualified_names=_names(), reference_context=one["ref_ctx"], resolution=one["resolution"]))
    evidence = evidence.when(F.col("kind") == "call-shape", _evidence(keyword_names=F.array_sort(F.expr("transform(keywords, k -> k.name)")), positional_count=_one(F.size("positional").cast("string")), qualified_names=_names(), resolution=one["resolution"]))
    evidence = evidence.when(use == "c", _evidence(qualified_names=_names(), resolution=one["resolution"]))
    evidence = evidence.when(use == "d", _evidence(dynamic_function=one["function"], imported_module=one["module"], qualified_names=_names(), resolution=one["resolution"]))
    evidence = evidence.otherwise(_evidence(pattern=one["pattern"], resolution=one["resolution"]))
    met = met.withColumns({
        "confidence": F.expr("case when use in ('i', 'u') then 'high' when use = 'd' then if('medium' in (stated, resolved), 'medium', stated) else resolved end"),
        "top": F.when(use.isin("i", "d"), E.top("module")).when(use != "u", E.top("name")),
        "evidence": evidence,
    })

    guard = parsed.select("path", F.explode("patches").alias("f")).select("path", "f.sl", "f.sc", "f.el", "f.ec", F.lit("PYA2002").alias("code"), F.lit("version-guard").alias("kind"), F.lit("patch-level Python version guard is unsupported and was treated as unknown").alias("message"), _evidence(guard_granularity=_one("patch"), reachability=_one("both-branches")).alias("evidence"), "f.active")
    if modules is None:
        return met.select(*BASE), guard
    kept = met.join(modules.select(F.col("key").alias("top")), "top", "left_anti").select(*BASE)
    named = use.isin("r", "c")
    says = F.create_map(*[F.lit(x) for pair in SAYS.items() for x in pair])
    shown = F.when(named, F.col("name")).otherwise(F.col("module"))
    message = F.concat(F.lit("did not classify "), says[use], F.lit(" "), shown, F.lit(" as standard library because a competing project module exists"))
    about = F.create_map(F.lit("candidate_paths"), F.col("candidates"), F.when(named, "qualified_name").otherwise("imported_module"), F.array(shown), F.lit("resolution"), _one("competing-project-module"), F.lit("source_roots"), roots)
    lost = met.join(modules.withColumnRenamed("key", "top"), "top").select("use", "path", "sl", "sc", "el", "ec", F.lit("PYA2001").alias("code"), F.lit("module-resolution").alias("kind"), message.alias("message"), about.alias("evidence"), F.lit(None).cast("bigint").alias("active"))
    lost = lost.dropDuplicates(["use", "path", "sl", "sc", "el", "ec", "message"]).drop("use")
    return kept, lost.unionByName(guard)

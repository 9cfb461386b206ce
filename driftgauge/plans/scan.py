"""A whole scan: files to findings, inferences, diagnostics and a report."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import exprs as E
from driftgauge.operators import findings as G
from driftgauge.operators import ignores as I
from driftgauge.operators import match as M
from driftgauge.session import ship
from driftgauge.sources import config as C
from driftgauge.sources import discovery as D
from driftgauge.sources import registry as R
from driftgauge.sources import tree as T

DIAGNOSTICS = "path string, code string, message string, sl int, sc int, el int, ec int"


@dataclass
class Scan:
    """Frames of a scan, and what was resolved for it."""

    registry: R.Registry
    config: C.Config
    findings: DataFrame
    inferences: DataFrame
    diagnostics: DataFrame
    discovered: int
    skipped: int
    parsed: DataFrame
    held: tuple[DataFrame, ...] = ()
    root: str | None = None

    def keep(self) -> None:
        """Hold the lists on the executors, for a report that goes over them more than once."""
        if not self.findings.is_cached:
            self.findings, self.inferences, self.diagnostics = (x.persist() for x in (self.findings, self.inferences, self.diagnostics))
            self.held = (*self.held, self.findings, self.inferences, self.diagnostics)

    def release(self) -> None:
        """Forget what the scan keeps for its frames, when these have been used."""
        for frame in (self.parsed, *self.held):
            frame.unpersist()

    def incomplete(self) -> int:
        bad = self.diagnostics.where("code like 'PYA1%'").select("path").distinct().count()
        return bad

    def summary(self) -> DataFrame:
        c = self.config
        return G.summary(self.findings, c.fail_on, c.fail_new_only, self.incomplete() > 0, c.allow_incomplete)


def ignore_rows(registry: R.Registry, ignores: dict) -> tuple[list[tuple], list[tuple]]:
    """(rule, regex, pattern, place) of per-file ignores, and (rule name) diagnostics of unknown ones."""
    rows, unknown = [], []
    for place, (pattern, ids) in enumerate(ignores.items()):
        for name in ids:
            rule = registry.find(name)
            if rule is None:
                unknown.append((None, "PYA3001", f"unknown suppression rule {name}", None, None, None, None))
            else:
                rows.append((rule.id, f"^(?:{D.glob_regex(pattern)})$", pattern, place))
    return rows, unknown


def local_modules(spark: SparkSession, modules: dict[str, list[str]] | DataFrame | None, names: list[str], plain: bool = False) -> tuple[DataFrame | None, frozenset[str]]:
    """((key, candidates) of the tree's own modules among these names, and which of typing and * are provided).

    plain: it is known that neither is."""
    if modules is None or isinstance(modules, dict) and not modules:
        return None, frozenset()
    if isinstance(modules, dict):
        star, special = sorted(modules.get("*", [])), frozenset(modules) & {"typing", "*"}
        modules = spark.createDataFrame([(k, p) for k, paths in modules.items() for p in paths], "key string, path string")
    elif plain:
        star, special = [], frozenset()
    else:  # links that hide a source root: no more than there are roots
        found = modules.where("key in ('typing', '*')").select("key", F.when(F.col("key") == "*", F.col("path")).alias("path")).distinct().collect()
        star, special = sorted(r.path for r in found if r.key == "*"), frozenset(r.key for r in found)
    own = modules.where(F.col("key").isin(names)).groupBy("key").agg(F.collect_set("path").alias("own"))
    if star:
        own = spark.createDataFrame([(n,) for n in names], "key string").join(own, "key", "left")
    every = F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(*map(F.lit, star)).cast("array<string>")))
    return own.select("key", F.array_sort(every).alias("candidates")), special


def scan_frame(
    spark: SparkSession, files: DataFrame, registry: R.Registry | None = None, config: C.Config | None = None, modules: dict[str, list[str]] | DataFrame | None = None, baseline: list[str] | None = None,
    issues: list[tuple] | DataFrame = (), namespace: str = G.E.NAMESPACE, cached: bool = True, plain: bool = False,
) -> Scan:
    """Scan a frame of (path, source), whose rows are counted and dealt to tasks first. Repeated paths are kept apart only by their facts;
    pass each once.

    modules: names that the project itself provides, as a dict or a frame of (key, path); issues: files that are not among them, as
    a list or a frame of (path, code, message); plain: the modules hold neither typing nor a link that could stand for any."""
    registry, config = registry or R.load(), config or C.Config()
    ship(spark)
    rules, matchers = R.rules_frame(spark, registry), R.matchers_frame(spark, registry)
    every = sorted({m.name.partition(".")[0] for r in registry.rules for m in r.matchers if m.kind != "builtin-pattern"} | {"importlib"})
    local, blocked = local_modules(spark, modules, every, plain)
    parsed = M.parse(M.spread(files, F.octet_length("source")), registry.window, blocked)
    if cached:
        parsed = parsed.persist()  # facts, guards, directives and diagnostics read it; without this each would parse again
    matches, inferences = M.match(parsed, rules, matchers, local, tuple(config.source_roots))
    found = G.findings(matches, rules, config.versions, config.minimum_confidence, config.show_unscheduled, namespace)
    names = spark.createDataFrame([(n, r.id) for r in registry.rules for n in (r.id, *r.aliases)], "name string, rule_id string")
    directives, unknown = G.directive_rules(parsed, names)
    rows, faults = ignore_rows(registry, config.per_file_ignores)
    found = G.suppress(found, directives, spark.createDataFrame(rows, "rule_id string, regex string, pattern string, place int"))
    known = spark.createDataFrame([(x,) for x in baseline], "fingerprint string") if baseline is not None else None
    found = G.with_baseline(found, known)
    inferences = inferences.where(F.col("active").isNull() | (F.col("active").bitwiseAND(E.held(config.versions)) != 0)).drop("active")
    diagnostics = parsed.select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")
    place = [F.lit(None).cast("int").alias(c) for c in ("sl", "sc", "el", "ec")]
    fixed = spark.createDataFrame(faults, DIAGNOSTICS)
    if isinstance(issues, DataFrame):
        fixed = fixed.unionByName(issues.select("path", "code", "message", *place))
    elif issues:
        fixed = fixed.unionByName(spark.createDataFrame([tuple(i) for i in issues], "path string, code string, message string").select("*", *place))
    diagnostics = diagnostics.unionByName(unknown).unionByName(fixed)
    return Scan(registry, config, found, inferences, diagnostics, 0, 0 if isinstance(issues, DataFrame) else len(issues), parsed)


def admitted(listing: DataFrame, root: str, paths: list[str] | None, config: C.Config, rules: bool = True, faults: bool = True) -> DataFrame:
    """The rows of a listing that a scan takes: requested, not ignored, and selected by the configuration. An ignore file that counts
    and is at fault raises. rules, faults: whether the listing has ignore files, and any at fault."""
    take, links = D.requests(os.path.realpath(root), paths)
    own = F.lit(False)
    for rel, is_file in take:
        own |= F.lit(True) if not rel else F.col("path") == rel if is_file else F.col("path").startswith(rel + "/")
    own |= F.col("path").isin(links) | (F.col("path") == ".")
    rows = listing.where("kind <> 'rules'").where(own)
    # a directory that can't be listed is judged by what would lie in it, a link by its own name
    judged = F.when(F.col("code") == "PYA1001", F.concat("path", F.lit("/x"))).otherwise(F.col("path"))
    rows = rows.withColumn("judged", judged)
    if config.respect_gitignore and (rules or faults):
        files = listing.where("kind = 'rules'")
        wrong = files.where("code is not null").select("path", F.concat("path", F.when(F.col("path") == "", "").otherwise("/"), F.lit("x")).alias("judged"), "code", "message")
        good = files.where("code is null and size(rules) > 0").select(F.col("path").alias("base"), "rules")
        near = F.lit(False)
        for rel, _ in take:
            near |= F.lit(True) if not rel else F.col("path").startswith(rel + "/") | F.lit(rel + "/").startswith(F.concat("path", F.when(F.col("path") == "", "").otherwise("/")))
        shut = wrong.join(I.ignored(wrong, good, "judged").withColumnRenamed("path", "judged"), "judged", "left_anti")
        for fault in shut.where(near).orderBy("path").take(1) if faults else ():
            raise (D.DiscoveryError if fault.code == "error" else D.DiscoveryIncompleteError)(fault.message)
        rows = rows.join(I.ignored(rows, good, "judged").withColumnRenamed("path", "judged"), "judged", "left_anti")
    plain = I.selected("judged", D.glob_rules(config.include), D.glob_rules(config.exclude))
    unlisted = I.selected("judged", [], D.glob_rules(config.exclude))
    return rows.where(F.when(F.col("kind").isin("file", "issue") & (F.coalesce("code", F.lit("")) != "PYA1001"), plain).otherwise(unlisted)).drop("judged")


def scan(spark: SparkSession, root: str | None = None, paths: list[str] | None = None, registry_source: str | None = None, config_path: str | None = None, baseline_file: str | None = None, **over) -> Scan:
    """Scan a source tree on a file system that the driver and all executors share.

    One walk, in tasks, lists the tree; the listing gives the project's own modules and, held against ignore files and configuration,
    the files to read, which tasks do. No source is on the driver."""
    root = C.project_root(root)
    registry = R.load(registry_source)
    config = C.resolve(root, registry, config_path, **over)
    if config.fail_new_only and not baseline_file:
        raise C.ConfigurationError("failing on new findings needs a baseline")
    known = C.load_baseline(baseline_file, root) if baseline_file else None
    if not os.path.isdir(root):
        raise D.DiscoveryError(f"not a directory: {root}")
    inferred = config.roots_provenance.startswith("inferred")
    hidden = [] if inferred else [r for r in config.source_roots if set(r.strip("/").split("/")) & set(D.EXCLUDED)]
    listing = T.entries(spark, root, config.max_file_size_bytes, contents=False, also=hidden).persist()
    met = listing.agg(*[F.coalesce(F.bool_or(F.expr(x)), F.lit(False)).alias(n) for n, x in (("rules", "kind = 'rules' and code is null"), ("faults", "kind = 'rules' and code is not null"), ("odd", "kind = 'link' or path rlike '(^|/)typing(/|[.])'"))]).first()
    modules = T.modules(listing, config.source_roots, inferred)
    if not inferred:
        beneath = F.lit(False)
        for r in config.source_roots:
            base = "" if r in (".", "") else r.strip("/")
            beneath |= F.lit(True) if not base else (F.col("path") == base) | F.col("path").startswith(base + "/") | F.lit(base).startswith(F.concat("path", F.lit("/")))
        modules = modules.where(beneath)
    try:
        rows = admitted(listing, root, paths, config, met.rules, met.faults).persist()
    except D.DiscoveryIncompleteError as e:  # what the list of files hangs on can't be read: nothing is scanned
        none = spark.createDataFrame([], "path string, source string")
        out = scan_frame(spark, none, registry, config, None, known, [(None, "PYA1001", str(e))])
        out.root = root
        return out
    read = T.read(rows.where("kind = 'file'"), root, config.max_file_size_bytes).persist()
    issues = rows.where("code is not null").select("path", "code", "message").unionByName(read.where("code is not null").select("path", "code", "message"))
    out = scan_frame(spark, read.where("code is null").select("path", "source"), registry, config, modules, known, issues, plain=not met.odd)
    out.discovered = rows.count()
    out.held, out.root = (listing, rows, read), root
    return out

"""A source tree as a Spark data source: directories are dealt to tasks, which walk them and read what is admitted.

Planning lists directories, widest first, until some SUBTREES are open; each of these, with all below it, is walked by a task.
The tree must be on a path that the driver and all executors share. Nothing is followed through a link on the way; a file that is
a link is read from where it leads, if that lies beneath the root. Rows: files, issues, links to directories, and the
rules of each ignore file, under the path of its directory.

Options: root; max_bytes; contents (true: sources are read as well); also (comma-separated directories that are walked though their
names are among those never entered); under (comma-separated paths: only these and what lies below them is listed, and no directory that
can hold none of them is entered). under is an option and not a pushed-down filter, as two scans of one frame, of which each has filters of its own,
would share what was pushed last.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftgauge.session import ship
from driftgauge.sources import discovery as D

NAME = "driftgauge_tree"
SCHEMA = "path string, kind string, size long, code string, message string, rules array<struct<again:boolean,regex:string>>, source string"
#: Subtrees that tasks are given at least, where there are as many, and directories that planning lists at most.
SUBTREES, LISTED = 64, 512
#: Files whose sources a worker holds at once.
STEP = 100


@dataclass
class Subtrees(InputPartition):
    """Directories to walk, and entries that planning has met."""

    starts: tuple[str, ...]
    entries: tuple[D.Entry, ...] = ()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        if "root" not in options:
            raise ValueError("the tree has no root")
        self.root = os.path.realpath(options["root"])
        self.max_bytes = int(options.get("max_bytes", D.MAX_BYTES))
        self.contents = str(options.get("contents", "true")).lower() == "true"
        self.also = [x for x in options.get("also", "").split(",") if x]
        self.under = [x for x in options.get("under", "").split(",") if x]

    def near(self, directory: str) -> bool:
        """Whether a directory can hold a path that is asked for."""
        return not self.under or any(directory == u or directory.startswith(u + "/") or u.startswith(directory + "/") for u in self.under)

    def asked(self, path: str) -> bool:
        return not self.under or any(path == u or path.startswith(u + "/") for u in self.under)

    def partitions(self) -> list[Subtrees]:
        if not os.path.isdir(self.root):
            raise D.DiscoveryError(f"not a directory: {self.root}")
        todo, met, listed = ["", *(d for d in self.also if os.path.isdir(os.path.join(self.root, d)))], [], 0
        while todo and len(todo) < SUBTREES and listed < LISTED:
            entries, inner = D.list_directory(self.root, todo.pop(0), self.max_bytes)
            met += entries
            todo += [d for d in inner if self.near(d)]
            listed += 1
        share = max(1, -(-len(met) // SUBTREES))
        return [Subtrees((d,)) for d in todo] + [Subtrees((), tuple(met[a : a + share])) for a in range(0, len(met), share)] or [Subtrees(())]

    def read(self, partition: Subtrees):
        for e in (*partition.entries, *D.walk(self.root, list(partition.starts), self.max_bytes, self.near)):
            if not self.asked(e.path):
                continue
            kind, code, message, source = e.kind, e.code, e.message, None
            if self.contents and kind == "file":
                source, fault = D.read_source(self.root, e.path, self.max_bytes)
                if fault:
                    kind, (code, message) = "issue", fault
            yield e.path, kind, e.size, code, message, None if e.rules is None else [tuple(r) for r in e.rules], source


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def entries(spark: SparkSession, root: str, max_bytes: int = D.MAX_BYTES, contents: bool = True, also: list[str] = (), under: list[str] = ()) -> DataFrame:
    """The rows of a tree."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    out = spark.read.format(NAME).option("root", os.path.realpath(root)).option("max_bytes", str(max_bytes)).option("contents", str(contents).lower()).option("also", ",".join(also)).option("under", ",".join(under)).load()
    return out if contents else out.drop("source")


def read(files: DataFrame, root: str, max_bytes: int = D.MAX_BYTES) -> DataFrame:
    """path, source, code, message of each path beneath the root: what can't be read has a code in place of a source."""
    import pyarrow as pa

    root = os.path.realpath(root)

    def run(frames):
        for batch in frames:
            for at in range(0, batch.num_rows, STEP):
                names = batch.column("path").slice(at, STEP).to_pylist()
                got = [D.read_source(root, p, max_bytes) for p in names]
                faults = [f or (None, None) for _, f in got]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (names, [s for s, _ in got], [c for c, _ in faults], [m for _, m in faults])], ["path", "source", "code", "message"])

    return files.select("path").mapInArrow(run, "path string, source string, code string, message string")


def modules(listing: DataFrame, roots: list[str], inferred: bool = True) -> DataFrame:
    """(key, path): top-level names that the tree itself provides, * for a link that could provide any. As project_modules() has it."""
    letters = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"
    names = []
    for root in roots:
        base = "" if root in (".", "") else root.strip("/") + "/"
        rest = F.substr("path", F.lit(len(base) + 1))
        stem = F.regexp_replace(F.regexp_replace(rest, r"\.py$", ""), r"(^|/)__init__$", "")
        fits = F.col("path").startswith(base) & F.col("path").endswith(".py") & stem.rlike(f"^{letters}(/{letters})*$")
        if inferred and root == "." and "src" in roots:
            fits &= ~F.col("path").startswith("src/")
        names.append(F.when(fits, F.substring_index(stem, "/", 1)))
    files = listing.where("kind in ('file', 'issue')").select("path", F.explode(F.array_compact(F.array(*names) if names else F.array().cast("array<string>"))).alias("key"))
    links = listing.where("kind = 'link'").select("path")
    if inferred:
        rest = F.regexp_replace("path", "^src/", "")
        key = F.when(F.col("path") == "src", "*").when(rest.rlike(f"^{letters}(/{letters})*$"), F.substring_index(rest, "/", 1))
        named = links.select("path", key.alias("key")).where("key is not null")
    else:
        every = []
        for root in roots:
            base = "" if root in (".", "") else root.strip("/")
            rest = F.substr("path", F.lit(len(base) + 2 if base else 1))
            inside = F.col("path").startswith(base + "/" if base else "") & rest.rlike(f"^{letters}(/{letters})*$")
            hides = (F.col("path") == base) | F.lit(base).startswith(F.concat("path", F.lit("/")))
            every.append(F.when(hides, "*").when(inside, F.substring_index(rest, "/", 1)))
        named = links.select("path", F.explode(F.array_compact(F.array(*every) if every else F.array().cast("array<string>"))).alias("key"))
    return files.union(named).select("key", "path").distinct()
